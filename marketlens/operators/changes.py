"""Changes between snapshots of one site's units, and the price-history log that they feed.

A snapshot is rows of (site, unit_key, prix, disponibilite), with a name where it is known, and ``multi`` where the unit is one of several that its model
lists. Prices compare only for the same unit; a unit is new if neither of the two snapshots before has it, and removed if the one before last had it and
neither the last nor the current one has. One full outer grouping by unit does all of it.

With names, a unit of neither model with several units that is gone under its key and there under another with the same name is the same offer, posted
again: it is compared, and is neither new nor removed. Where a model of one unit begins to list several, they are not new, and their prices aren't
compared with the one before. A model changes stock once, however many units it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_name_key

#: Prices below it are no prices.
MIN_PRICE = 1.0


def with_names(units: DataFrame, three: bool) -> DataFrame:
    """Adds ``last``, the unit with the same name in the snapshot before (of several the one with the greatest key) and whether its key is free now, and ``now``, whether the name is there now."""
    free = F.struct("unit_key", F.col("p").alias("p"), F.col("c").isNull().alias("free"))
    sides = F.array(F.struct(F.col("p.k").alias("k"), free.alias("last"), F.lit(False).alias("now")), F.struct(F.col("c.k").alias("k"), F.when(F.lit(False), free).alias("last"), F.lit(True).alias("now")))
    names = units.select("site", F.explode(sides).alias("x")).where("x.k <> ''").groupBy("site", F.col("x.k").alias("k")).agg(F.max_by("x.last", "x.last.unit_key").alias("last"), F.max("x.now").alias("now"))
    return units.withColumn("k", F.coalesce("c.k", "pp.k" if three else "p.k")).join(names, ["site", "k"], "left")


def detect(before_last: DataFrame | None, last: DataFrame, now: DataFrame, min_pct: float = 0.0, min_abs: float = 0.0) -> DataFrame:
    """(site, unit_key, change_type, old_value, new_value, pct), one row a change. Without ``before_last`` absence counts at once."""
    three = before_last is not None
    named = "name" in now.columns and "name" in last.columns
    rows = None
    for df, age in [(now, 0), (last, 1)] + ([(before_last, 2)] if three else []):
        k = product_name_key(F.coalesce("name", F.lit(""))) if named and "name" in df.columns else F.lit("")
        multi = F.coalesce("multi", F.lit(False)) if "multi" in df.columns else F.lit(not named)
        own = df.select("site", "unit_key", F.lit(age).alias("age"), F.struct("prix", "disponibilite", k.alias("k"), multi.alias("multi")).alias("x"))
        rows = own if rows is None else rows.unionByName(own)
    g = rows.groupBy("site", "unit_key").agg(*(F.max(F.when(F.col("age") == k, F.col("x"))).alias(n) for k, n in enumerate(("c", "p", "pp"))))
    yes = lambda x: F.coalesce(x, F.lit(False))
    unseen: Column = F.lit(True)
    alive: Column = F.lit(False)
    if named:
        g = with_names(g, three)
        single = ~yes(F.col("last.p.multi")) & F.col("last").isNotNull()
        again = F.col("c").isNotNull() & F.col("p").isNull() & ~yes(F.col("c.multi")) & single & yes(F.col("last.free"))
        unseen = ~(yes(F.col("c.multi")) & single)
        alive = ~yes(F.col("pp.multi" if three else "p.multi")) & yes(F.col("now"))
        g = g.withColumns({"p": F.when(again, F.col("last.p")).otherwise(F.col("p")), "unseen": unseen, "alive": alive})
        unseen, alive = F.col("unseen"), F.col("alive")
    old, new = F.col("p.prix"), F.col("c.prix")
    pct = (new - old) / old * 100
    split = F.col("c.multi") & ~F.col("p.multi")
    price = (old >= MIN_PRICE) & (new >= MIN_PRICE) & (old != new) & (F.abs(pct) >= min_pct) & (F.abs(new - old) >= min_abs) & ~split
    stock = F.lower(F.trim(F.col("p.disponibilite"))) != F.lower(F.trim(F.col("c.disponibilite")))
    gone = F.col("pp") if three else F.col("p")
    seen = F.col("p").isNull() & F.col("pp").isNull() & unseen
    lost = F.col("c").isNull() & (F.col("p").isNull() if three else F.lit(True)) & (gone["prix"] >= MIN_PRICE) & ~alive
    change = lambda kind, a, b, p: F.struct(F.lit(kind).alias("change_type"), a.alias("old_value"), b.alias("new_value"), p.alias("pct"))
    none = F.lit(None).cast("double")
    found = F.array(
        F.when(price & (pct > 0), change("price_increase", old, new, pct)),
        F.when(price & (pct < 0), change("price_decrease", old, new, pct)),
        F.when(seen & (new >= MIN_PRICE), change("new_product", none, new, none)),
        F.when(lost, change("removed_product", gone["prix"], none, none)),
        F.when(stock, change("stock_change", none, none, none)),
    )
    kept = F.filter(found, lambda x: x.isNotNull())
    if not named:
        return g.select("site", "unit_key", F.explode(kept).alias("x")).select("site", "unit_key", "x.*")
    out = g.select("site", "unit_key", F.coalesce(F.nullif("c.k", F.lit("")), "unit_key").alias("k"), F.explode(kept).alias("x")).select("site", "unit_key", "k", "x.*")
    # of a model's units the first tells of its stock; other changes pass as they are
    once = F.when(F.col("change_type") == "stock_change", F.lit("")).otherwise(F.col("unit_key")).alias("_unit")
    rest = [F.min_by(c, "unit_key").alias(c) for c in ("old_value", "new_value", "pct")]
    return out.groupBy("site", "k", once, "change_type").agg(F.min("unit_key").alias("unit_key"), *rest).select("site", "unit_key", "change_type", "old_value", "new_value", "pct")


def price_history(snapshots: DataFrame) -> DataFrame:
    """(site, unit_key, t, prix, previous, change_type) of all snapshots (site, t, unit_key, prix): a unit unseen in the site's snapshot before gives a baseline, a changed price a price change.

    The log compares with the snapshot before only: a unit that was away gives a new baseline.
    """
    times = snapshots.select("site", "t").distinct().withColumn("before", F.lag("t").over(Window.partitionBy("site").orderBy("t")))
    own = Window.partitionBy("site", "unit_key").orderBy("t")
    rows = snapshots.where(F.col("prix") >= MIN_PRICE).withColumns({"last_t": F.lag("t").over(own), "last_prix": F.lag("prix").over(own)}).join(times, ["site", "t"])
    previous = F.when(F.col("last_t") == F.col("before"), F.col("last_prix"))
    return rows.select("site", "unit_key", "t", "prix", previous.alias("previous"), F.when(previous.isNull(), "baseline").otherwise("price_change").alias("change_type")).where("previous is null or previous <> prix")
