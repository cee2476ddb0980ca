"""Valuing an item from comparable offers: adjustments, similarity weights, outliers, weighted percentiles and how sure the result is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import depreciated


@dataclass(frozen=True)
class Rates:
    """Fixed values of a category: depreciation, distance a year, distance of a new vehicle, largest plausible one, what used leaves of new, price bounds."""

    phases: str = "powersport"
    km_a_year: float = 5_000
    new_km: float = 500
    most_km: float = 200_000
    used_of_new: float = 0.82
    least: float = 0.10
    most: float = 1.20


# Weights of text score, year, mileage, options and state; the least weight; the largest price of a new offer seen as used; the largest
# part of a price that options add; the years and the mileage ratio at which closeness ends.
TEXT, NEAR_YEAR, MILEAGE, OPTIONS, STATE, LEAST_WEIGHT = 0.42, 0.23, 0.15, 0.12, 0.08, 0.05
USED_FROM_NEW, MOST_OPTIONS, YEARS, FAR_RATIO = 0.95, 0.30, 3, 1.5
# The mileage factor at each ratio of actual to expected distance; straight lines between, level outside.
MILEAGE_FACTORS = [(0.4, 1.15), (0.7, 1.05), (1.0, 1.0), (1.2, 0.95), (1.5, 0.85), (2.5, 0.70)]


def mileage_factor(ratio: Column) -> Column:
    out = F.lit(MILEAGE_FACTORS[-1][1])
    for (x, y), (x2, y2) in reversed(list(zip(MILEAGE_FACTORS, MILEAGE_FACTORS[1:], strict=False))):
        out = F.when(ratio < x2, y + (ratio - x) / (x2 - x) * (y2 - y)).otherwise(out)
    return F.when(ratio <= MILEAGE_FACTORS[0][0], MILEAGE_FACTORS[0][1]).otherwise(out)


def mileage_ratio(km: Column, age: Column, rates: Rates) -> Column:
    return km / (F.greatest(F.lit(0.5), age) * rates.km_a_year)


def condition(etat: Column, km: Column, rates: Rates) -> Column:
    """neuf, occasion or null; an unknown state with hardly any distance is new."""
    x = F.lower(F.coalesce(etat, F.lit("")))
    return F.when(x.isin("neuf", "new"), "neuf").when(x.rlike("usag|occasion|used"), "occasion").when(km <= rates.new_km, "neuf")


def year_adjusted(prix: Column, age: Column, target_age: Column, phases: str = "powersport") -> Column:
    """The price as if the offer were of the target's age."""
    return prix * depreciated(target_age, phases) / depreciated(age, phases)


def weighted_percentiles(rows: DataFrame, by: list[str], value: str, weight: str, order: str, shares: dict[str, float], also: list[Column] | None = None) -> DataFrame:
    """The least value at which the running weight reaches each share of the group's weight, and other aggregates of the group."""
    w = Window.partitionBy(*by)
    run = w.orderBy(value, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.withColumns({"_run": F.sum(weight).over(run), "_all": F.sum(weight).over(w)})
    return x.groupBy(*by).agg(*(F.min(F.when(F.col("_run") >= share * F.col("_all"), F.col(value))).alias(name) for name, share in shares.items()), *(also or []))


def evaluate(offers: DataFrame, targets: DataFrame, as_of: int, premiums: dict[str, float] | None = None, rates: Rates = Rates()) -> DataFrame:
    """What each target is worth, one row a product with offers: low, median, high, offers used, sources, reliability.

    offers: product, unit_key, ord, site, name, prix, annee, etat, kilometrage, options (array), score; targets: product (once each), target_year,
    target_state, target_km, target_options; any but product may be null. Offers alike in name, price to the hundred and site count once (the first).
    Those more than three years off or of an implausible distance go, and, if three or more have all options asked for, the others too. Prices are
    adjusted in year, mileage and state by factors, and by the premiums of options that only the target has. Those outside 1.5 interquartile ranges
    around the median go (2.5 with fewer than ten, none with fewer than six); weighted quartiles follow, spread to at least 10 %. Fewer than three
    offers, at first or in the end, are ``insufficient`` and give no values.
    """
    same = ["product", F.coalesce("name", F.lit("")).alias("_name"), F.floor(F.coalesce("prix", F.lit(0.0)) / 100 + 0.5).alias("_bucket"), "site"]
    hit = F.struct("unit_key", "prix", "annee", "etat", "kilometrage", "options", "score").alias("x")
    once = offers.where("prix > 0").groupBy(*same).agg(F.min_by(hit, F.struct("ord", "unit_key")).alias("x")).select("product", "site", "x.*")
    asked = F.coalesce("target_options", F.array().cast("array<string>"))
    has = F.coalesce("options", F.array().cast("array<string>"))
    near = once.join(targets, "product").where(F.coalesce(F.abs(F.col("annee") - F.col("target_year")) <= YEARS, F.lit(True)) & F.coalesce(F.col("kilometrage").between(0, rates.most_km), F.lit(True)))
    near = near.withColumn("_fits", (F.size(asked) > 0) & (F.size(F.array_except(asked, has)) == 0))
    # all windows share the partitioning by product, so what is left of a product's offers moves once
    own = Window.partitionBy("product")
    near = near.withColumn("_fit", F.count_if("_fits").over(own)).where((F.col("_fit") < 3) | F.col("_fits"))

    def age(year: str, other: str) -> Column:
        return F.greatest(F.lit(0), as_of - F.coalesce(year, other, F.lit(as_of)))

    # in steps, so that the ratios and factors are computed once and not wherever they are named
    state = condition(F.col("etat"), F.col("kilometrage"), rates)
    near = near.withColumns({"_asked": asked, "_has": has, "_state": state})
    km = F.coalesce("kilometrage", F.when(F.col("_state") == "neuf", 0))
    near = near.withColumns({"_ratio": mileage_ratio(km, age("annee", "annee"), rates), "_target": mileage_ratio(F.col("target_km"), age("target_year", "annee"), rates)})
    known = F.col("annee").isNotNull() & F.col("target_year").isNotNull()  # greatest and least pass over nulls
    near = near.withColumns({
        "_by_year": F.when(known, year_adjusted(F.lit(1.0), as_of - F.col("annee"), as_of - F.col("target_year"), rates.phases)).otherwise(1.0),
        "_by_km": F.when(F.col("_target").isNull(), 1.0).otherwise(mileage_factor(F.col("_target")) / F.when(F.col("_ratio").isNull(), 1.0).otherwise(mileage_factor(F.col("_ratio")))),
    })
    prix, want, state, ratio, target_ratio = (F.col(c) for c in ("prix", "target_state", "_state", "_ratio", "_target"))
    by_km = F.when(F.abs(F.col("_by_km") - 1) <= 0.005, 1.0).otherwise(F.col("_by_km"))
    by_state = F.when((state == "neuf") & (want == "occasion"), rates.used_of_new).when((state == "occasion") & (want == "neuf"), 1 / rates.used_of_new).otherwise(1.0)
    extra = sum((F.when(F.array_contains("_asked", k) & ~F.array_contains("_has", k), v).otherwise(0.0) for k, v in (premiums or {}).items()), F.lit(0.0))
    most = F.when((state == "neuf") & (want == "occasion"), USED_FROM_NEW).otherwise(rates.most)
    value = F.greatest(prix * rates.least, F.least(prix * most, prix * F.col("_by_year") * by_km * by_state + F.least(prix * MOST_OPTIONS, extra)))
    shared = F.size(F.array_intersect("_asked", "_has")) / F.size("_asked")
    weight = F.greatest(
        F.lit(LEAST_WEIGHT),
        TEXT * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
        + NEAR_YEAR * F.when(known, F.greatest(F.lit(0.0), 1 - F.abs(F.col("annee") - F.col("target_year")) / YEARS)).otherwise(0.5)
        + MILEAGE * F.when(ratio.isNull() | target_ratio.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(target_ratio - ratio) / FAR_RATIO))
        + OPTIONS * F.when(F.size("_asked") == 0, 0.5).otherwise(shared)
        + STATE * F.when(want.isNull() | state.isNull(), 0.75).when(want == state, 1.0).otherwise(0.65),
    )
    # whole millionths, so that running sums don't depend on the order in which a task adds them
    near = near.select("product", "unit_key", "site", F.round(value, 6).alias("v"), F.round(weight * 1e6).cast("long").alias("w"))
    near = near.withColumns({"q": F.percentile("v", [0.25, 0.5, 0.75]).over(own), "n": F.count(F.lit(1)).over(own)})
    span = F.when(F.col("n") < 10, 2.5).otherwise(1.5) * (F.col("q")[2] - F.col("q")[0])
    kept = near.where((F.col("n") < 6) | (F.abs(F.col("v") - F.col("q")[1]) <= span + 1e-6))
    counts = [F.max("n").alias("_n"), F.count(F.lit(1)).alias("n_used"), F.count_distinct("site").alias("n_sources")]
    p = weighted_percentiles(kept, ["product"], "v", "w", "unit_key", {"low": 0.25, "mid": 0.5, "high": 0.75}, counts)
    low, high = F.least("low", F.col("mid") * 0.9), F.greatest("high", F.col("mid") * 1.1)
    spread = (high - low) / F.col("mid")
    enough = (F.col("_n") >= 3) & (F.col("n_used") >= 3)
    weak = (F.col("n_used") < 4) | (spread > 0.25) | (F.col("n_sources") < 2)
    good = (F.col("n_used") >= 8) & (spread < 0.10) & (F.col("n_sources") >= 4)
    sure = F.when(~enough, "insufficient").when(weak, "low").when(good, "good").otherwise("indicative")
    values = [F.when(enough, x).alias(name) for name, x in (("low", low), ("median", F.col("mid")), ("high", high))]
    return p.select("product", *values, "n_used", "n_sources", sure.alias("reliability"))


def price_position(price: Column, low: Column, median: Column, high: Column) -> Column:
    """struct(label, of_median, marker): where an asked price stands in the range; null without a price."""
    label = F.when(price < low, "Sous le marché").when(price > high * 1.15, "Hors marché").when(price > high, "Au-dessus du marché").otherwise("Aligné au marché")
    marker = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (price - low) / F.greatest(F.lit(1.0), high - low) * 100))
    return F.when(price > 0, F.struct(label.alias("label"), F.when(median > 0, price / median - 1).otherwise(0.0).alias("of_median"), marker.alias("marker")))
