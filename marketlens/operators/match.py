"""Matching competitors' listings with the reference site's, and what is built on matched groups.

A listing has unit_key, ord, site, marque, modele, name, annee, prix, etat, category. Joins are on product keys (brand, and model without dealers, kinds
in front, states and colours), which rows may bring along as brand_key, model_key and base_key from where products are kept. Of several reference rows with one key the
nearest in price is found by bisection in an array of the key's distinct prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_key, strip_trims
from ..functions.values import valid_price, year_in_text
from .contents import by_content

MODES = ("exact", "base", "no_year", "flexible")
KEYS = ("brand_key", "model_key", "base_key")


def with_keys(rows: DataFrame, marque: Column, modele: Column, name: Column, colors: bool = True, into: tuple[str, str, str] = KEYS) -> DataFrame:
    """rows with brand_key, model_key and base_key (or as ``into`` names them), which is the model without trim words.

    Keys are made once for each distinct brand and model, and name where one of these may be empty.
    """
    # a letter or digit and no prefix to take off: it isn't empty once it is normalised, so the name isn't looked at
    told = lambda x: x.rlike("[A-Za-z0-9]") & ~F.contains(x, F.lit(":"))
    content = {"_marque": marque, "_modele": modele, "_name": F.when(~F.coalesce(told(marque) & told(modele), F.lit(False)), name)}
    brand, model = product_key(F.col("_marque"), F.col("_modele"), F.col("_name"), colors)
    make = lambda contents: contents.select("*", brand.alias(into[0]), model.alias(into[1])).withColumn(into[2], strip_trims(F.col(into[1])))
    return by_content(rows, content, make, list(into))


def keyed(rows: DataFrame, mode: str = "exact", colors: bool = True) -> DataFrame:
    """Adds k_marque, k_modele (empty if there is none), k_annee. ``base`` drops trim words, ``no_year`` the year, ``flexible`` both; ``colors`` says that colours are no part of a model.

    A year that isn't given is looked for in the name.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    own, (brand, model, base) = rows, KEYS
    if not (colors and {brand, model} <= set(rows.columns)):
        brand, model, base = into = tuple(f"_{k}" for k in KEYS)
        own = with_keys(rows, F.col("marque"), F.col("modele"), F.col("name"), colors, into)
    stripped = F.col(base) if base in own.columns else strip_trims(F.col(model))
    year = F.coalesce(F.nullif("annee", F.lit(0)), year_in_text(F.col("name")), F.lit(0)).cast("int") if "name" in rows.columns else F.coalesce("annee", F.lit(0))
    return own.select(
        *(F.col(f"`{c}`") for c in rows.columns),
        F.col(brand).alias("k_marque"),
        (stripped if mode in ("base", "flexible") else F.col(model)).alias("k_modele"),
        (F.lit(0) if mode in ("no_year", "flexible") else year).alias("k_annee"),
    )


def candidates(ref: DataFrame, key: list[str]) -> DataFrame:
    """(key, refs): the reference's rows of a key: ``priced``, one for each distinct price in its order (the first seen has it), the first seen of all, and the steps of a bisection."""
    first = F.min(F.struct("ord", "unit_key", "category")).alias("x")
    one = ref.groupBy(*key, "prix").agg(first).select(*key, F.struct("prix", "x.ord", "x.unit_key", "x.category").alias("r"))
    g = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("r.prix") > 0, F.col("r")))).alias("priced"), F.min(F.struct("r.ord", "r.unit_key", "r")).alias("first"))
    bits = F.length(F.bin(F.size("priced").cast("long")))
    steps = F.transform(F.sequence(F.lit(1), bits), lambda k: F.pow(F.lit(2), bits - k).cast("int"))
    return g.select(*key, F.struct("priced", F.col("first.r").alias("first"), steps.alias("steps")).alias("refs"))


def best_of(refs: Column, prix: Column) -> Column:
    """The nearest of the priced candidates, of two as near the first seen; without a price on either side the first seen of all."""
    priced = refs["priced"]
    upto = F.aggregate(refs["steps"], F.lit(0), lambda at, step: F.when((at + step <= F.size(priced)) & (F.get(priced, at + step - 1)["prix"] <= prix), at + step).otherwise(at))
    far = lambda r: F.struct(F.abs(prix - r["prix"]).alias("far"), r["ord"].alias("ord"), r["unit_key"].alias("unit_key"), r.alias("r"))
    near = F.array_min(F.transform(F.filter(F.array(F.get(priced, upto - 1), F.get(priced, upto)), lambda r: r.isNotNull()), far))["r"]
    return F.when((prix > 0) & (F.size(priced) > 0), near).otherwise(refs["first"])


def match(rows: DataFrame, reference: int, mode: str = "exact", how: str = "inner", colors: bool = True) -> DataFrame:
    """Competitor rows with ref_unit_key, ref_prix and difference of their best reference row; ``left`` keeps those without one.

    The reference's side is one site's rows, reduced to an array a key, so the competitors' side is neither multiplied nor grouped again, and
    Spark can broadcast the small side if it is.
    """
    own = keyed(rows, mode, colors)
    key = ["k_marque", "k_modele", "k_annee"]
    refs = candidates(own.where((F.col("site") == reference) & (F.col("k_modele") != "")), key)
    other = own.where(F.col("site") != reference)
    # rows without a model go after the join: a filter before it would normalise every name twice
    found = other.join(refs, key, how).where("k_modele <> ''").withColumn("ref", best_of(F.col("refs"), F.col("prix")))
    priced = (F.col("prix") > 0) & (F.col("ref.prix") > 0)
    return found.select(*other.columns, F.col("ref.unit_key").alias("ref_unit_key"), F.col("ref.prix").alias("ref_prix"), F.when(priced, F.col("prix") - F.col("ref.prix")).alias("difference"))


def union_of_sites(rows: DataFrame, reference: int, mode: str = "exact") -> DataFrame:
    """Reference rows, matched and unmatched competitor rows, with a label; of equal unit keys the first kind stays."""
    ref = rows.where(F.col("site") == reference).select("unit_key", "ord", "site", "prix", F.lit(None).cast("double").alias("ref_prix"), F.lit("reference").alias("kind"))
    left = match(rows, reference, mode, "left").select("unit_key", "ord", "site", "prix", "ref_prix", F.when(F.col("ref_unit_key").isNull(), "unmatched").otherwise("matched").alias("kind"))
    first = F.min_by(F.struct("ord", "site", "prix", "ref_prix", "kind"), F.struct(F.expr("array_position(array('reference', 'matched', 'unmatched'), kind)"), "ord")).alias("x")
    return ref.unionByName(left).groupBy("unit_key").agg(first).select("unit_key", "x.*")


def groups(rows: DataFrame, reference: int, mode: str = "exact") -> DataFrame:
    """(g, site, category, prix_ref, n, total, low): matched, validly priced competitor rows by group and site.

    A group is a key; its reference price is that of its first row, its category that of the reference's first row with the key.
    """
    found = match(rows, reference, mode).where(valid_price(F.col("prix")) & (F.col("ref_prix") > 0)).withColumn("g", F.concat_ws("|", "k_marque", "k_modele", F.col("k_annee").cast("string")))
    first = F.min(F.struct("ord", "unit_key", "ref_prix", F.col("category").alias("category"))).alias("f")
    per = found.groupBy("g", "site").agg(F.count(F.lit(1)).alias("n"), F.sum("prix").alias("total"), F.min("prix").alias("low"), first)
    # the group's head is the first of its sites' heads, found among one row a site
    head = F.min("f").over(Window.partitionBy("g"))
    return per.withColumn("h", head).select("g", "site", F.col("h.category").alias("category"), F.col("h.ref_prix").alias("prix_ref"), "n", "total", "low")


def market(per_site: DataFrame) -> DataFrame:
    """One row a group: reference price, market average and minimum, gaps as per cent of the reference, whether it is competitive."""
    g = per_site.groupBy("g").agg(F.first("category").alias("category"), F.first("prix_ref").alias("prix_ref"), (F.sum("total") / F.sum("n")).alias("market_avg"), F.min("low").alias("market_min"), F.sum("n").cast("long").alias("n_offers"), F.count(F.lit(1)).alias("n_sites"))
    gap = (F.col("prix_ref") - F.col("market_avg")) / F.col("prix_ref") * 100
    return g.withColumns({"gap_pct": gap, "gap_min_pct": (F.col("prix_ref") - F.col("market_min")) / F.col("prix_ref") * 100, "competitive": (F.col("prix_ref") <= F.col("market_avg")) | (F.abs(gap) < 0.5)})


def opportunities(per_site: DataFrame) -> DataFrame:
    """(g, kind, impact): raise if 3 to 15 % below the market, lower if over 8 % above, margin if 60 % of two or more sites are over 8 % dearer."""
    dearer = per_site.groupBy("g").agg(F.count_if(F.col("total") / F.col("n") > F.col("prix_ref") * 1.08).alias("n_dearer"))
    m = market(per_site).join(dearer, "g")
    ref, avg, gap = F.col("prix_ref"), F.col("market_avg"), F.col("gap_pct")
    rules = [
        ("raise", (ref < avg) & F.abs(gap).between(3, 15) & (F.abs(gap) < 15), avg - ref),
        ("lower", (ref > avg) & (gap > 8), ref - avg),
        ("margin", (F.col("n_sites") >= 2) & (F.col("n_dearer") >= F.ceil(F.col("n_sites") * 0.6)), ref * 0.05),
    ]
    found = F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), impact.alias("impact"))) for kind, test, impact in rules))
    return m.select("g", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("g", "x.kind", "x.impact")


def site_prices(per_site: DataFrame, reference: int) -> DataFrame:
    """(g, site, category, p): mean price of each site in each group, and the reference's, which a group's first row brings along."""
    first = F.row_number().over(Window.partitionBy("g").orderBy("site")) == 1
    own = F.struct(F.col("site").alias("site"), (F.col("total") / F.col("n")).alias("p"))
    ref = F.struct(F.lit(reference).cast("long").alias("site"), F.col("prix_ref").alias("p"))
    rows = per_site.select("g", "category", F.when(first, F.array(own, ref)).otherwise(F.array(own)).alias("x"))
    return rows.select("g", "category", F.explode("x").alias("x")).select("g", "x.site", "category", "x.p")


def retailers(per_site: DataFrame, reference: int, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """Each site against the mean of the other sites in its groups, then the mean over groups (every group weighs the same)."""
    w = Window.partitionBy("g")
    p = site_prices(per_site, reference).withColumns({"s": F.sum("p").over(w), "c": F.count("p").over(w)}).where("c >= 2")
    others = (F.col("s") - F.col("p")) / (F.col("c") - 1)
    return p.withColumn("gap", (F.col("p") - others) / others * 100).groupBy(*by).agg(F.avg("gap").alias("aggressivity"), F.avg("p").alias("avg_price"), F.count(F.lit(1)).alias("n_comparable"))


def recommend(offers: DataFrame, strategy: str = "lowest_minus_amount", amount: float = 1.0) -> DataFrame:
    """offers (g, site, prix_ref, ref_state, state, prix): a price for each group from each dealer's lowest comparable price.

    Only offers in the reference's state (or none stated) count; where there are none, all do and the reliability is low.
    """
    same = F.col("ref_state").isNull() | F.col("state").isNull() | (F.col("state") == F.col("ref_state"))
    low = offers.where("prix > 0 and prix_ref > 0").groupBy("g", "site").agg(F.first("prix_ref").alias("prix_ref"), F.min(F.when(same, F.col("prix"))).alias("same"), F.min("prix").alias("any"))
    g = low.groupBy("g").agg(F.first("prix_ref").alias("prix_ref"), F.count("same").alias("n_same"), F.min("same").alias("min_same"), F.avg("same").alias("avg_same"), F.min("any").alias("min_any"), F.avg("any").alias("avg_any"))
    normal = F.col("n_same") > 0
    least, mean = F.when(normal, F.col("min_same")).otherwise(F.col("min_any")), F.when(normal, F.col("avg_same")).otherwise(F.col("avg_any"))
    target = {"lowest_minus_amount": least - amount, "market_average": mean, "match_lowest": least}[strategy]
    price = F.greatest(F.lit(0.0), F.floor(target * 100 + 0.5) / 100)
    return g.select("g", "prix_ref", F.when(normal, "normal").otherwise("low").alias("reliability"), price.alias("recommended"), (price - F.col("prix_ref")).alias("change"))
