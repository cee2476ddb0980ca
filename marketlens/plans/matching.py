"""Queries of matching, market analytics and pricing over the listing view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocab import TRIMS
from ..operators import match as m
from ..functions.values import state_family
from .listing import REFERENCE, SQL
from .listing import keyed_listing as listing
from .scalars import deep, model_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def keyed_sql(mode: str, modele: str = "modele") -> str:
    model = model_sql(deep("shown"))
    if mode in ("base", "flexible"):
        model = f"trim(regexp_replace(regexp_replace({model}, '(?i)\\b(?:{'|'.join(TRIMS)})\\b', '', 'g'), '\\s+', ' ', 'g'))"
    year = "0" if mode in ("no_year", "flexible") else "coalesce(annee, 0)"
    return f"""{SQL}, offered AS (SELECT *, {modele} AS shown FROM listing), names AS (SELECT marque, shown, {deep('marque')} AS k_marque, {model} AS k_modele FROM (SELECT DISTINCT marque, shown FROM offered)),
    keyed AS (SELECT *, {year} AS k_annee FROM offered JOIN names USING (marque, shown))"""


def matched_sql(mode: str, modele: str = "modele") -> str:
    return f"""{keyed_sql(mode, modele)}, pairs AS (SELECT c.*, r.unit_key AS ref_unit_key, r.prix AS ref_prix, row_number() OVER (PARTITION BY c.unit_key ORDER BY CASE WHEN c.prix > 0 AND r.prix > 0 THEN 0 ELSE 1 END,
    abs(c.prix - r.prix), r.ord, r.unit_key) AS rn FROM keyed c JOIN keyed r USING (k_marque, k_modele, k_annee) WHERE c.site <> {REFERENCE} AND r.site = {REFERENCE} AND k_modele <> ''), matched AS (SELECT * FROM pairs WHERE rn = 1)"""


def groups_sql(mode: str = "flexible") -> str:
    return f"""{matched_sql(mode)}, found AS (SELECT *, k_marque || '|' || k_modele || '|' || k_annee AS g FROM matched WHERE prix > 0 AND prix < 500000 AND ref_prix > 0),
    head AS (SELECT g, ref_prix AS prix_ref, category FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord, unit_key) AS i FROM found) WHERE i = 1),
    per AS (SELECT g, site, category, prix_ref, n, total, low FROM (SELECT g, site, count(*) AS n, sum(prix) AS total, min(prix) AS low FROM found GROUP BY g, site) JOIN head USING (g)),
    market AS (SELECT *, (prix_ref - market_avg) / prix_ref * 100 AS gap_pct, (prix_ref - market_min) / prix_ref * 100 AS gap_min_pct FROM (SELECT g, any_value(category) AS category, any_value(prix_ref) AS prix_ref,
    sum(total) / sum(n) AS market_avg, min(low) AS market_min, CAST(sum(n) AS BIGINT) AS n_offers, count(*) AS n_sites FROM per GROUP BY g))"""


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


def per(spark: SparkSession, d: str) -> DataFrame:
    return m.groups(listing(spark, d), REFERENCE, "flexible")


for _mode in m.MODES:

    @query(f"j1_reference_match_{_mode}", matched_sql(_mode) + " SELECT unit_key, ref_unit_key, round(ref_prix, 6) AS ref_prix, round(prix - ref_prix, 6) AS difference FROM matched")
    def j1(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        return m.match(listing(spark, d), REFERENCE, mode).select("unit_key", "ref_unit_key", F.round("ref_prix", 6).alias("ref_prix"), F.round("difference", 6).alias("difference"))


#: Models as retailers show them: kinds in front, colours, states, dealers.
SHOWN = "concat(CASE ord % 4 WHEN 0 THEN 'VTT ' WHEN 1 THEN 'Moto sportive ' ELSE '' END, modele, CASE ord % 6 WHEN 0 THEN ' Noir usage a Laval' WHEN 1 THEN ' Rouge' WHEN 2 THEN ' pre-commande' WHEN 3 THEN ' Rive powersports' WHEN 4 THEN ' neuf, disponible chez nous' ELSE '' END)"


@query("j1_reference_match_as_shown", matched_sql("no_year", SHOWN) + " SELECT unit_key, ref_unit_key, round(ref_prix, 6) AS ref_prix FROM matched")
def j1s(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("modele", F.expr(SHOWN)).drop("brand_key", "model_key", "base_key")
    return m.match(rows, REFERENCE, "no_year").select("unit_key", "ref_unit_key", F.round("ref_prix", 6).alias("ref_prix"))


@query(
    "j2_nearest_price_by_product",
    f"""{SQL} SELECT unit_key, ref_unit_key, round(gap, 6) AS gap FROM (SELECT c.unit_key, r.unit_key AS ref_unit_key, abs(c.prix - r.prix) AS gap, row_number() OVER (PARTITION BY c.unit_key ORDER BY abs(c.prix - r.prix), r.ord, r.unit_key) AS rn
    FROM listing c JOIN listing r USING (product) WHERE c.site <> {REFERENCE} AND r.site = {REFERENCE}) WHERE rn = 1""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).select("product", "site", "unit_key", "ord", "prix", "category")
    refs = m.candidates(rows.where(F.col("site") == REFERENCE), ["product"])
    found = rows.where(F.col("site") != REFERENCE).join(refs, "product").withColumn("r", m.best_of(F.col("refs"), F.col("prix")))
    return found.select("unit_key", F.col("r.unit_key").alias("ref_unit_key"), F.round(F.abs(F.col("prix") - F.col("r.prix")), 6).alias("gap"))


@query("j3_left_match_union", matched_sql("exact") + f" SELECT DISTINCT unit_key, CASE WHEN l.site = {REFERENCE} THEN 'reference' WHEN x.ref_unit_key IS NULL THEN 'unmatched' ELSE 'matched' END AS kind, round(x.ref_prix, 6) AS ref_prix FROM listing l LEFT JOIN (SELECT unit_key, ref_unit_key, ref_prix FROM matched) x USING (unit_key)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return m.union_of_sites(listing(spark, d), REFERENCE).select("unit_key", "kind", F.round("ref_prix", 6).alias("ref_prix"))


@query("j4_matched_groups", groups_sql() + " SELECT g, site, category, round(prix_ref, 6) AS prix_ref, n, round(total / n, 6) AS avg_price, round(low, 6) AS low FROM per")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return per(spark, d).select("g", "site", "category", F.round("prix_ref", 6).alias("prix_ref"), "n", F.round(F.col("total") / F.col("n"), 6).alias("avg_price"), F.round("low", 6).alias("low"))


@query("j5_pricing_rows", matched_sql("exact") + " SELECT ref_unit_key, site, count(*) AS n_units, round(min(prix), 6) AS low, round(max(prix), 6) AS high FROM matched GROUP BY ref_unit_key, site")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return m.match(listing(spark, d), REFERENCE).groupBy("ref_unit_key", "site").agg(F.count(F.lit(1)).alias("n_units"), F.round(F.min("prix"), 6).alias("low"), F.round(F.max("prix"), 6).alias("high"))


@query("j6_reference_only", matched_sql("exact") + f" SELECT unit_key FROM keyed k WHERE site = {REFERENCE} AND NOT EXISTS (SELECT 1 FROM matched x WHERE x.ref_unit_key = k.unit_key) AND NOT EXISTS (SELECT 1 FROM matched y WHERE y.k_marque = k.k_marque AND y.k_modele = k.k_modele AND y.k_annee = k.k_annee)")
def j6(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    found = m.match(rows, REFERENCE)
    ref = m.keyed(rows).where((F.col("site") == REFERENCE) & (F.col("k_modele") != ""))
    return ref.join(found.select(F.col("ref_unit_key").alias("unit_key")), "unit_key", "left_anti").join(found, ["k_marque", "k_modele", "k_annee"], "left_anti").select("unit_key")


MARKET = "g, category, round(prix_ref, 6) AS prix_ref, round(market_avg, 6) AS market_avg, round(market_min, 6) AS market_min, round(gap_pct, 6) AS gap_pct, round(gap_min_pct, 6) AS gap_min_pct, n_offers, n_sites"


@query("a4_product_analysis", groups_sql() + f" SELECT {MARKET}, prix_ref <= market_avg OR abs(gap_pct) < 0.5 AS competitive FROM market")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return m.market(per(spark, d)).selectExpr(*(x if "AS" in x else x for x in _split(MARKET)), "competitive")


def _split(columns: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


OPPORTUNITY = """, dear AS (SELECT g, count(*) FILTER (WHERE total / n > prix_ref * 1.08) AS n_dearer FROM per GROUP BY g), opp AS (
    SELECT g, 'raise' AS kind, market_avg - prix_ref AS impact FROM market WHERE prix_ref < market_avg AND abs(gap_pct) >= 3 AND abs(gap_pct) < 15
    UNION ALL SELECT g, 'lower', prix_ref - market_avg FROM market WHERE prix_ref > market_avg AND gap_pct > 8
    UNION ALL SELECT g, 'margin', prix_ref * 0.05 FROM market JOIN dear USING (g) WHERE n_sites >= 2 AND n_dearer >= ceil(n_sites * 0.6))"""


@query("a5_opportunities", groups_sql() + OPPORTUNITY + " SELECT g, kind, round(impact, 6) AS impact FROM opp")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return m.opportunities(per(spark, d)).select("g", "kind", F.round("impact", 6).alias("impact"))


@query("a38_top_opportunities", groups_sql() + OPPORTUNITY + " SELECT kind, count(*) AS n, round(sum(impact), 6) AS impact FROM (SELECT * FROM opp ORDER BY abs(impact) DESC, g, kind LIMIT 8) GROUP BY kind")
def a38(spark: SparkSession, d: str) -> DataFrame:
    top = m.opportunities(per(spark, d)).orderBy(F.abs("impact").desc(), "g", "kind").limit(8)
    return top.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("impact"), 6).alias("impact"))


RETAIL = f""", sp AS (SELECT g, CAST({REFERENCE} AS BIGINT) AS site, category, prix_ref AS p FROM market UNION ALL SELECT g, site, category, total / n FROM per), loo AS (SELECT *, (s - p) / (c - 1) AS others FROM
    (SELECT *, sum(p) OVER (PARTITION BY g) AS s, count(p) OVER (PARTITION BY g) AS c FROM sp) WHERE c >= 2), ret AS (SELECT site, category, p, (p - others) / others * 100 AS gap FROM loo)"""


@query("a6_retailer_analysis", groups_sql() + RETAIL + " SELECT site, round(avg(gap), 6) AS aggressivity, round(avg(p), 6) AS avg_price, count(*) AS n_comparable FROM ret GROUP BY site")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return m.retailers(per(spark, d), REFERENCE).select("site", F.round("aggressivity", 6).alias("aggressivity"), F.round("avg_price", 6).alias("avg_price"), "n_comparable")


@query("a6_retailer_by_category", groups_sql() + RETAIL + " SELECT site, category, round(avg(gap), 6) AS aggressivity, round(avg(p), 6) AS avg_price, count(*) AS n_comparable FROM ret GROUP BY site, category")
def a6c(spark: SparkSession, d: str) -> DataFrame:
    return m.retailers(per(spark, d), REFERENCE, ("site", "category")).select("site", "category", F.round("aggressivity", 6).alias("aggressivity"), F.round("avg_price", 6).alias("avg_price"), "n_comparable")


@query(
    "a3_price_positioning",
    groups_sql() + RETAIL + f""", r AS (SELECT site, avg(gap) AS a FROM ret GROUP BY site) SELECT round(a, 6) AS gap_pct, CAST((SELECT count(*) FROM r) AS BIGINT) AS n_retailers, CAST((SELECT count(*) FROM r o WHERE o.a < r.a OR (o.a = r.a AND o.site < r.site)) + 1 AS BIGINT) AS rank,
    CASE WHEN a < -2 THEN 'lowest' WHEN a > 2 THEN 'above' ELSE 'average' END AS position FROM r WHERE site = {REFERENCE}""",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    """Also W1: the reference's place in the list of retailers by aggressivity. One row a retailer is compared with the reference's row, so nothing is ranked by a global sort."""
    r = m.retailers(per(spark, d), REFERENCE).select("site", F.col("aggressivity").alias("a"))
    ref = r.where(F.col("site") == REFERENCE).select(F.col("a").alias("x"), F.lit(REFERENCE).alias("rs"), F.lit(0).alias("one"))
    both = r.withColumn("one", F.lit(0)).join(ref, "one")
    g = both.groupBy("x").agg(F.count(F.lit(1)).alias("n_retailers"), (F.count_if((F.col("a") < F.col("x")) | ((F.col("a") == F.col("x")) & (F.col("site") < F.col("rs")))) + 1).alias("rank"))
    return g.select(F.round("x", 6).alias("gap_pct"), "n_retailers", "rank", F.when(F.col("x") < -2, "lowest").when(F.col("x") > 2, "above").otherwise("average").alias("position"))


@query(
    "a7_category_analysis",
    groups_sql() + """ SELECT category, CAST(sum(n_offers) + count(*) AS BIGINT) AS n_products, round(avg(prix_ref), 6) AS ref_avg, round(sum(market_avg * n_offers) / sum(n_offers), 6) AS competitor_avg, round(avg(gap_pct), 6) AS gap_pct,
    count(*) FILTER (WHERE prix_ref <= market_avg OR abs(gap_pct) < 0.5) AS competitive, count(*) FILTER (WHERE NOT (prix_ref <= market_avg OR abs(gap_pct) < 0.5)) AS not_competitive FROM market GROUP BY category""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    x = m.market(per(spark, d))
    return x.groupBy("category").agg(
        (F.sum("n_offers") + F.count(F.lit(1))).alias("n_products"), F.round(F.avg("prix_ref"), 6).alias("ref_avg"), F.round(F.sum(F.col("market_avg") * F.col("n_offers")) / F.sum("n_offers"), 6).alias("competitor_avg"),
        F.round(F.avg("gap_pct"), 6).alias("gap_pct"), F.count_if("competitive").alias("competitive"), F.count_if(~F.col("competitive")).alias("not_competitive"),
    )


@query("a7_category_retailers", groups_sql() + " SELECT category, site, round(sum(total) / sum(n), 6) AS avg_price, round(avg((total / n - prix_ref) / prix_ref * 100), 6) AS gap_pct, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY category, site")
def a7r(spark: SparkSession, d: str) -> DataFrame:
    gap = (F.col("total") / F.col("n") - F.col("prix_ref")) / F.col("prix_ref") * 100
    return per(spark, d).groupBy("category", "site").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("avg_price"), F.round(F.avg(gap), 6).alias("gap_pct"), F.sum("n").alias("n"))


@query(
    "a8_alert_summary",
    groups_sql() + """ SELECT n_above, n_far_above, CASE WHEN n_far_above > 0 THEN 'high' END AS far_severity, CASE WHEN n_above > n_far_above THEN CASE WHEN n_above > 10 THEN 'high' WHEN n_above > 5 THEN 'medium' ELSE 'low' END END AS above_severity
    FROM (SELECT count(*) FILTER (WHERE gap_pct > 0.5) AS n_above, count(*) FILTER (WHERE gap_pct > 15) AS n_far_above FROM market)""",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    x = m.market(per(spark, d)).agg(F.count_if(F.expr("gap_pct > 0.5")).alias("n_above"), F.count_if(F.expr("gap_pct > 15")).alias("n_far_above"))
    above = F.col("n_above")
    return x.select("n_above", "n_far_above", F.when(F.col("n_far_above") > 0, "high").alias("far_severity"), F.when(above > F.col("n_far_above"), F.when(above > 10, "high").when(above > 5, "medium").otherwise("low")).alias("above_severity"))


@query("a9_global_stats", SQL + " SELECT round(avg(prix), 6) AS avg_price, round(count(*) * 2 / 60.0, 6) AS hours_saved, count(*) AS n FROM listing WHERE prix > 0 AND prix < 500000")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).where(m.valid_price(F.col("prix"))).agg(F.round(F.avg("prix"), 6).alias("avg_price"), F.round(F.count(F.lit(1)) * 2 / F.lit(60.0), 6).alias("hours_saved"), F.count(F.lit(1)).alias("n"))


@query("a13_competitor_cards", matched_sql("flexible") + " SELECT site, count(*) AS n_matched, count(*) FILTER (WHERE prix < ref_prix) AS n_cheaper, CAST(floor(100.0 * count(*) FILTER (WHERE prix < ref_prix) / count(*) + 0.5) AS BIGINT) AS aggressivity, round(avg((prix - ref_prix) / ref_prix * 100), 6) AS mean_pct FROM matched GROUP BY site")
def a13(spark: SparkSession, d: str) -> DataFrame:
    x = m.match(listing(spark, d), REFERENCE, "flexible").groupBy("site").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if(F.expr("prix < ref_prix")).alias("n_cheaper"), F.round(F.avg((F.col("prix") - F.col("ref_prix")) / F.col("ref_prix") * 100), 6).alias("mean_pct"))
    return x.withColumn("aggressivity", F.floor(F.col("n_cheaper") * 100.0 / F.col("n_matched") + 0.5).cast("long"))


@query("a14_site_selection", matched_sql("flexible") + " SELECT site, count(*) AS n_matched, count(DISTINCT CASE WHEN prix < ref_prix THEN ref_unit_key END) AS n_undercut FROM matched GROUP BY site")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return m.match(listing(spark, d), REFERENCE, "flexible").groupBy("site").agg(F.count(F.lit(1)).alias("n_matched"), F.count_distinct(F.when(F.col("prix") < F.col("ref_prix"), F.col("ref_unit_key"))).alias("n_undercut"))


BINS = [-20, -10, -5, 0, 5, 10, 20]
BIN_SQL = "CASE " + " ".join(f"WHEN gap_pct < {b} THEN {i}" for i, b in enumerate(BINS)) + f" ELSE {len(BINS)} END"


@query("a36_gap_histogram", groups_sql() + f" SELECT CAST(b.range AS INTEGER) AS bin, count(g) AS n FROM range(8) b LEFT JOIN (SELECT g, {BIN_SQL} AS bin FROM market WHERE abs(gap_pct) > 0.1) x ON x.bin = b.range GROUP BY 1")
def a36(spark: SparkSession, d: str) -> DataFrame:
    bins = spark.range(len(BINS) + 1).select(F.col("id").cast("int").alias("bin"))
    x = m.market(per(spark, d)).where("abs(gap_pct) > 0.1").select("g", F.expr(BIN_SQL).alias("bin")).groupBy("bin").agg(F.count("g").alias("n"))
    return bins.join(x, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a37_product_tabs", groups_sql() + " SELECT count(*) FILTER (WHERE gap_min_pct > 2) AS above_min, count(*) FILTER (WHERE gap_min_pct <= 2) AS near_min, count(*) FILTER (WHERE gap_pct > 2) AS above_avg, count(*) FILTER (WHERE gap_pct < -2) AS below_avg FROM market")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return m.market(per(spark, d)).agg(F.count_if(F.expr("gap_min_pct > 2")).alias("above_min"), F.count_if(F.expr("gap_min_pct <= 2")).alias("near_min"), F.count_if(F.expr("gap_pct > 2")).alias("above_avg"), F.count_if(F.expr("gap_pct < -2")).alias("below_avg"))


@query("t10_top_gaps", groups_sql() + " SELECT * FROM (SELECT g, 'cheapest' AS side, round(gap_pct, 6) AS gap_pct FROM market WHERE gap_pct < 0 ORDER BY gap_pct, g LIMIT 8) UNION ALL SELECT * FROM (SELECT g, 'dearest', round(gap_pct, 6) FROM market WHERE gap_pct > 0 ORDER BY gap_pct DESC, g LIMIT 8)")
def t10(spark: SparkSession, d: str) -> DataFrame:
    x = m.market(per(spark, d))
    low = x.where("gap_pct < 0").orderBy("gap_pct", "g").limit(8).select("g", F.lit("cheapest").alias("side"), F.round("gap_pct", 6).alias("gap_pct"))
    return low.unionByName(x.where("gap_pct > 0").orderBy(F.desc("gap_pct"), "g").limit(8).select("g", F.lit("dearest").alias("side"), F.round("gap_pct", 6).alias("gap_pct")))


@query("p13_competitive_flags", matched_sql("flexible") + " SELECT ref_unit_key, coalesce(bool_and(prix >= ref_prix), true) AS competitive, bool_or(prix < ref_prix) AS undercut FROM matched GROUP BY ref_unit_key")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return m.match(listing(spark, d), REFERENCE, "flexible").groupBy("ref_unit_key").agg(F.coalesce(F.bool_and(F.col("prix") >= F.col("ref_prix")), F.lit(True)).alias("competitive"), F.bool_or(F.col("prix") < F.col("ref_prix")).alias("undercut"))


def price_sql(target: str) -> str:
    state = "CASE WHEN regexp_matches({0}, 'occas|usag|used|pre.?owned|d[ée]mo') THEN 'occasion' WHEN regexp_matches({0}, 'neuf|new') THEN 'neuf' END"
    return f"""{matched_sql('flexible')}, o AS (SELECT x.ref_unit_key AS g, x.site, x.ref_prix AS prix_ref, x.prix, {state.format('x.etat')} AS st, {state.format('r.etat')} AS rst FROM matched x JOIN listing r ON r.unit_key = x.ref_unit_key WHERE x.prix > 0 AND x.ref_prix > 0),
    low AS (SELECT g, site, any_value(prix_ref) AS prix_ref, min(CASE WHEN rst IS NULL OR st IS NULL OR st = rst THEN prix END) AS same, min(prix) AS any_ FROM o GROUP BY g, site),
    q AS (SELECT g, any_value(prix_ref) AS prix_ref, count(same) AS n, min(same) AS ms, avg(same) AS avs, min(any_) AS ma, avg(any_) AS ava FROM low GROUP BY g)
    SELECT g, CASE WHEN n > 0 THEN 'normal' ELSE 'low' END AS reliability, round(greatest(0.0, floor(({target}) * 100 + 0.5) / 100), 6) AS recommended FROM q"""


LEAST, MEAN = "CASE WHEN n > 0 THEN ms ELSE ma END", "CASE WHEN n > 0 THEN avs ELSE ava END"
for _strategy, _target in (("lowest_minus_amount", f"{LEAST} - 1"), ("market_average", MEAN), ("match_lowest", LEAST)):

    @query(f"v1_recommend_{_strategy}", price_sql(_target))
    def v1(spark: SparkSession, d: str, strategy: str = _strategy) -> DataFrame:
        rows = listing(spark, d)
        ref = rows.where(F.col("site") == REFERENCE).select(F.col("unit_key").alias("ref_unit_key"), state_family(F.col("etat")).alias("ref_state"))
        offers = m.match(rows, REFERENCE, "flexible").join(ref, "ref_unit_key").select(F.col("ref_unit_key").alias("g"), "site", F.col("ref_prix").alias("prix_ref"), "ref_state", state_family(F.col("etat")).alias("state"), "prix")
        return m.recommend(offers, strategy).select("g", "reliability", F.round("recommended", 6).alias("recommended"))


@query(
    "m0_reference_market",
    f"""{SQL}, r AS (SELECT product, avg(prix) AS my_price FROM listing WHERE site = {REFERENCE} AND prix > 0 GROUP BY product), c AS (SELECT product, avg(prix) AS a, min(prix) AS l, count(*) AS n FROM listing WHERE site <> {REFERENCE} AND prix > 0 GROUP BY product)
    SELECT product, round(my_price, 6) AS my_price, round(a, 6) AS market_avg, round(l, 6) AS market_min, n AS n_offers, round((my_price - a) / my_price * 100, 6) AS gap_pct, my_price <= a AS competitive FROM r JOIN c USING (product)""",
)
def m0(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: for each product of the reference site that others sell, own price, market average and minimum, gap, whether competitive."""
    own = F.col("site") == REFERENCE
    g = listing(spark, d).where("prix > 0").groupBy("product").agg(F.avg(F.when(own, F.col("prix"))).alias("my"), F.avg(F.when(~own, F.col("prix"))).alias("a"), F.min(F.when(~own, F.col("prix"))).alias("l"), F.count_if(~own).alias("n_offers"))
    return g.where("my is not null and n_offers > 0").select("product", F.round("my", 6).alias("my_price"), F.round("a", 6).alias("market_avg"), F.round("l", 6).alias("market_min"), "n_offers", F.round((F.col("my") - F.col("a")) / F.col("my") * 100, 6).alias("gap_pct"), (F.col("my") <= F.col("a")).alias("competitive"))
