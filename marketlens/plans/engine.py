"""Queries of the generic table query, change detection, valuation, entity resolution, search scoring, page extraction, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import deep_normalize, title_key
from ..functions.vocab import TITLE_NOISE
from ..operators import changes, html, merge, resolve, search, table_query, valuation
from ..operators.contents import by_content
from ..sources import readers
from ..streaming import jobs
from .listing import SQL, listing, table
from .scalars import PLAIN, depreciation_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- generic table query ----------------------------------------------------------------------------------------------------------
@query("p24_table_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority ILIKE '%high%' AND o_orderstatus IN ('F', 'O') AND o_custkey <> 7 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 200 OFFSET 5")
def p24(spark: SparkSession, d: str) -> DataFrame:
    filters = {"o_totalprice": "gte.1000", "o_orderpriority": "ilike.*high*", "o_orderstatus": "in.(F,O)", "o_custkey": "neq.7"}
    return table_query.query(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], filters, "o_totalprice.desc,o_orderkey.asc", 200, 5)


@query("t19_ordered_query", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY c_acctbal ASC NULLS LAST, c_custkey DESC LIMIT 100")
def t19(spark: SparkSession, d: str) -> DataFrame:
    return table_query.query(table(spark, d, "customer"), ["c_custkey", "c_acctbal"], {"c_mktsegment": "not.is.null"}, "c_acctbal.asc.nullslast,c_custkey.desc")


@query("a51_count_rows", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N'")
def a51(spark: SparkSession, d: str) -> DataFrame:
    return table_query.count_rows(table(spark, d, "lineitem"), {"l_quantity": "gt.25", "l_returnflag": "eq.N"})


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("s26_catalog", "SELECT table_name, count(*) AS n_columns FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") GROUP BY table_name")
def s26(spark: SparkSession, d: str) -> DataFrame:
    return table_query.catalog(spark, {t: table(spark, d, t) for t in TABLES})


@query("s27_describe_table", "SELECT column_name, CAST(row_number() OVER (ORDER BY column_index) - 1 AS INTEGER) AS position, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, column_name IN ('l_orderkey', 'l_linenumber') AS required, column_name IN ('l_orderkey', 'l_linenumber') AS pk, CASE WHEN column_name = 'l_discount' THEN '0' END AS default_value FROM duckdb_columns() WHERE table_name = 'lineitem'")
def s27(spark: SparkSession, d: str) -> DataFrame:
    return table_query.describe(spark, table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"), {"l_discount": "0"})


# --- changes ------------------------------------------------------------------------------------------------------------------------
def snapshot(spark: SparkSession, d: str, year: int) -> DataFrame:
    """Units of a year: (site, product) with its lowest price and its last status."""
    rows = listing(spark, d).where(F.col("annee") == year)
    return rows.groupBy("site", F.col("product").cast("string").alias("unit_key")).agg(F.min("prix").alias("prix"), F.max("disponibilite").alias("disponibilite"))


SNAP = "(SELECT site, CAST(product AS VARCHAR) AS unit_key, min(prix) AS prix, max(disponibilite) AS disponibilite FROM listing WHERE annee = {0} GROUP BY site, product)"
CHANGES = f"""{SQL}, c AS {SNAP.format(1998)}, p AS {SNAP.format(1997)}, q AS {SNAP.format(1996)}, ch AS (
 SELECT site, unit_key, CASE WHEN c.prix > p.prix THEN 'price_increase' ELSE 'price_decrease' END AS change_type, p.prix AS old_value, c.prix AS new_value, (c.prix - p.prix) / p.prix * 100 AS pct FROM c JOIN p USING (site, unit_key) WHERE p.prix >= 1 AND c.prix >= 1 AND p.prix <> c.prix AND abs((c.prix - p.prix) / p.prix * 100) >= 2 AND abs(c.prix - p.prix) >= 5
 UNION ALL SELECT site, unit_key, 'new_product', NULL, prix, NULL FROM c WHERE prix >= 1 AND (site, unit_key) NOT IN (SELECT site, unit_key FROM p) AND (site, unit_key) NOT IN (SELECT site, unit_key FROM q)
 UNION ALL SELECT site, unit_key, 'removed_product', prix, NULL, NULL FROM q WHERE prix >= 1 AND (site, unit_key) NOT IN (SELECT site, unit_key FROM p) AND (site, unit_key) NOT IN (SELECT site, unit_key FROM c)
 UNION ALL SELECT site, unit_key, 'stock_change', NULL, NULL, NULL FROM c JOIN p USING (site, unit_key) WHERE lower(trim(c.disponibilite)) <> lower(trim(p.disponibilite)))"""


def detected(spark: SparkSession, d: str) -> DataFrame:
    return changes.detect(snapshot(spark, d, 1996), snapshot(spark, d, 1997), snapshot(spark, d, 1998), 2.0, 5.0)


@query("st1_change_detection", CHANGES + " SELECT site, unit_key, change_type, old_value, new_value, round(pct, 6) AS pct FROM ch")
def st1(spark: SparkSession, d: str) -> DataFrame:
    return detected(spark, d).withColumn("pct", F.round("pct", 6))


# Every fifth product is posted anew each year, so its key changes and its name stays; every seventh lists several units from 1998 on.
KEY = "CASE WHEN product % 5 = 0 THEN concat(product, '@', annee) ELSE CAST(product AS STRING) END"
NAMED = "(SELECT site, " + KEY.replace("STRING", "VARCHAR") + " AS unit_key, min(prix) AS prix, max(disponibilite) AS disponibilite, min(lower(name)) AS k, bool_or(product % 7 = 0 AND annee >= 1998) AS multi FROM listing WHERE annee = {0} GROUP BY 1, 2)"
NAMED_CHANGES = f"""{SQL}, c AS (SELECT * FROM {NAMED.format(1998)}), p AS (SELECT * FROM {NAMED.format(1997)}), q AS (SELECT * FROM {NAMED.format(1996)}),
 ln AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY site, k ORDER BY unit_key DESC) = 1),
 cp AS (SELECT c.*, coalesce(p.prix, CASE WHEN again THEN ln.prix END) AS old, coalesce(p.disponibilite, CASE WHEN again THEN ln.disponibilite END) AS was, CASE WHEN p.unit_key IS NOT NULL THEN p.multi ELSE ln.multi END AS pm, p.unit_key IS NOT NULL OR again AS paired, ln.unit_key IS NOT NULL AND NOT ln.multi AS single
   FROM (SELECT c.*, coalesce(p.unit_key IS NULL AND NOT c.multi AND NOT ln.multi AND (ln.site, ln.unit_key) NOT IN (SELECT site, unit_key FROM c), false) AS again FROM c LEFT JOIN p USING (site, unit_key) LEFT JOIN ln ON ln.site = c.site AND ln.k = c.k) c LEFT JOIN p USING (site, unit_key) LEFT JOIN ln ON ln.site = c.site AND ln.k = c.k),
 ch AS (SELECT site, unit_key, CASE WHEN prix > old THEN 'price_increase' ELSE 'price_decrease' END AS change_type, old AS old_value, prix AS new_value FROM cp WHERE paired AND NOT (multi AND NOT pm) AND old >= 1 AND prix >= 1 AND old <> prix AND abs((prix - old) / old * 100) >= 2 AND abs(prix - old) >= 5
 UNION ALL SELECT site, unit_key, 'new_product', NULL, prix FROM cp WHERE NOT paired AND prix >= 1 AND NOT (multi AND single) AND (site, unit_key) NOT IN (SELECT site, unit_key FROM q)
 UNION ALL SELECT site, unit_key, 'removed_product', prix, NULL FROM q WHERE prix >= 1 AND (site, unit_key) NOT IN (SELECT site, unit_key FROM p) AND (site, unit_key) NOT IN (SELECT site, unit_key FROM c) AND NOT (NOT multi AND (site, k) IN (SELECT site, k FROM c))
 UNION ALL SELECT site, min(unit_key), 'stock_change', NULL, NULL FROM cp WHERE paired AND lower(trim(disponibilite)) <> lower(trim(was)) GROUP BY site, k)"""


@query("j7_snapshot_diff", NAMED_CHANGES + " SELECT site, unit_key, change_type, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value FROM ch")
def j7(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("unit_key", F.expr(KEY))

    def year(y: int) -> DataFrame:
        own = rows.where(F.col("annee") == y).groupBy("site", "unit_key")
        return own.agg(F.min("prix").alias("prix"), F.max("disponibilite").alias("disponibilite"), F.min("name").alias("name"), F.expr("bool_or(product % 7 = 0 and annee >= 1998)").alias("multi"))

    found = changes.detect(year(1996), year(1997), year(1998), 2.0, 5.0)
    return found.select("site", "unit_key", "change_type", F.round("old_value", 6).alias("old_value"), F.round("new_value", 6).alias("new_value"))


HISTORY = f"""{SQL}, s AS (SELECT site, CAST(product AS VARCHAR) AS unit_key, annee AS t, min(prix) AS prix FROM listing GROUP BY site, product, annee), x AS (SELECT site, t, lag(t) OVER (PARTITION BY site ORDER BY t) AS b FROM (SELECT DISTINCT site, t FROM s)),
 y AS (SELECT s.*, lag(t) OVER w AS lt, lag(prix) OVER w AS lp FROM s WHERE prix >= 1 WINDOW w AS (PARTITION BY site, unit_key ORDER BY t)), z AS (SELECT y.site, unit_key, y.t, prix, CASE WHEN lt = b THEN lp END AS previous FROM y JOIN x ON x.site = y.site AND x.t = y.t)"""


@query("st2_price_history", HISTORY + " SELECT *, CASE WHEN previous IS NULL THEN 'baseline' ELSE 'price_change' END AS change_type FROM z WHERE previous IS NULL OR previous <> prix")
def st2(spark: SparkSession, d: str) -> DataFrame:
    snaps = listing(spark, d).groupBy("site", F.col("product").cast("string").alias("unit_key"), F.col("annee").alias("t")).agg(F.min("prix").alias("prix"))
    return changes.price_history(snaps)


# --- valuation ----------------------------------------------------------------------------------------------------------------------
def left(age: str) -> str:
    return depreciation_sql("powersport").replace("age", f"({age})")


# Premiums of options, and what the query's offers and targets state beside the listing's columns; reads the same in both dialects.
PREMIUMS = {"abs": 40.0, "sport": 400.0}
OFFER = ["CASE WHEN ord % 7 = 0 THEN NULL ELSE (ord % 61) * 1000 END AS kilometrage", "CASE ord % 3 WHEN 0 THEN array('abs') WHEN 1 THEN array('abs', 'sport') END AS options", "(ord % 10) / 10 AS score"]
TARGET = ["p_partkey AS product", "CASE WHEN p_partkey % 5 > 0 THEN 1998 END AS target_year", "CASE WHEN p_partkey % 4 > 0 THEN 'occasion' ELSE 'neuf' END AS target_state", "CASE WHEN p_partkey % 3 > 0 THEN 15000 END AS target_km", "CASE p_partkey % 6 WHEN 0 THEN array('abs') WHEN 1 THEN array('sport', 'heat') END AS target_options"]


def duck(columns: list[str]) -> str:
    return ", ".join(columns).replace("array(", "list_value(")


def ages(year: str) -> str:
    return f"greatest(0, 2003 - {year})"


def km_factor(r: str) -> str:
    return f"(CASE WHEN {r} <= 0.4 THEN 1.15 WHEN {r} < 0.7 THEN 1.15 - ({r} - 0.4) / 0.3 * 0.10 WHEN {r} < 1 THEN 1.05 - ({r} - 0.7) / 0.3 * 0.05 WHEN {r} < 1.2 THEN 1 - ({r} - 1) / 0.2 * 0.05 WHEN {r} < 1.5 THEN 0.95 - ({r} - 1.2) / 0.3 * 0.1 WHEN {r} < 2.5 THEN 0.85 - ({r} - 1.5) * 0.15 ELSE 0.7 END)"


@query(
    "v4_evaluate_value",
    f"""{SQL}, offer AS (SELECT *, {duck(OFFER)} FROM listing WHERE prix > 0),
    once AS (SELECT * FROM offer QUALIFY row_number() OVER (PARTITION BY product, name, floor(prix / 100 + 0.5), site ORDER BY ord, unit_key) = 1),
    target AS (SELECT {duck(TARGET)} FROM part),
    near AS (SELECT *, coalesce(options, []) AS has, coalesce(target_options, []) AS asked, len(asked) > 0 AND len(list_filter(asked, lambda o: NOT list_contains(has, o))) = 0 AS fits FROM once JOIN target USING (product) WHERE coalesce(abs(annee - target_year) <= 3, true)),
    fitting AS (SELECT *, CASE WHEN etat = 'neuf' THEN 'neuf' WHEN etat = 'occasion' THEN 'occasion' WHEN kilometrage <= 500 THEN 'neuf' END AS state FROM (SELECT *, count(*) FILTER (WHERE fits) OVER (PARTITION BY product) AS fit FROM near) WHERE fit < 3 OR fits),
    rated AS (SELECT *, coalesce(kilometrage, CASE WHEN state = 'neuf' THEN 0 END) / (greatest(0.5, {ages('annee')}) * 5000)::DOUBLE AS r, target_km / (greatest(0.5, {ages('coalesce(target_year, annee)')}) * 5000)::DOUBLE AS tr FROM fitting),
    factors AS (SELECT *, CASE WHEN target_year IS NULL THEN 1.0 ELSE ({left('2003 - target_year')}) / ({left('2003 - annee')}) END AS fy, CASE WHEN tr IS NULL THEN 1.0::DOUBLE ELSE {km_factor('tr')} / (CASE WHEN r IS NULL THEN 1.0::DOUBLE ELSE {km_factor('r')} END) END AS fk, CASE WHEN state = 'neuf' AND target_state = 'occasion' THEN 0.82 WHEN state = 'occasion' AND target_state = 'neuf' THEN 1 / 0.82 ELSE 1 END::DOUBLE AS fs,
      CASE WHEN list_contains(asked, 'abs') AND NOT list_contains(has, 'abs') THEN 40 ELSE 0 END + CASE WHEN list_contains(asked, 'sport') AND NOT list_contains(has, 'sport') THEN 400 ELSE 0 END AS extra FROM rated),
    near2 AS (SELECT product, unit_key, site, round(greatest(prix * 0.1, least(prix * (CASE WHEN state = 'neuf' AND target_state = 'occasion' THEN 0.95 ELSE 1.2 END), prix * fy * (CASE WHEN abs(fk - 1) <= 0.005 THEN 1 ELSE fk END) * fs + least(prix * 0.3, extra))), 6) AS v,
      CAST(round(greatest(0.05, 0.42 * score + 0.23 * (CASE WHEN target_year IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(annee - target_year) / 3) END) + 0.15 * (CASE WHEN r IS NULL OR tr IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(tr - r) / 1.5) END) + 0.12 * (CASE WHEN len(asked) = 0 THEN 0.5 ELSE len(list_filter(asked, lambda o: list_contains(has, o))) / len(asked) END) + 0.08 * (CASE WHEN state IS NULL THEN 0.75 WHEN state = target_state THEN 1 ELSE 0.65 END)) * 1e6) AS BIGINT) AS w FROM factors),
    q AS (SELECT product, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b, count(*) AS n FROM near2 GROUP BY product), kept AS (SELECT near2.* FROM near2 JOIN q USING (product) WHERE n < 6 OR abs(v - m) <= (CASE WHEN n < 10 THEN 2.5 ELSE 1.5 END) * (b - a) + 1e-6),
    r AS (SELECT *, sum(w) OVER (PARTITION BY product ORDER BY v, unit_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rw, sum(w) OVER (PARTITION BY product) AS tw FROM kept),
    p AS (SELECT product, min(CASE WHEN rw >= 0.25 * tw THEN v END) AS lo, min(CASE WHEN rw >= 0.5 * tw THEN v END) AS mid, min(CASE WHEN rw >= 0.75 * tw THEN v END) AS hi, count(*) AS n_used, count(DISTINCT site) AS n_sources FROM r GROUP BY product),
    e AS (SELECT *, least(lo, mid * 0.9) AS low, greatest(hi, mid * 1.1) AS high FROM p)
    SELECT product, CASE WHEN n_used >= 3 THEN round(low, 8) END AS low, CASE WHEN n_used >= 3 THEN round(mid, 8) END AS median, CASE WHEN n_used >= 3 THEN round(high, 8) END AS high, n_used, n_sources,
      CASE WHEN n_used < 3 THEN 'insufficient' WHEN n_used < 4 OR (high - low) / mid > 0.25 OR n_sources < 2 THEN 'low' WHEN n_used >= 8 AND (high - low) / mid < 0.1 AND n_sources >= 4 THEN 'good' ELSE 'indicative' END AS reliability FROM e""",
)
def v4(spark: SparkSession, d: str) -> DataFrame:
    offers, targets = listing(spark, d).selectExpr("*", *OFFER), table(spark, d, "part").selectExpr(*TARGET)
    worth = valuation.evaluate(offers, targets, 2003, PREMIUMS)
    return worth.select("product", *(F.round(c, 8).alias(c) for c in ("low", "median", "high")), "n_used", "n_sources", "reliability")


@query("v6_variant_detection", "SELECT p_partkey, list_filter(['anvil', 'bolt', 'gear'], lambda w: regexp_matches(lower(p_name), '\\b' || w || '\\b')) AS variants FROM part")
def v6(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("anvil", "bolt", "gear")))
    return table(spark, d, "part").select("p_partkey", F.filter(words, lambda w: F.regexp_like(F.lower("p_name"), F.concat(F.lit(r"\b"), w, F.lit(r"\b")))).alias("variants"))


# --- entity resolution --------------------------------------------------------------------------------------------------------------
def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts offered under a changed name, every tenth by a brand that the catalogue hasn't, and the catalogue, which is as large as the part table."""
    new = lambda name: F.concat_ws(" ", F.lit("new"), name, F.lit("for sale"))
    titles = lambda names: names.withColumns({"l_title": title_key(new(F.col("_name"))), "c_title": title_key(F.col("_name"))})
    p = by_content(table(spark, d, "part"), {"_name": F.col("p_name")}, titles, ["l_title", "c_title"])
    specs = lambda size: F.create_map(F.lit("size"), size.cast("string"), F.lit("type"), F.col("p_type"))
    side = lambda x, brand, model, size: p.select(F.col("p_partkey").alias(f"{x}_id"), brand.alias(f"{x}_brand"), model.alias(f"{x}_model"), size.alias(f"{x}_year"), f"{x}_title", F.lower("p_type").alias(f"{x}_category"), specs(size).alias(f"{x}_specs"))
    model, size = F.lower(F.concat_ws(" ", "p_name", "p_size")), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).otherwise(F.col("p_size") + 1)
    brand = F.when(F.col("p_partkey") % 10 == 0, "nobody").otherwise(F.lower("p_brand"))
    return side("l", brand, F.concat(model, F.lit("x")), size), side("c", F.lower("p_brand"), model, F.col("p_size"))


def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best match of each listing."""
    return resolve.best(*sides(spark, d))


@query("m3_m5_resolution_cascade")
def m35(spark: SparkSession, d: str) -> DataFrame:
    return best_matches(spark, d)


@query("m7_ingest_routing")
def m7(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with what ingestion does; those whose id is a multiple of 7 exist already."""
    listings, catalog = sides(spark, d)
    ids = listings.select("l_id")
    return resolve.route(ids, resolve.best(listings, catalog), ids.where("l_id % 7 = 0"))


M8_TITLE = f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace({PLAIN.format('lower(t)')}, '\\$[0-9,]+\\.?[0-9]*', '', 'g'), '[^a-z0-9_\\s\\-.]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in TITLE_NOISE) + ")), ' ')"


@query("m8_listing_normalisation", f"{SQL} SELECT DISTINCT product, {M8_TITLE} AS title FROM (SELECT product, concat('The ', name, ' (new)') AS t FROM listing)")
def m8(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).select("product", "name").distinct().select("product", title_key(F.concat(F.lit("The "), "name", F.lit(" (new)"))).alias("title"))


# --- search -------------------------------------------------------------------------------------------------------------------------
QUERY = search.Query(words=("blue", "anvil"), brand="brand#13", year=1997, max_price=2000.0, state="neuf", min_price=950.0, color="red", keywords=("bolt", "gear"))
HAS_BRAND = "(lower(marque) = 'brand#13' OR contains(lower(name), 'brand#13'))"
SHARE = "(CASE WHEN contains(lower(name), '{0}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), '{1}') THEN 1 ELSE 0 END) / 2"


def score_sql(year: str) -> str:
    """Points in their order: brand, year and model, then price, colour, state and keywords."""
    first = f"(CASE WHEN {HAS_BRAND} THEN 0.3 ELSE 0 END + {year} + 0.3 * {SHARE.format('blue', 'anvil')})"
    priced = f"(CASE WHEN prix BETWEEN 950 AND 2000 THEN {first} + 0.1 WHEN prix > 2200 THEN {first} * 0.5 ELSE {first} END + CASE WHEN contains(lower(name), 'red') THEN 0.05 ELSE 0 END)"
    return f"least(1.0, CASE WHEN etat = 'neuf' THEN {priced} + 0.05 ELSE {priced} * 0.7 END + 0.05 * {SHARE.format('bolt', 'gear')})"


SCORE_SQL = f"CASE WHEN NOT {HAS_BRAND} OR abs(annee - 1997) > 1 THEN 0.0 ELSE {score_sql('CASE WHEN annee = 1997 THEN 0.2 ELSE 0.1 END')} END"
LOOSE_SQL = f"{score_sql('CASE abs(annee - 1997) WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 ELSE greatest(0.0, 0.05 - (abs(annee - 1997) - 2) * 0.005) END')} * CASE WHEN {HAS_BRAND} THEN 1.0 ELSE 0.5 END"


@query("q4_relaxed_search", f"{SQL}, s AS (SELECT *, round({SCORE_SQL}, 6) AS st, round({LOOSE_SQL}, 6) AS lo FROM listing), o AS (SELECT *, max(CASE WHEN st >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY site) = 1 AS a FROM s) SELECT unit_key, CAST(CASE WHEN a THEN st ELSE lo END AS DOUBLE) AS score, NOT a AS is_approximate FROM o WHERE CASE WHEN a THEN st >= 0.6 ELSE lo >= 0.3 END")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return search.strict_or_relaxed(listing(spark, d), QUERY, 0.6).select("unit_key", "score", "is_approximate")


@query("q2_search_scores", f"{SQL} SELECT unit_key, CAST(round({SCORE_SQL}, 6) AS DOUBLE) AS score FROM listing")
def q2(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).select("unit_key", F.round(search.score(QUERY), 6).alias("score"))


@query("q5_federated_search", f"{SQL}, s AS (SELECT *, CAST(round({SCORE_SQL}, 6) AS DOUBLE) AS score FROM listing), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, ord, unit_key) AS rn FROM s WHERE score >= 0.4) SELECT unit_key, score FROM k WHERE rn <= 3 ORDER BY score DESC, unit_key LIMIT 50")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return search.federated(listing(spark, d), QUERY, per_source=3, limit=50).select("unit_key", "score")


# --- pages --------------------------------------------------------------------------------------------------------------------------
@query("h1_clean_html")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.clean("html").alias("cleaned")).select("page_id", F.length("cleaned").alias("n_chars"), F.md5("cleaned").alias("digest"))


@query("h6_dom_signatures")
def h6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(html.signature("html")).alias("key"))


# --- sources, sinks, streams ----------------------------------------------------------------------------------------------------------
@query("s5_column_mapping", "SELECT p_partkey AS id, p_name AS raw_title, p_brand AS raw_brand, TRY_CAST(p_retailprice AS DOUBLE) AS price FROM part")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return readers.mapped(table(spark, d, "part"), {"id": "p_partkey", "raw_title": "p_name", "raw_brand": "p_brand", "price": "p_retailprice"}, {"price": "double"})


@query("s12_union_of_seeds", f"{SQL} SELECT DISTINCT product FROM listing WHERE category IN ('PROMO', 'SMALL')")
def s12(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    return readers.union_of([rows.where(F.col("category") == c) for c in ("PROMO", "SMALL")], ["product"]).select("product")


@query("s20_upsert_sink", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE s_acctbal + 1 END AS value FROM supplier")
def s20(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    old = s.select("s_suppkey", F.lit("success").alias("status"), F.col("s_acctbal").alias("value"))
    new = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "error").otherwise("success").alias("status"), (F.col("s_acctbal") + 1).alias("value"))
    return merge.upsert(old, new, ["s_suppkey"], keep_on_error=["value"])


@query("s22_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def s22(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).select("o_orderkey")


@query("s23_pivot_export", f"{SQL} SELECT product, min(prix) FILTER (WHERE etat = 'neuf') AS neuf, min(prix) FILTER (WHERE etat = 'occasion') AS occasion, min(prix) FILTER (WHERE etat = 'demonstrateur') AS demonstrateur FROM listing GROUP BY product")
def s23(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).groupBy("product").pivot("etat", ["neuf", "occasion", "demonstrateur"]).agg(F.min("prix"))


def named_parts(spark: SparkSession, d: str) -> DataFrame:
    """(key, brand, n) of the parts, names made plain once each."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), "p_name")
    return by_content(p, {"_name": F.col("p_name")}, lambda names: names.withColumn("n", deep_normalize(F.col("_name"))), ["n"]).select("key", "brand", "n")


@query("j13_similarity_join")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return resolve.similar_pairs(named_parts(spark, d), 0.6, 6).withColumnRenamed("r", "ratio")


@query("j13_similarity_classes")
def j13c(spark: SparkSession, d: str) -> DataFrame:
    """The same links between a brand's distinct names, each under the least key that has it, and which keys share a name."""
    return resolve.similar_classes(named_parts(spark, d), 0.6).select("a", "b", F.round("r", 6).alias("ratio"), "kind")


@query("st9_stream_tumbling", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st9(spark: SparkSession, d: str) -> DataFrame:
    return jobs.tumbling(spark, d)


@query("st10_stream_sessions")
def st10(spark: SparkSession, d: str) -> DataFrame:
    return jobs.sessions(spark, d)


@query("w3_last_by_window", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def w3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts")))).where("rn = 1").select("user_id", F.col("ts").alias("last_seen"))
