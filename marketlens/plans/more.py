"""More queries: feeds and sinks, taxonomy, pages, valuation parts, ranking and incremental rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import deep_normalize
from ..operators import html, match, merge, resolve, search, setjoin, valuation
from ..sources import readers
from ..streaming.jobs import shared_folder
from .listing import REFERENCE, SQL, listing, table
from .matching import matched_sql
from .engine import sides
from .scalars import deep, model_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- feeds: the part table, landed in each format and read back ---------------------------------------------------------------------
FEED = "SELECT p_partkey AS id, p_name AS title, CAST(p_retailprice AS DOUBLE) AS price FROM part"


def landed(spark: SparkSession, d: str, form: str, **options: str) -> str:
    """The part table written as a feed in the shared folder."""
    to = f"{shared_folder(spark)}/feed"
    table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.format(form).options(**options).save(to)
    return to


def feed(df: DataFrame) -> DataFrame:
    return readers.mapped(df, {"id": "p_partkey", "title": "p_name", "price": "p_retailprice"}, {"id": "bigint", "price": "double"})


@query("s1_parquet_source", FEED)
def s1(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark.read.parquet(landed(spark, d, "parquet")))


@query("s2_json_feed", FEED)
def s2(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark.read.schema("p_partkey long, p_name string, p_retailprice double").json(landed(spark, d, "json")))


@query("s3_xml_feed", FEED)
def s3(spark: SparkSession, d: str) -> DataFrame:
    return feed(readers.xml_feed(spark, landed(spark, d, "xml", rowTag="item"), "item", "p_partkey string, p_name string, p_retailprice string"))


@query("s4_csv_feed", FEED)
def s4(spark: SparkSession, d: str) -> DataFrame:
    return feed(readers.csv_feed(spark, landed(spark, d, "csv", header="true"), "p_partkey string, p_name string, p_retailprice string"))


@query("s24_json_backup", f"{SQL} SELECT unit_key, prix FROM listing WHERE site = 0")
def s24(spark: SparkSession, d: str) -> DataFrame:
    to = f"{shared_folder(spark)}/backup"
    listing(spark, d).where("site = 0").select("unit_key", "prix").write.json(to)
    return spark.read.schema("unit_key string, prix double").json(to)


@query("s6_landed_results", "SELECT doc_id, unnest(string_split(lang || ',' || source, ',')) AS tag FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """A landed result with an array of items, one row an item (also S7: marketplace results)."""
    items = table(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", F.array("lang", "source").alias("items"))
    return items.select("doc_id", F.explode("items").alias("tag"))


@query("s9_source_registry", "SELECT s_name, n_name AS region, 'site' || s_suppkey || '.example.com' AS domain FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def s9(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_name", F.col("n_name").alias("region"), F.concat(F.lit("site"), "s_suppkey", F.lit(".example.com")).alias("domain"))


@query("s10_inventory_scan", f"{SQL} SELECT DISTINCT site, product FROM listing WHERE NOT (disponibilite = 'O' AND etat = 'demonstrateur')")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).where("not (disponibilite = 'O' and etat = 'demonstrateur')").select("site", "product").distinct()


@query("s14_union_of_sources", "SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS price FROM orders UNION ALL SELECT 'parts', p_partkey, p_retailprice FROM part")
def s14(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return a.unionByName(table(spark, d, "part").select(F.lit("parts").alias("source"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")))


@query("s15_embedded_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s15(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return v.where("k is not null")


@query("s16_sitemap", "SELECT DISTINCT url AS loc FROM pages WHERE regexp_matches(url, '/(fr|en)/') AND NOT regexp_matches(url, '[?#&]')")
def s16(spark: SparkSession, d: str) -> DataFrame:
    to = f"{shared_folder(spark)}/sitemap"
    table(spark, d, "pages").select(F.col("url").alias("loc")).write.format("xml").options(rowTag="url", rootTag="urlset").save(to)
    return readers.sitemap(spark, to, "/(fr|en)/", "[?#&]")


@query("s17_cache_read_through", "SELECT c_custkey, coalesce(local, c_acctbal) AS bal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS local FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 6 HOUR GROUP BY o_custkey) ON o_custkey = c_custkey")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Fresh local values first, the central table's otherwise."""
    local = readers.fresh(table(spark, d, "orders"), "o_orderdate", "1998-01-01 00:00:00").groupBy("o_custkey").agg(F.max("o_totalprice").alias("local"))
    c = table(spark, d, "customer")
    return c.join(local, c["c_custkey"] == local["o_custkey"], "left").select("c_custkey", F.coalesce("local", "c_acctbal").alias("bal"))


@query("s18_snapshot_read", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey IN (1, 3, 5) AND l_linestatus = 'O'")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_suppkey").isin(1, 3, 5) & (F.col("l_linestatus") == "O")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("s19_freshness", "SELECT c_custkey, CASE WHEN latest IS NULL THEN 'missing' WHEN latest >= TIMESTAMP '1998-01-01 00:00:00' - to_days(CAST(30 + c_nationkey AS INTEGER)) THEN 'fresh' ELSE 'stale' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Fresh, stale or missing by a limit of its own for each key (also ST14)."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    c = table(spark, d, "customer")
    limit = F.expr("timestamp_ntz'1998-01-01 00:00:00' - make_dt_interval(30 + c_nationkey)")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.when(F.col("latest").isNull(), "missing").when(F.col("latest") >= limit, "fresh").otherwise("stale").alias("state"))


@query("s21_identifier_upsert", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS status, p_size AS v FROM part")
def s21(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.lit("old").alias("status"), F.col("p_size").alias("v"))
    return merge.upsert(p, p.where("v > 25").withColumn("status", F.lit("new")), ["p_partkey"])


# --- taxonomy, search and ranking -----------------------------------------------------------------------------------------------------
PATH = "CASE p_size % 4 WHEN 0 THEN 'vehicule.moto' WHEN 1 THEN 'vehicule' WHEN 2 THEN 'vehicule.moto.sport' ELSE 'maison' END"


@query("q7_score_hits", f"{SQL}, s AS (SELECT unit_key, product, prix, floor(greatest(0, least(100, 100 - abs(1997 - annee) * 15)) + 0.5) AS y, CASE WHEN contains(lower(name), 'blue') THEN 100 ELSE 0 END AS t FROM listing), m AS (SELECT product, CASE WHEN count(*) >= 2 THEN median(prix) END AS med FROM listing GROUP BY product) SELECT unit_key, CAST(floor(t * 0.6 + y * 0.4 + 0.5) AS BIGINT) AS score, floor(t * 0.6 + y * 0.4 + 0.5) >= 70 AND coalesce(prix / med - 1 <= -0.08, false) AS is_deal FROM s JOIN m USING (product)")
def q7(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    med = rows.groupBy("product").agg(F.when(F.count(F.lit(1)) >= 2, F.median("prix")).alias("med"))
    year = F.floor(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.abs(1997 - F.col("annee")) * 15)) + 0.5)
    total = F.floor(F.when(F.contains(F.lower("name"), F.lit("blue")), 100).otherwise(0) * 0.6 + year * 0.4 + 0.5)
    return rows.join(med, "product").select("unit_key", total.alias("score"), ((total >= 70) & F.coalesce(F.col("prix") / F.col("med") - 1 <= -0.08, F.lit(False))).alias("is_deal"))


@query("q1_parsed_query_search")
def q1(spark: SparkSession, d: str) -> DataFrame:
    """A free-text query, parsed on the driver, scored on the cluster."""
    q = search.parse("blue Anvil Brand#13 1997 neuf moins de 2000", ["brand#13", "brand#1"], colors=["blue", "red"])
    return search.federated(listing(spark, d), q, 0.3).select("unit_key", "score")


@query("t1_strict_first_ranking", f"{SQL} SELECT unit_key FROM listing ORDER BY CASE WHEN etat = 'neuf' THEN 0 ELSE 1 END, prix DESC, unit_key LIMIT 40")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).orderBy(F.when(F.col("etat") == "neuf", 0).otherwise(1), F.desc("prix"), "unit_key").limit(40).select("unit_key")


@query("dd2_union_dedup", matched_sql("exact") + f" SELECT kind, count(*) AS n FROM (SELECT DISTINCT unit_key, CASE WHEN l.site = {REFERENCE} THEN 'reference' WHEN x.ref_unit_key IS NULL THEN 'unmatched' ELSE 'matched' END AS kind FROM listing l LEFT JOIN (SELECT unit_key, ref_unit_key FROM matched) x USING (unit_key)) GROUP BY kind")
def dd2(spark: SparkSession, d: str) -> DataFrame:
    return match.union_of_sites(listing(spark, d), REFERENCE).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u3_jaccard_of_names", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), 6) AS jaccard FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a brand and type; names are compared once for all their parts."""
    # a name is an array here, so that parts without one have a key too
    p = table(spark, d, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.array("p_name").alias("name"))
    words = lambda name: F.split(name[0], " ")
    jaccard = lambda a, b: F.round(F.size(F.array_intersect(words(a), words(b))) / F.size(F.array_union(words(a), words(b))), 6)
    return setjoin.block_pairs(p, ["p_brand", "p_type"], "name", "jaccard", jaccard)


@query("m1_identifier_match", "SELECT l_orderkey, l_linenumber, p_partkey, 0.99 AS confidence FROM lineitem JOIN part ON upper(replace('g-' || l_partkey, '-', '')) = 'G' || p_partkey", )
def m1(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    want = F.upper(F.replace(F.concat(F.lit("g-"), "l_partkey"), F.lit("-"), F.lit("")))
    return li.join(p, want == F.concat(F.lit("G"), "p_partkey")).select("l_orderkey", "l_linenumber", "p_partkey", F.lit("0.99").cast("decimal(3,2)").alias("confidence"))


# --- scalars and valuation parts --------------------------------------------------------------------------------------------------------
@query("f10_search_tokens", f"SELECT p_partkey, regexp_extract_all({deep('p_name')}, '[a-z]+|[0-9]+') AS tokens FROM part")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.regexp_extract_all(deep_normalize(F.col("p_name")), F.lit("([a-z]+|[0-9]+)")).alias("tokens"))


def ratio_factor(r: str) -> str:
    """The mileage factor of actual over expected mileage; reads the same in both dialects. Its seven pieces."""
    return f"""CASE WHEN {r} <= 0.4e0 THEN 1.15e0 WHEN {r} < 0.7e0 THEN 1.15e0 - (({r} - 0.4e0) / 0.3e0) * 0.10e0 WHEN {r} < 1.0e0 THEN 1.05e0 - (({r} - 0.7e0) / 0.3e0) * 0.05e0 WHEN {r} < 1.2e0 THEN 1.0e0 - (({r} - 1.0e0) / 0.2e0) * 0.05e0
    WHEN {r} < 1.5e0 THEN 0.95e0 - (({r} - 1.2e0) / 0.3e0) * 0.10e0 WHEN {r} < 2.5e0 THEN 0.85e0 - (({r} - 1.5e0) / 1.0e0) * 0.15e0 ELSE 0.70e0 END"""


@query("f30_mileage_factor", f"SELECT event_id, round(CAST({ratio_factor('r')} AS DOUBLE), 9) AS factor FROM (SELECT event_id, value / 40 AS r FROM events)")
def f30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("value") / 40).alias("r")).select("event_id", F.round(F.expr(ratio_factor("r")).cast("double"), 9).alias("factor"))


@query("f22_last_price_in_text", "SELECT p_partkey, TRY_CAST(regexp_extract_all(t, '([0-9]+\\.[0-9]{2}) [$]', 1)[-1] AS DOUBLE) AS price FROM (SELECT p_partkey, concat('was ', p_size, '.99 $ now ', p_size * 2, '.50 $ each') AS t FROM part)")
def f22(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat('was ', p_size, '.99 $ now ', p_size * 2, '.50 $ each')")
    return table(spark, d, "part").select("p_partkey", F.element_at(F.regexp_extract_all(text, F.lit("([0-9]+\\.[0-9]{2}) [$]")), -1).try_cast("double").alias("price"))


@query("v2_strategy_by_type", "SELECT p_partkey, coalesce(s, 'lowest_minus_amount') AS strategy FROM part LEFT JOIN (VALUES ('PROMO', 'market_average'), ('SMALL', 'match_lowest')) v(t, s) ON t = p_type")
def v2(spark: SparkSession, d: str) -> DataFrame:
    rules = F.create_map(*map(F.lit, ("PROMO", "market_average", "SMALL", "match_lowest")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(rules[F.col("p_type")], F.lit("lowest_minus_amount")).alias("strategy"))


@query("v3_change_sheet", "SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN 1.0 ELSE floor(o_totalprice) END AS price FROM orders WHERE o_orderstatus = 'O'")
def v3(spark: SparkSession, d: str) -> DataFrame:
    """Recommended prices of the requested keys, with manual ones in their place."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    manual = table(spark, d, "orders").where("o_totalprice < 2000").select("o_orderkey", F.lit(1.0).alias("manual")).distinct()
    return o.join(manual, "o_orderkey", "left").select("o_orderkey", F.coalesce("manual", F.floor("o_totalprice").cast("double")).alias("price"))


@query("v7_non_competitive_units", matched_sql("flexible") + " SELECT count(DISTINCT CASE WHEN prix < ref_prix THEN ref_unit_key END) AS n FROM matched")
def v7(spark: SparkSession, d: str) -> DataFrame:
    return match.match(listing(spark, d), REFERENCE, "flexible").agg(F.count_distinct(F.when(F.col("prix") < F.col("ref_prix"), F.col("ref_unit_key"))).alias("n"))


@query("w1_weighted_rank", f"{SQL} SELECT site, CAST(row_number() OVER (PARTITION BY category ORDER BY a, site) AS INTEGER) AS rank, category FROM (SELECT category, site, round(avg(prix), 6) AS a FROM listing GROUP BY 1, 2)")
def w1(spark: SparkSession, d: str) -> DataFrame:
    g = listing(spark, d).groupBy("category", "site").agg(F.round(F.avg("prix"), 6).alias("a"))
    return g.select("site", F.row_number().over(Window.partitionBy("category").orderBy("a", "site")).alias("rank"), "category")


# --- pages ------------------------------------------------------------------------------------------------------------------------------
@query("h2_size_saving")
def h2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length("html").alias("n"), html.clean("html").alias("c")).select("page_id", F.round(1 - F.length("c") / F.col("n"), 6).alias("saved"))


@query("h8_numbers_in_page", "SELECT page_id, TRY_CAST(regexp_extract(html, '([0-9]+)', 1) AS BIGINT) AS first_number FROM pages WHERE length(regexp_extract(html, '([0-9]+)', 1)) BETWEEN 1 AND 15")
def h8(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract("html", "([0-9]+)", 1)
    return table(spark, d, "pages").where(F.length(found).between(1, 15)).select("page_id", found.try_cast("long").alias("first_number"))


@query("h5_repeated_blocks")
def h5(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose path keys are shared by many pages of the host: the host's template (also H4, H6, A31)."""
    keys = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.explode(html.signature("html")).alias("key"))
    return keys.groupBy("host", "key").agg(F.count_distinct("page_id").alias("n")).where("n >= 4")


# --- incremental rules in batch form -----------------------------------------------------------------------------------------------------
@query("st4_incremental_aggregate", f"{SQL} SELECT product, count(*) AS n, round(sum(prix), 4) AS total FROM listing GROUP BY product")
def st4(spark: SparkSession, d: str) -> DataFrame:
    """The aggregate of old rows merged with that of new ones: sums and counts add."""
    part = lambda test: listing(spark, d).where(test).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum("prix").alias("t"))
    return part("annee < 1998").unionByName(part("annee >= 1998")).groupBy("product").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query("v4_weighted_quartiles", f"{SQL}, x AS (SELECT product, prix, 1 + site % 3 AS w, unit_key FROM listing), r AS (SELECT *, sum(w) OVER (PARTITION BY product ORDER BY prix, unit_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rw, sum(w) OVER (PARTITION BY product) AS tw FROM x) SELECT product, min(CASE WHEN rw >= 0.25 * tw THEN prix END) AS low, min(CASE WHEN rw >= 0.75 * tw THEN prix END) AS high FROM r GROUP BY product")
def v4q(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("w", 1 + F.col("site") % 3)
    return valuation.weighted_percentiles(rows, ["product"], "prix", "w", "unit_key", {"low": 0.25, "high": 0.75})


# --- what is left of names, states and numbers --------------------------------------------------------------------------------------------
SHOWN = "concat(CASE p_size % 5 WHEN 0 THEN 'VTT ' WHEN 1 THEN 'Moto sportive ' WHEN 2 THEN 'cote a cote ' ELSE '' END, p_name, ' ', p_size, CASE p_size % 6 WHEN 0 THEN ' Noir usage a Laval' WHEN 1 THEN ' 50th anniversary' WHEN 2 THEN ' pre-commande' WHEN 3 THEN ' Rive Sud powersports' WHEN 4 THEN ' demo' ELSE '' END)"


@query("f5_product_key", f"SELECT p_partkey, {deep('p_brand')} AS brand, {model_sql(deep(SHOWN))} AS model FROM part")
def f5(spark: SparkSession, d: str) -> DataFrame:
    brand, model = t.product_key(F.concat(F.lit("Marque: "), "p_brand"), F.expr(SHOWN), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", brand.alias("brand"), model.alias("model"))


@query("f14_condition", "SELECT p_partkey, CASE WHEN regexp_matches(u, 'occasion|usag|used') THEN 'occasion' WHEN regexp_matches(u, 'neuf|new') THEN 'neuf' WHEN regexp_matches(lower(p_name), 'used|demo') THEN 'occasion' WHEN p_size * 100 > 2500 THEN 'occasion' ELSE 'neuf' END AS condition FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN '/fr/occasion/' WHEN 1 THEN '/new-bikes/' ELSE '/p/' END AS u FROM part)")
def f14(spark: SparkSession, d: str) -> DataFrame:
    url, name = F.expr("CASE p_size % 3 WHEN 0 THEN '/fr/occasion/' WHEN 1 THEN '/new-bikes/' ELSE '/p/' END"), F.lower("p_name")
    state = F.when(url.rlike("occasion|usag|used"), "occasion").when(url.rlike("neuf|new"), "neuf").when(name.rlike("used|demo"), "occasion").when(F.col("p_size") * 100 > 2500, "occasion").otherwise("neuf")
    return table(spark, d, "part").select("p_partkey", state.alias("condition"))


@query("f20_fuzzy_contains")
def f20(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.lit("blue anvill").alias("needle"), "p_name")
    return p.select("p_partkey", resolve.fuzzy_contains("needle", "p_name").alias("found"))


@query("f25_lenient_numbers", "SELECT o_orderkey, TRY_CAST(regexp_replace(s, '[^0-9.]', '', 'g') AS DOUBLE) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '$ 12.50' WHEN 1 THEN '1..2' ELSE '7 km' END AS s FROM orders)")
def f25(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '$ 12.50' WHEN 1 THEN '1..2' ELSE '7 km' END")
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace(raw, "[^0-9.]", "").try_cast("double").alias("n"))


@query("f29_clamps", "SELECT event_id, greatest(10.0::DOUBLE, least(90.0::DOUBLE, value)) AS clamped, abs(value - 50) AS off, round(pow(value / 100, 2), 9) AS squared FROM events")
def f29(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value")
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(10.0), F.least(F.lit(90.0), x)).alias("clamped"), F.abs(x - 50).alias("off"), F.round(F.pow(x / 100, F.lit(2)), 9).alias("squared"))


# --- the fuzzy stages one by one, over blocked pairs -----------------------------------------------------------------------------------------
@query("j14_m4_title_similarity")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return resolve.best(*sides(spark, d), "m4", None)


@query("j15_m5_composite")
def m5(spark: SparkSession, d: str) -> DataFrame:
    return resolve.best(*sides(spark, d), "m5", None)


@query("m4_title_similarity")
def m4_(spark: SparkSession, d: str) -> DataFrame:
    return m4(spark, d)


@query("m5_composite")
def m5_(spark: SparkSession, d: str) -> DataFrame:
    return m5(spark, d)


@query("m6_review_candidates")
def m6(spark: SparkSession, d: str) -> DataFrame:
    """Every pair at or above the candidate threshold, best first within a listing."""
    return resolve.candidates(*sides(spark, d))


@query("m2_vin_prefix", "SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, substr('JKAEX8A1' || lpad(CAST(o_orderkey % 500 AS VARCHAR), 5, '0') || 'ZZ', 1, 11) AS v FROM orders) JOIN (SELECT p_partkey, substr('JKAEX8A1' || lpad(CAST(p_partkey AS VARCHAR), 5, '0'), 1, 11) AS w FROM part) ON v = w")
def m2(spark: SparkSession, d: str) -> DataFrame:
    vin = F.concat(F.lit("JKAEX8A1"), F.lpad((F.col("o_orderkey") % 500).cast("string"), 5, "0"), F.lit("ZZ"))
    a = table(spark, d, "orders").select("o_orderkey", F.substring(vin, 1, 11).alias("v"))
    b = table(spark, d, "part").select("p_partkey", F.substring(F.concat(F.lit("JKAEX8A1"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")), 1, 11).alias("v"))
    return a.join(b, "v").select("o_orderkey", "p_partkey")


GENERIC = search.Query(words=("blue",), keywords=("gear",), brand="brand#13", sku="7", kind="promo", max_price=1000.0, state="neuf", generic=True)
G_WORDS_SQL = "0.4 * (CASE WHEN contains(p_name, 'blue') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'gear') THEN 1 ELSE 0 END) / 2"
G_FIRST = f"(CASE WHEN p_partkey = 7 THEN 0.5 WHEN contains(lower(concat_ws(' ', p_name, p_type, p_brand, p_partkey)), '7') THEN 0.3 ELSE 0 END + CASE WHEN p_brand = 'Brand#13' THEN 0.2 ELSE 0 END + {G_WORDS_SQL} + CASE WHEN p_type = 'PROMO' THEN 0.1 ELSE 0 END)"


@query("q3_generic_scores", f"SELECT p_partkey, round(least(1.0, CASE WHEN p_retailprice <= 1000 THEN {G_FIRST} + 0.1 WHEN p_retailprice > 1200 THEN {G_FIRST} * 0.5 ELSE {G_FIRST} END + CASE WHEN p_size % 2 = 0 THEN 0.05 ELSE 0 END), 6)::DOUBLE AS score FROM part")
def q3(spark: SparkSession, d: str) -> DataFrame:
    """Products without vetoes: article number, brand, words, category, price, state."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("marque"), F.col("p_retailprice").alias("prix"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'neuf' ELSE 'occasion' END").alias("etat"))
    return rows.select("p_partkey", F.round(search.score(GENERIC), 6).alias("score"))


# Free texts, and by hand what they ask for: brand, year, first and last year, least and largest price, state, colour, kind, words, keywords, generic.
ASKED = {
    "Blue Anvil Brand#13 1997 neuf moins de 2000": ("brand#13", 1997, None, None, None, 2000.0, "neuf", "blue", None, "anvil", "", False),
    "moto Kawasaky Ninja 500 2022-2024 usagé 5 000 $": ("kawasaki", None, 2022, 2024, None, 5000.0, "occasion", None, "vehicule.moto", "ninja 500", "", False),
    "Honda CRF250R entre 4k et 8k": ("honda", None, None, None, 4000.0, 8000.0, None, None, None, "crf250r", "", False),
    "casque intégral bluetooth min 100": (None, None, None, None, 100.0, None, None, None, None, "", "casque intégral bluetooth", True),
}
QUERY_TYPE = "brand string, year int, first_year int, last_year int, min_price double, max_price double, state string, color string, kind string, words string, keywords string, generic boolean"


def literal(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


@query("q8_evaluation_query", "SELECT * FROM (VALUES " + ", ".join(f"({literal(t)}, {', '.join(map(literal, x))})" for t, x in ASKED.items()) + f") v(asked, {', '.join(c.split()[0] for c in QUERY_TYPE.split(', '))})")
def q8(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for text in ASKED:
        q = search.parse(text, ["brand#13", "honda", "kawasaki"], kinds={"moto": "vehicule.moto"}, colors=["blue", "red"])
        out.append((text, q.brand, q.year, *(q.years or (None, None)), q.min_price, q.max_price, q.state, q.color, q.kind, " ".join(q.words), " ".join(q.keywords), q.generic))
    return spark.createDataFrame(out, f"asked string, {QUERY_TYPE}")


# --- pages and sources ------------------------------------------------------------------------------------------------------------------------
@query("h3_product_extraction")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.extracted("html").alias("x")).select("page_id", "x.*")


@query("h4_listing_extraction")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(html.items("html")).alias("x")).select("page_id", "x.*")


@query("h9_vehicle_rows")
def h9(spark: SparkSession, d: str) -> DataFrame:
    """Items of a page that state a year or a price."""
    return h4(spark, d).where("year is not null or price is not null")


@query("s7_marketplace_results", "SELECT conv_id, turn, role FROM conversations WHERE text <> ''")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Results that landed nested by query, one row a result."""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("results"))
    return nested.select("conv_id", F.explode("results").alias("r")).where("r.text <> ''").select("conv_id", "r.turn", "r.role")


@query("st14_fresher_source", "SELECT c_custkey, CASE WHEN latest IS NOT NULL THEN 'orders' ELSE 'central' END AS source FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_custkey) ON o_custkey = c_custkey")
def st14(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    c = table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.when(F.col("latest").isNotNull(), "orders").otherwise("central").alias("source"))
