"""Queries of hit scores, addresses, configured competitors, the reference's rank and strategies by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hits, match
from .listing import REFERENCE, SQL, listing, table
from .matching import RETAIL, groups_sql, per
from .scalars import PLAIN

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- hits ----------------------------------------------------------------------------------------------------------------------------------
ASKED = hits.Asked("Blue Gear promo 12", 1997, 30_000, True, ("grande roue", "small-gear"))
#: What a hit brings beside the listing: kilometres, the search score, and whether it is approximate.
HIT = {"kilometrage": "CASE WHEN ord % 5 > 0 THEN ord % 80000 END", "score": "CASE WHEN ord % 11 > 0 THEN ord % 101 / 100.0 END", "is_approximate": "ord % 7 = 0", "shown": "CASE WHEN ord % 3 = 0 THEN concat(name, ' 19/16') ELSE name END"}
TOKENS = ("blue", "gear", "promo", "12")
TEXT = "trim(regexp_replace(regexp_replace({0}, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
MATCHES = " + ".join(f"CASE WHEN {f"regexp_matches(t, '(^|[^0-9]){w}([^0-9]|$)')" if w.isdigit() else f"contains(t, '{w}') OR contains(replace(t, ' ', ''), '{w}')"} THEN 1 ELSE 0 END" for w in TOKENS)
CLAMP = "greatest(0, least(100, floor({0} + 0.5)))"


@query(
    "q7_scored_hits",
    f"""{SQL}, h AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in HIT.items())} FROM listing), x AS (SELECT *, {TEXT.format(PLAIN.format("lower(concat_ws(' ', shown, marque, modele))"))} AS t, {TEXT.format(PLAIN.format('lower(shown)'))} AS nt FROM h), k AS (SELECT * FROM x WHERE is_approximate OR {MATCHES} >= 4),
    m AS (SELECT CASE WHEN count(*) >= 2 THEN quantile_cont(prix, 0.5) END AS middle FROM k WHERE prix > 0),
    p AS (SELECT unit_key, prix, {CLAMP.format('coalesce(score, 0) * 100')} AS a, {CLAMP.format('100 - abs(1997 - annee) * 15')} AS b, CASE WHEN etat = 'neuf' THEN 60 WHEN kilometrage IS NULL THEN 60 ELSE {CLAMP.format('100 - abs(30000 - kilometrage) / 500')} END AS c,
      {CLAMP.format("((CASE WHEN contains(nt, 'grande roue') OR contains(replace(nt, ' ', ''), 'granderoue') OR regexp_matches(nt, '19\\s*/?\\s*16') THEN 1 ELSE 0 END) + (CASE WHEN contains(nt, 'small gear') OR contains(replace(nt, ' ', ''), 'smallgear') THEN 1 ELSE 0 END)) / 2 * 100")} AS e FROM k),
    s AS (SELECT unit_key, prix, {CLAMP.format('a * (0.35 / 0.85) + b * (0.2 / 0.85) + c * (0.15 / 0.85) + e * (0.15 / 0.85)')} AS v FROM p)
    SELECT unit_key, CAST(v AS BIGINT) AS eval_score, v >= 70 AND coalesce(prix / middle - 1 <= -0.08, false) AS is_deal FROM s CROSS JOIN m""",
)
def q7(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a search for used vehicles, with the weights that count renormalised."""
    rows = listing(spark, d).select("*", *(F.expr(x).alias(c) for c, x in HIT.items())).withColumn("score", F.col("score").cast("double")).withColumn("name", F.col("shown"))
    return hits.scored_hits(rows, ASKED).select("unit_key", "eval_score", "is_deal")


# --- addresses and competitors -----------------------------------------------------------------------------------------------------------------
ADDRESS = "concat(url, CASE page_id % 9 WHEN 0 THEN '/BLOG' WHEN 1 THEN '/panier/' WHEN 2 THEN '/a/promotions/' WHEN 3 THEN '/promotion/local-1' WHEN 4 THEN '/produit/12' ELSE '' END)"


@query(
    "p6_non_product_address",
    f"SELECT page_id FROM (SELECT page_id, {ADDRESS} AS url FROM pages UNION ALL SELECT -1 - page_id, 'https://www.x.com' || CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/fr/' WHEN 2 THEN '/en' ELSE '/fr/moto' END FROM pages) WHERE "
    + " OR ".join(f"contains(lower(url), '{x}')" for x in hits.NO_PRODUCT)
    + "".join(f" OR ends_with(rtrim(lower(url), '/'), '{x}')" for x in hits.NO_PRODUCT_ENDS)
    + " OR rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') IN ('', '/fr', '/en')",
)
def p6(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    fronts = pages.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit("https://www.x.com"), F.expr("CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/fr/' WHEN 2 THEN '/en' ELSE '/fr/moto' END")).alias("url"))
    return pages.select("page_id", F.expr(ADDRESS).alias("url")).unionByName(fronts).where(hits.no_product(F.col("url"))).select("page_id")


#: What each customer has configured: a reference site and three competitors, some of them twice or the reference itself, under several spellings of a host.
SITE = "concat('https://', CASE WHEN {0} % 2 = 0 THEN 'www.' ELSE '' END, 'SITE', {0}, '.example/fr?u=', c_custkey)"
OWN, OTHERS = "c_custkey % 100", ("(c_custkey * 7 + 1) % 100", "(c_custkey + c_custkey % 2) % 100", "(c_custkey * 7 + 1) % 100")


@query(
    "j29_configured_competitors",
    f"WITH urls AS (SELECT c_custkey, unnest([0, 1, 2, 3]) AS place, unnest([{', '.join(SITE.format(f'({x})') for x in (OWN, *OTHERS))}]) AS url FROM customer), first AS (SELECT c_custkey, domain, min(place) AS place FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM urls) GROUP BY 1, 2), sites AS (SELECT 'site' || l_suppkey || '.example' AS domain, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY l_suppkey) SELECT c_custkey AS user, domain, place = 0 AS is_reference, n FROM first JOIN sites USING (domain)",
)
def j29(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's configured sites, once a host, with the number of products of those that are there."""
    config = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.expr(SITE.format(f"({OWN})")).alias("reference_url"), F.array(*(F.expr(SITE.format(f"({x})")) for x in OTHERS)).alias("competitor_urls"))
    s, li = table(spark, d, "supplier").where("s_acctbal > 0"), table(spark, d, "lineitem")
    counts = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("site"), "l_suppkey", F.lit(".example")).alias("domain"), "n")
    return hits.configured_sites(config).join(counts, "domain").select("user", "domain", "is_reference", "n")


# --- ranks and strategies ----------------------------------------------------------------------------------------------------------------------
@query("w1_reference_rank", groups_sql() + RETAIL + f", a AS (SELECT site, avg(gap) AS g FROM ret GROUP BY site) SELECT coalesce((SELECT count(*) + 1 FROM a b, a r WHERE r.site = {REFERENCE} AND (b.g < r.g OR b.g = r.g AND b.site < r.site)), 1) AS rank, greatest(count(*), 1) AS n FROM a")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return hits.rank_of_reference(match.retailers(per(spark, d), REFERENCE), REFERENCE)


RULES = {"PROMO": ("market_average", 3.0), "SMALL": ("match_lowest", None), "LARGE": ("lowest_minus_amount", -5.0), "ECONOMY": ("unknown", 7.0), "MEDIUM": ("", 9.0)}
RULES_SQL = ", ".join(f"('{t}', '{k}', {'NULL' if a is None else a})" for t, (k, a) in RULES.items())


@query("v2_strategies_by_kind", f"SELECT p_partkey, k AS strategy, CASE WHEN k = 'lowest_minus_amount' THEN CAST(greatest(0, coalesce(amount, 1.0)) AS DOUBLE) END AS amount FROM (SELECT p_partkey, CASE WHEN coalesce(key, '') = '' THEN 'lowest_minus_amount' WHEN key IN ('lowest_minus_amount', 'market_average', 'match_lowest') THEN key ELSE 'lowest_minus_amount' END AS k, CASE WHEN coalesce(key, '') = '' THEN 4.0 ELSE amount END AS amount FROM part LEFT JOIN (VALUES {RULES_SQL}) v(t, key, amount) ON t = p_type)")
def v2(spark: SparkSession, d: str) -> DataFrame:
    """Each product's strategy: that of its kind if one is set, brought into order, else the default."""
    rules = F.create_map(*(x for t, (k, a) in RULES.items() for x in (F.lit(t), F.struct(F.lit(k).alias("key"), F.lit(a).cast("double").alias("amount")))))
    rule = hits.strategy_for(rules, F.col("p_type"), F.lit("lowest_minus_amount"), F.lit(4.0))
    return table(spark, d, "part").select("p_partkey", rule["key"].alias("strategy"), rule["amount"].alias("amount"))
