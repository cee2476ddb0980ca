"""Queries of grouped products and of runs with memory: partial snapshots, locks, changes that are taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grouping, snapshots
from .listing import SQL, listing, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


#: Units with a page, a stock number and a VIN, some without, some twice, some without a price.
UNIT = {
    "url": "CASE WHEN ord % 11 > 0 THEN 'u/' || product || '/' || ord % 50 || CASE WHEN ord % 2 = 0 THEN '/' ELSE '' END ELSE '' END",
    "stock": "CASE WHEN ord % 4 > 0 THEN CAST(product % 300 AS VARCHAR(9)) END",
    "vin": "CASE WHEN ord % 3 = 0 THEN 'vin' || lpad(CAST(product % 500 AS VARCHAR(9)), 9, '0') WHEN ord % 3 = 1 THEN 'short' END",
    "prix": "CASE WHEN ord % 5 = 0 THEN NULL WHEN ord % 7 = 0 THEN 0 ELSE prix END",
    "modele": "CASE WHEN ord % 13 > 0 THEN modele ELSE ' ' END",
}


def units(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).select("site", "ord", "unit_key", "marque", "name", "annee", "etat", *(F.expr(x).alias(c) for c, x in UNIT.items()))


def grouped_sql(by_url: bool, by_stock: bool, vin_split: bool) -> str:
    model = "CASE WHEN trim(modele) <> '' THEN concat_ws('|', lower(trim(marque)), lower(trim(modele)), annee, lower(trim(etat))) ELSE concat_ws('|', 'name:' || lower(trim(name)), annee, lower(trim(etat))) END"
    key = f"CASE WHEN length(coalesce(vin, '')) >= 10 THEN 'vin:' || upper(vin) ELSE {model} END" if vin_split else model
    rows = f"(SELECT site, ord, unit_key, marque, name, annee, etat, {', '.join(f'{x} AS {c}' for c, x in UNIT.items())} FROM listing)"
    for wanted, of in ((by_url, "rtrim(coalesce(url, ''), '/')"), (by_stock, "coalesce(stock, '')")):
        if wanted:
            rows = f"(SELECT * EXCLUDE (_k, _n) FROM (SELECT *, {of} AS _k, row_number() OVER (PARTITION BY site, {of} ORDER BY ord, unit_key, prix NULLS FIRST, etat NULLS FIRST) AS _n FROM {rows}) WHERE _k = '' OR _n = 1)"
    return f"""{SQL} SELECT site, k, count(*) AS quantity, round(min(CASE WHEN prix <> 0 THEN prix END), 6) AS prix, count(*) >= 2 AS multi_unit, array_to_string(list_concat([arg_min(url, (ord, unit_key))], coalesce(list(url ORDER BY ord, unit_key) FILTER (WHERE url <> '' AND NOT lead_), [])), ',') AS urls,
    CASE WHEN count(*) >= 2 THEN array_to_string(list(unit_key ORDER BY ord, unit_key), ',') END AS units FROM (SELECT *, row_number() OVER (PARTITION BY site, k ORDER BY ord, unit_key) = 1 AS lead_ FROM (SELECT *, {key} AS k FROM {rows})) GROUP BY site, k"""


for _name, _flags in {"a1_group_products": (True, False, False), "a1_group_by_stock": (True, True, False), "a1_group_vin_split": (False, False, True)}.items():

    @query(_name, grouped_sql(*_flags))
    def a1(spark: SparkSession, d: str, flags: tuple = _flags) -> DataFrame:
        return grouping.group_products(units(spark, d), *flags).select("site", "k", "quantity", F.round("prix", 6).alias("prix"), "multi_unit", F.array_join("urls", ",").alias("urls"), F.array_join("units", ",").alias("units"))


#: Products of a site in each month, every third or so cut short, some empty.
MONTHLY = "SELECT site, CAST(year(scraped_at) * 12 + month(scraped_at) AS BIGINT) AS t, CASE WHEN (site + month(scraped_at)) % 7 < 2 THEN count(*) // 3 WHEN (site * 5 + month(scraped_at)) % 11 = 0 THEN 0 ELSE count(*) END AS n FROM listing GROUP BY site, year(scraped_at), month(scraped_at)"


@query(
    "st5_partial_gate",
    f"""{SQL.replace('WITH', 'WITH RECURSIVE', 1)}, snap AS ({MONTHLY}), seq AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t) AS rn FROM snap), r AS (SELECT DISTINCT site, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS n, '' AS status, CAST(0 AS BIGINT) AS known FROM snap
    UNION ALL SELECT site, rn, t, n, status, CASE WHEN status = 'success' THEN n ELSE known END FROM (SELECT s.site, s.rn, s.t, s.n, r.known, CASE WHEN s.n = 0 THEN 'error' WHEN r.known >= 10 AND s.n < r.known * 0.6 AND r.status <> 'partial' THEN 'partial' ELSE 'success' END AS status FROM r JOIN seq s ON s.site = r.site AND s.rn = r.rn + 1))
    SELECT site, t, n, status, known FROM r WHERE rn > 0""",
)
def st5(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.partial_gate(spark.sql(MONTHLY.replace("//", "div").replace("FROM listing", "FROM {listing}"), listing=listing(spark, d)))


@query(
    "st7_run_gate",
    """WITH RECURSIVE a AS (SELECT user_id AS key, event_id AS id, ts, CASE event_type WHEN 'view' THEN 'snapshot' WHEN 'signup' THEN 'start' WHEN 'click' THEN 'start' ELSE 'end' END AS kind FROM events WHERE event_type <> 'error'), seq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn FROM a),
    r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, '' AS outcome, false AS fresh, CAST(NULL AS TIMESTAMP) AS locked FROM a UNION ALL SELECT key, rn, id, outcome, CASE WHEN kind = 'snapshot' THEN true WHEN outcome = 'run' THEN false ELSE fresh END, CASE WHEN kind = 'end' THEN NULL WHEN outcome = 'run' THEN ts ELSE locked END FROM (
    SELECT s.key, s.rn, s.id, s.ts, s.kind, r.fresh, r.locked, CASE WHEN s.kind <> 'start' THEN '' WHEN r.locked IS NOT NULL AND s.ts - r.locked < INTERVAL 45 MINUTE THEN 'locked' WHEN NOT r.fresh THEN 'nothing new' ELSE 'run' END AS outcome FROM r JOIN seq s ON s.key = r.key AND s.rn = r.rn + 1))
    SELECT key, id, outcome FROM r WHERE outcome <> ''""",
)
def st7(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("view", "snapshot", "signup", "start", "click", "start", "purchase", "end")))
    e = table(spark, d, "events").where("event_type <> 'error'")
    return snapshots.gated_runs(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", kinds[F.col("event_type")].alias("kind")))


TAKEN = """WITH RECURSIVE ch AS (SELECT event_id AS id, user_id, event_type AS name, ts, o, v, least(o, v) AS lo, greatest(o, v) AS hi FROM (SELECT event_id, user_id, event_type, ts, CAST(floor(value / 20) AS BIGINT) AS v, lag(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS o FROM events) WHERE o IS NOT NULL),
    seq AS (SELECT *, dense_rank() OVER (ORDER BY user_id, name, lo, hi) AS g, row_number() OVER (PARTITION BY user_id, name, lo, hi ORDER BY ts, id) AS rn FROM ch), r AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS mate, CAST([] AS STRUCT(id BIGINT, ts TIMESTAMP, o BIGINT, v BIGINT)[]) AS free FROM seq
    UNION ALL SELECT g, rn, id, mate, CASE WHEN mate IS NULL THEN list_append(alive, {'id': id, 'ts': ts, 'o': o, 'v': v}) ELSE list_filter(alive, lambda x: x.id <> mate) END FROM (SELECT *, list_filter(alive, lambda x: x.o = v AND x.v = o)[1].id AS mate FROM (
    SELECT s.g, s.rn, s.id, s.ts, s.o, s.v, list_filter(r.free, lambda x: s.ts - x.ts <= INTERVAL 7 DAY) AS alive FROM r JOIN seq s ON s.g = r.g AND s.rn = r.rn + 1))),
    pairs AS (SELECT mate AS first_id, id AS second_id FROM r WHERE mate IS NOT NULL)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Steps of users' values by kind of event."""
    v = F.floor(F.col("value") / 20).cast("long")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.lit("").alias("site"), F.col("event_type").alias("name"), "ts", F.lag(v).over(w).alias("old"), v.alias("new"))


@query("j28_inverse_pairs", TAKEN + " SELECT first_id, second_id FROM pairs")
def j28(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.taken_back(changes(spark, d)).where("id < pair").select(F.col("id").alias("first_id"), F.col("pair").alias("second_id"))


@query("st12_ping_pong", TAKEN + ", gone AS (SELECT first_id AS id FROM pairs UNION SELECT second_id FROM pairs), kinds AS (SELECT DISTINCT g, o, v FROM seq JOIN gone USING (id)) SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN 'inverse pair' ELSE 'repetition' END AS reason FROM seq JOIN kinds USING (g, o, v)")
def st12(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.taken_back(changes(spark, d)).select("id", "reason")
