"""Queries of running state and of views kept up to date, and of exact percentiles in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, numbering, selection
from ..operators.kept import kept
from ..streaming import jobs, state
from .listing import SQL, listing
from .runs import TAKEN
from .runs import ORACLE as BATCH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


#: How late a row of the event stream may be; what the watermark has passed is settled.
DELAY = "10 minutes"
SETTLED = "ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE {0})"


@query("st7_run_gate_stream", BATCH["st7_run_gate"].replace("WHERE event_type <> 'error')", f"WHERE event_type <> 'error' AND {SETTLED.format("event_type <> 'error'")})", 1))
def st7(spark: SparkSession, d: str) -> DataFrame:
    """Of a stream of events, what each start does, up to the watermark."""
    kinds = F.create_map(*map(F.lit, ("view", "snapshot", "signup", "start", "click", "start", "purchase", "end")))
    e = jobs.stream_of(spark, d, "events").where("event_type <> 'error'")
    attempts = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kinds[F.col("event_type")].alias("kind"))
    return state.ran(state.gated_runs(attempts, DELAY), jobs.shared_folder(spark))


@query(
    "st11_expired_entries_stream",
    """SELECT key, ends AS expired, n AS writes FROM (SELECT key, max(ts) + INTERVAL 7 DAY AS ends, count(*) AS n FROM (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts, id) AS spell FROM (
    SELECT o_custkey AS key, o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_orderdate - lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) < INTERVAL 7 DAY THEN 0 ELSE 1 END AS fresh FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) - INTERVAL 10 MINUTE FROM orders)))
    GROUP BY key, spell) WHERE ends <= (SELECT max(o_orderdate) - INTERVAL 10 MINUTE FROM orders)""",
)
def st11(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a cache that orders write: one that isn't written again for seven days expires."""
    writes = jobs.stream_of(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("key"), F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    out = state.ran(jobs.expiries(writes, DELAY), jobs.shared_folder(spark))
    return out.select("key", F.col("expired").cast("timestamp_ntz").alias("expired"), "writes")


@query(
    "j28_inverse_pairs_stream",
    TAKEN.replace("FROM events) WHERE o IS NOT NULL", f"FROM events) WHERE o IS NOT NULL AND ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL)")
    + " SELECT first_id, second_id FROM pairs",
)
def j28(spark: SparkSession, d: str) -> DataFrame:
    """Changes of users' values as a stream, those that are taken back within a week in pairs."""
    from .runs import changes

    landed = f"{jobs.shared_folder(spark)}/changes"
    changes(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    return state.ran(state.taken_back(stream, DELAY), jobs.shared_folder(spark)).where("id < pair and reason = 'inverse pair'").select(F.col("id").alias("first_id"), F.col("pair").alias("second_id"))


#: What happens to a listing: the older ones are there at first; some go, some cost less, some move to the next product; the newer ones come.
FATE = "CASE WHEN annee >= 1998 THEN 'new' WHEN ord % 10 = 0 THEN 'gone' WHEN ord % 10 = 1 THEN 'cheaper' WHEN ord % 10 = 2 THEN 'moved' ELSE 'same' END"
AFTER_PRODUCT, AFTER_PRICE = "CASE WHEN fate = 'moved' THEN product + 1 ELSE product END", "CASE WHEN fate = 'cheaper' THEN price * 0.9 ELSE price END"


@query(
    "st4_view_with_retraction",
    f"{SQL}, f AS (SELECT product, CAST(prix AS DECIMAL(18,6)) AS price, {FATE} AS fate FROM listing), x AS (SELECT {AFTER_PRODUCT} AS product, CAST({AFTER_PRICE} AS DECIMAL(18,6)) AS price FROM f WHERE fate <> 'gone') SELECT product, count(*) AS n, round(CAST(sum(price) AS DOUBLE) / count(*), 8) AS mean, CAST(min(price) AS DOUBLE) AS low, CAST(max(price) AS DOUBLE) AS high FROM x GROUP BY product",
)
def st4(spark: SparkSession, d: str) -> DataFrame:
    """The canonical aggregate after insertions, updates, deletions and listings that move, from the state before and the changes."""
    rows = listing(spark, d).select("product", F.col("prix").cast(incremental.PRICE).alias("price"), F.expr(FATE).alias("fate"))
    before, after = rows.where("fate <> 'new'"), rows.where("fate <> 'gone'").select(F.expr(AFTER_PRODUCT).alias("product"), F.expr(AFTER_PRICE).cast(incremental.PRICE).alias("price"))
    there, stays = F.col("fate") != "new", F.col("fate") != "gone"
    changes = rows.where("fate <> 'same'").select(F.when(there, F.col("product")).alias("old_product"), F.when(there, F.col("price")).alias("old_price"), F.when(stays, F.expr(AFTER_PRODUCT)).alias("new_product"), F.when(stays, F.expr(AFTER_PRICE)).alias("new_price"))
    held = kept(incremental.start(before))
    out = incremental.view(incremental.merged(held, incremental.apply(held, changes, after)))
    return out.select("product", "n", F.round("mean", 8).alias("mean"), "low", "high")


for _k in ("site", "category", "etat"):

    @query(f"a10_report_present_{_k}", f"{SQL} SELECT {_k}, count(*) AS n, round(avg(prix), 6) AS mean, round(median(prix), 6) AS median, min(prix) AS low, max(prix) AS high FROM listing WHERE prix > 0 AND prix < 500000 GROUP BY {_k}")
    def a10(spark: SparkSession, d: str, by: str = _k) -> DataFrame:
        rows = listing(spark, d).where("prix > 0 and prix < 500000").select(by, "prix")
        plain = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prix"), 6).alias("mean"), F.min("prix").alias("low"), F.max("prix").alias("high"))
        return plain.join(selection.percentiles(rows, [by], "prix", {"median": 0.5}).drop("n"), by).withColumn("median", F.round("median", 6))


@query("w12_linear_percentile", f"{SQL} SELECT product, round(quantile_cont(prix, 0.25), 6) AS p25, round(quantile_cont(prix, 0.75), 6) AS p75 FROM listing GROUP BY product")
def w12(spark: SparkSession, d: str) -> DataFrame:
    out = selection.percentiles(listing(spark, d).select("product", "prix"), ["product"], "prix", {"p25": 0.25, "p75": 0.75})
    return out.select("product", F.round("p25", 6).alias("p25"), F.round("p75", 6).alias("p75"))


@query("w13_iqr_filter", f"{SQL}, q AS (SELECT product, quantile_cont(prix, 0.25) AS a, quantile_cont(prix, 0.5) AS m, quantile_cont(prix, 0.75) AS b, count(*) AS n FROM listing GROUP BY product) SELECT unit_key FROM listing l JOIN q ON l.product = q.product WHERE n < 6 OR abs(prix - m) <= (CASE WHEN n < 10 THEN 2.5 ELSE 1.5 END) * (b - a)")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return selection.within_quartiles(listing(spark, d).select("unit_key", "product", "prix"), ["product"], "prix", 6, 10, 2.5, 1.5).select("unit_key")


@query("w4_running_count", f"{SQL} SELECT unit_key, CAST(row_number() OVER (PARTITION BY site ORDER BY scraped_at, ord, unit_key) AS INTEGER) AS n FROM listing")
def w4(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).select("unit_key", "site", "scraped_at", "ord")
    return numbering.numbered(rows, ["site"], [F.col("scraped_at"), F.col("ord"), F.col("unit_key")]).select("unit_key", F.col("n").cast("int").alias("n"))


@query("w17_spaced_sample", f"{SQL} SELECT unit_key FROM (SELECT unit_key, row_number() OVER (PARTITION BY site ORDER BY prix, unit_key) AS rn FROM listing) WHERE rn % 10 = 1")
def w17(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).select("unit_key", "site", "prix")
    return numbering.numbered(rows, ["site"], [F.col("prix"), F.col("unit_key")]).where("n % 10 = 1").select("unit_key")
