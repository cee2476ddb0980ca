"""Structured Streaming jobs. Each reads its table as a stream of files, runs until the input is used up, and gives the result as a DataFrame.

Results go to Parquet under the cluster's shared folder (``spark.checkpoint.dir``), as do the queries' own checkpoints.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import HOLDS_DAYS


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one where none is set on a single machine. A cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="marketlens-stream-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{where}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1000) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a single file is given through its folder and name; a table of many files is a folder already
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else _parent_of_one(spark, path))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _parent_of_one(spark: SparkSession, path: str) -> str:
    """A folder in the shared place that holds just this file: a file stream reads folders."""
    to = f"{shared_folder(spark)}/in"
    spark.read.parquet(path).write.parquet(to)
    return to


def drained(df: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    to = shared_folder(spark)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{to}/out")


def kept_last(df: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """An aggregation in update mode: every micro-batch appends what changed, and the last version of each key counts."""
    to = shared_folder(spark)
    write = lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{to}/out")
    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    out = spark.read.parquet(f"{to}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and totals of events by day and type, kept up to date batch by batch."""
    e = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    flat = g.select(F.col("window.start").alias("day"), "event_type", "n", "total")
    return kept_last(flat, spark, ["day", "event_type"]).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    """Closed sessions of each user: those that end before the watermark."""
    e = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return drained(g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"), spark)


def expiries(writes: DataFrame, delay: str, days: int = HOLDS_DAYS) -> DataFrame:
    """(key, expired, writes) of a stream of writes (key, id, ts), as ``state.expiries`` gives them: an entry is a session whose gap is the days that a write holds.

    Sessions that touch are one, and a write at the very end of an entry begins a new one, so the gap is a microsecond short and the end is put right.
    """
    own = writes.withWatermark("ts", delay).groupBy("key", F.session_window("ts", f"{days * 86_400_000_000 - 1} microseconds").alias("entry")).agg(F.count(F.lit(1)).alias("writes"))
    return own.select("key", (F.col("entry.end") + F.expr("interval 1 microsecond")).alias("expired"), "writes")
