"""Keyed merges and retention, as DataFrames that a sink then writes: no table format with MERGE is assumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_on_error: list[str] = [], status: str = "status") -> DataFrame:  # noqa: B006
    """Old rows with new ones in their place by key; where the new status is error or partial, the columns named keep their old values."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    g = both.groupBy(*keys).agg(*(F.max(F.when(F.col("_new") == k, F.struct(*rest))).alias(n) for k, n in ((0, "o"), (1, "n"))))
    failed = F.col(f"n.{status}").isin("error", "partial") & F.col("o").isNotNull()
    value = lambda c: F.when(F.col("n").isNull() | (failed if c in keep_on_error else F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return g.select(*keys, *(value(c).alias(c) for c in rest))


def latest(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group by the order columns."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a table that ``upsert_stream`` writes, in order: those that a pointer names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder)) if fs.exists(folder) else []


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last finished version, or None where there is none; one half written is not seen."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def upsert_stream(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges each micro-batch into a Parquet table: the version of the batch's number beside the one before, then an empty pointer file of that name.

    A batch that is retried after its pointer stands changes nothing; one that broke off is written anew. Every batch rewrites the table, so it suits tables of
    the size of a batch, not a log; versions before the last two go.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = versions(spark, path)
        if number in found:
            return
        old = current(spark, path)
        (batch if old is None else upsert(old, batch, keys)).write.mode("overwrite").parquet(f"{path}/v{number}")
        fs.create(path_of(f"{path}/done/{number}"), True).close()
        for gone in found[:-1]:
            fs.delete(path_of(f"{path}/done/{gone}"), False)
            fs.delete(path_of(f"{path}/v{gone}"), True)

    return write
