"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the contracts: space and U+0009 to U+000D. ``bytes.split()`` cuts at the same six bytes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it. Where neither the session nor its context has one, a temporary folder is set on a single machine; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            where = tempfile.mkdtemp(prefix="marketlens-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage is cut, and the rows survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys with this many rows, and a share of all rows, are joined apart.
HOT_ROWS, HOT_SHARE = 100_000, 10_000


def joined(many: DataFrame, one: DataFrame, key: str, rows: int) -> DataFrame:
    """``many`` joined by key with ``one``, which has a row for each key and counts its rows in ``many`` in a column n; ``rows`` is about the number of all.

    Keys with more than HOT_ROWS rows and one in HOT_SHARE of all, at most HOT_SHARE of them, are joined by broadcast, so that no task takes such a key whole.
    """
    least = max(HOT_ROWS, rows // HOT_SHARE)
    if rows <= least:
        return many.join(one.drop("n"), key)
    hot = one.where(F.col("n") > least).drop("n")
    if hot.isEmpty():
        return many.join(one.drop("n"), key)
    few, rest = F.broadcast(hot), one.where(F.col("n") <= least).drop("n")
    return many.join(few, key).unionByName(many.join(few.select(key), key, "left_anti").join(rest, key))


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8 bytes, none decoded."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each has about ``most`` bytes of text, or one longer text: memory stays bounded by bytes, not by rows."""
    for batch in batches:
        column = batch.column(name)
        size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(size)
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mapped(df: DataFrame, of_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, name: str = "text", most: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` of a function of one batch of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name, most):
            if (out := of_batch(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
