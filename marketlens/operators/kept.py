"""Rows that a plan reads more than once and that must be the same each time."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of ``spark.checkpoint.dir``; a temporary one where none is set on a single machine. A cluster must name one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            where = tempfile.mkdtemp(prefix="marketlens-kept-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)
