"""Row numbers within groups of any size: rows are cut into ranges of the group's order, numbered within them, and the ranges' counts summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept
from .selection import same


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """Adds each row's number, from 1, in its group by the order; no task sorts a group whole."""
    own = kept(rows.withColumn("_g", same(group)).repartitionByRange("_g", *order).withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy("_g").orderBy("_range")
    counts = own.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_part"))
    before = counts.select("_g", "_range", (F.sum("_part").over(upto) - F.col("_part")).alias("_before"))
    within = own.withColumn("_at", F.row_number().over(Window.partitionBy("_g", "_range").orderBy(*order)))
    return within.join(before, ["_g", "_range"]).withColumn(name, F.col("_before") + F.col("_at")).select(*rows.columns, name)
