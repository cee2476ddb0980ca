"""Exact percentiles of groups of any size: values are counted, put in range partitions, and only the ranges that hold a wanted rank are looked at.

No group is gathered or sorted in one task, which ``percentile`` and ``median`` do with a group's distinct values. Percentiles interpolate between the two
nearest ranks. Null values count for nothing; null groups are groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept


def same(group: list[str]) -> Column:
    """One column for the group, in which nulls are equal."""
    return F.struct(*(F.struct(F.col(g).isNull(), F.col(g)) for g in group))


def percentiles(df: DataFrame, group: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """(group, n, names of ``of``): for each group the number of its values and the percentiles that ``of`` names."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = kept(counted.select(*group, "_v", "_n", same(group).alias("_g")).repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy("_g", "_range").agg(F.sum("_n").alias("_part"))
    upto, every = Window.partitionBy("_g").orderBy("_range"), Window.partitionBy("_g")
    parts = parts.select("_g", "_range", "_part", (F.sum("_part").over(upto) - F.col("_part")).alias("_before"), F.sum("_part").over(every).alias("_all"))
    # the ranks on either side of each percentile, from 0
    at = {name: F.lit(p) * (F.col("_all") - 1) for name, p in of.items()}
    wanted = [x.cast("long") for name in of for x in (F.floor(at[name]), F.ceil(at[name]))]
    holds = reduce(Column.__or__, ((F.col("_before") <= w) & (w < F.col("_before") + F.col("_part")) for w in wanted))
    few = ranged.join(parts.where(holds), ["_g", "_range"])
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_range").orderBy("_v"))
    placed = few.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))
    pick = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("_v")))
    sides = [pick(f(at[name]).cast("long")).alias(f"_{end}_{name}") for name in of for f, end in ((F.floor, "low"), (F.ceil, "high"))]
    found = placed.groupBy("_g", *group).agg(F.max("_all").alias("_all"), *sides)
    weight = {name: at[name] - F.floor(at[name]) for name in of}
    return found.select(*group, F.col("_all").alias("n"), *((F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * weight[name]).alias(name) for name in of))


def within_quartiles(df: DataFrame, group: list[str], value: str, few: int, small: int, wide: float, narrow: float) -> DataFrame:
    """The rows of df whose value lies within so many quartile ranges of its group's median (``wide`` for groups of fewer than ``small``); groups of fewer than ``few`` stay whole."""
    marks = percentiles(df, group, value, {"_low": 0.25, "_mid": 0.5, "_high": 0.75}).withColumnRenamed("n", "_n").select(same(group).alias("_g"), "_n", "_low", "_mid", "_high")
    near = F.abs(F.col(value) - F.col("_mid")) <= F.when(F.col("_n") < small, wide).otherwise(narrow) * (F.col("_high") - F.col("_low"))
    return df.withColumn("_g", same(group)).join(marks, "_g").where((F.col("_n") < few) | near).select(*df.columns)
