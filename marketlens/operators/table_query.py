"""The generic table query: a table, columns, a small filter language, order, limit and offset; also counts and the catalogue.

A filter is ``column -> "op.value"`` with eq, neq, gt, gte, lt, lte, like, ilike, in.(a,b), is.null and not.is.null; filters are AND-ed. Values are
compared in the column's own type. Everything becomes one DataFrame plan, so filters and columns reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows by default and at most.
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000

COMPARE = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def pattern(value: str) -> str:
    return value.replace("*", "%")


def predicate(df: DataFrame, column: str, test: str) -> Column:
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    kind, x = dict(df.dtypes)[column], F.col(column)
    if test in ("is.null", "not.is.null"):
        return x.isNull() if test == "is.null" else x.isNotNull()
    op, dot, value = test.partition(".")
    if op in COMPARE and dot:
        return getattr(x, COMPARE[op])(F.lit(value).cast(kind))
    if op == "like":
        return x.like(pattern(value))
    if op == "ilike":
        return x.ilike(pattern(value))
    if op == "in" and (m := re.fullmatch(r"\((.*)\)", value)):
        return x.isin([F.lit(v.strip()).cast(kind) for v in m[1].split(",")])
    raise ValueError(f"no such filter: {test}")


def ordered(df: DataFrame, order: str) -> DataFrame:
    """``price.desc,scraped_at.asc.nullslast``; nulls stand last ascending and first descending unless told."""
    keys = []
    for part in order.split(","):
        column, *words = part.split(".")
        down = "desc" in words
        last = "nullslast" in words or ("nullsfirst" not in words and not down)
        keys.append(getattr(F.col(column), f"{'desc' if down else 'asc'}_nulls_{'last' if last else 'first'}")())
    return df.orderBy(*keys)


def filtered(df: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    for column, test in (filters or {}).items():
        df = df.where(predicate(df, column, test))
    return df


def query(df: DataFrame, select: list[str] | None = None, filters: dict[str, str] | None = None, order: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    df = filtered(df, filters)
    df = ordered(df, order) if order else df
    df = df.offset(offset) if offset else df
    return df.limit(max(1, min(MAX_LIMIT, limit))).select(*(select or df.columns))


def count_rows(df: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    return filtered(df, filters).agg(F.count(F.lit(1)).alias("n"))


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Tables and their numbers of columns, by name."""
    return spark.createDataFrame([(name, len(df.columns)) for name, df in sorted(tables.items())], "table_name string, n_columns long")


def describe(spark: SparkSession, df: DataFrame, keys: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Columns with type, place, whether a value is required (part of the key, or not nullable), whether part of the primary key, and the default."""
    rows = [(f.name, f.dataType.simpleString(), k, f.name in keys or not f.nullable, f.name in keys, (defaults or {}).get(f.name)) for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, type string, position int, required boolean, pk boolean, default_value string")
