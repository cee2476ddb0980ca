"""What depends on a row's texts alone, made once for each distinct content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import kept

#: Bytes of contents and what is made of them up to which they are broadcast.
SMALL = 8 << 20


def by_content(rows: DataFrame, content: dict[str, Column], make: Callable[[DataFrame], DataFrame], made: list[str]) -> DataFrame:
    """rows with the columns ``made``, which ``make`` adds to a table of the distinct contents (texts, under names that rows don't have).

    The making is spread over tasks, however many rows have a content and however few files they come from. It is checkpointed, as the optimizer
    would move filters on what is made, and the making with them, below the grouping.
    """
    own = rows.withColumns(content)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contents = kept(make(own.select(*content).distinct().repartition(n, *content)).select(*content, *made))
    size = contents.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in contents.columns), F.lit(64)).cast("long"))).head()[0] or 0
    a, b = own.alias("a"), (F.broadcast(contents) if size <= SMALL else contents).alias("b")
    keep = [F.col(f"a.`{c}`") for c in rows.columns if c not in made]
    return a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in content]).select(*keep, *(F.col(f"b.{c}") for c in made))
