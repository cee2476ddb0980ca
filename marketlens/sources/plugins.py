"""Registered sources behind one Spark data source: ``spark.read.format("registered_feeds")``.

A registry names sources by slug, with their domains, what they serve, and where and how their feeds land (JSON lines, CSV with a header, XML items). The
data source makes a partition of every file of every source; a filter on ``slug`` or ``domain`` is pushed into it, so that other sources' files are no
partitions at all, and the categories that a query asks for choose sources before anything is read. Files are read item by item.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlsplit
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql import functions as F

FORMAT, PUSHDOWN = "registered_feeds", "spark.sql.python.filterPushdown.enabled"
FIELDS = ("id", "name", "brand", "price", "url")
SCHEMA = "slug string, domain string, " + ", ".join(f"{f} string" for f in FIELDS)


@dataclass(frozen=True)
class Source:
    """``serves`` are paths of categories; an item of an XML feed is an element ``tag``; ``fields`` name a feed's own columns for those of FIELDS that are called otherwise."""

    slug: str
    name: str
    domain: str
    path: str
    kind: str = "json"
    serves: tuple[str, ...] = ()
    tag: str = "item"
    fields: tuple[tuple[str, str], ...] = ()


class Registry:
    """Sources by slug and domain."""

    def __init__(self, sources: Iterable[Source]) -> None:
        self.sources = {s.slug: s for s in sources}
        self.domains = {s.domain.lower(): s for s in self.sources.values()}

    def by_slug(self, slug: str) -> Source | None:
        return self.sources.get(slug)

    def by_url(self, url: str) -> Source | None:
        """The source whose site an address is of, with or without www."""
        host = (urlsplit(url).hostname or "").lower()
        return self.domains.get(host.removeprefix("www."))

    def search(self, text: str) -> list[Source]:
        """Sources with the text in their name, slug or domain, in any case."""
        want = text.lower().strip()
        return [s for s in self.sources.values() if want in f"{s.name} {s.slug} {s.domain}".lower()]

    def serving(self, category: str) -> list[Source]:
        """Sources that serve a category, one above it, or one below it."""
        under = lambda a, b: a == b or a.startswith(f"{b}.")
        return [s for s in self.sources.values() if any(under(category, c) or under(c, category) for c in s.serves)]

    def read(self, spark: SparkSession, category: str | None = None) -> DataFrame:
        """All items of the sources, or of those that serve a category."""
        spark.dataSource.register(FeedSource)
        spark.conf.set(PUSHDOWN, "true")
        own = self.serving(category) if category else [*self.sources.values()]
        return spark.read.format(FORMAT).option("sources", json.dumps([asdict(s) for s in own])).load()


def items(source: Source, stream: io.BufferedIOBase) -> Iterator[dict[str, str | None]]:
    """A file's items as texts by their own names; what isn't an item is passed over."""
    if source.kind == "xml":
        for _, element in ElementTree.iterparse(stream):
            if element.tag.rpartition("}")[2] == source.tag:
                yield {x.tag.rpartition("}")[2]: x.text for x in element}
                element.clear()
    elif source.kind == "csv":
        yield from csv.DictReader(io.TextIOWrapper(stream, "utf-8", newline=""))
    else:
        for line in io.TextIOWrapper(stream, "utf-8"):
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if isinstance(x, dict):
                yield {k: None if v is None else str(v) for k, v in x.items()}


@dataclass
class File(InputPartition):
    source: dict
    path: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FeedReader(DataSourceReader):
    def __init__(self, sources: list[Source]) -> None:
        self.sources = sources

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps the sources that equality on slug or domain leaves; other filters are Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else ""
            if column not in ("slug", "domain"):
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.sources = [s for s in self.sources if getattr(s, column) in wanted]

    def partitions(self) -> list[File]:
        out = []
        for s in self.sources:
            where, path = opened(s.path)
            found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if where.get_file_info(path).type != fs.FileType.File else [where.get_file_info(path)]
            out += [File(asdict(s), f"{s.path.partition('://')[0]}://{x.path}" if "://" in s.path else x.path) for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", "."))]
        return out or [File({}, "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        source = Source(**partition.source)
        names = dict(source.fields)
        where, path = opened(partition.path)
        with where.open_input_stream(path) as stream:
            for x in items(source, stream):
                yield (source.slug, source.domain, *(x.get(names.get(f, f)) for f in FIELDS))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader([Source(**s) for s in json.loads(self.options["sources"])])


def federated(spark: SparkSession, registry: Registry, category: str, words: list[str], per_source: int = 3, limit: int = 50) -> DataFrame:
    """What the sources that serve a category have with all the words in its name: each one's cheapest, together by price; one row an address without its query."""
    from pyspark.sql import Window

    found = registry.read(spark, category).withColumn("price", F.col("price").try_cast("double")).where(F.col("price").isNotNull())
    for w in words:
        found = found.where(F.contains(F.lower("name"), F.lit(w.lower())))
    top = found.withColumn("at", F.row_number().over(Window.partitionBy("slug").orderBy("price", "id"))).where(F.col("at") <= per_source).drop("at")
    page = F.substring_index("url", "?", 1)
    best = top.groupBy(page.alias("page")).agg(F.min_by(F.struct(*top.columns), F.struct("price", "slug", "id")).alias("x")).select("x.*")
    return best.orderBy("price", "slug", "id").limit(limit)
