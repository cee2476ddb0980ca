"""Queries of registered sources: three feeds that land in three formats, read through one data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import plugins
from ..streaming.jobs import shared_folder
from .listing import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


#: What the feeds hold: a third of the catalogue each, with an address that comes twice.
ITEM = {"id": "CAST(p_partkey AS VARCHAR(20))", "name": "p_name", "brand": "p_brand", "price": "CAST(CAST(p_retailprice * 100 AS BIGINT) AS VARCHAR(20))", "url": "concat('https://shop.example/p/', p_partkey % 500, '?ref=', p_partkey)"}
FEEDS = (("json-shop", "json.example", ("vehicule.moto",)), ("csv-shop", "csv.example", ("vehicule",)), ("xml-shop", "xml.example", ("maison",)))
FEED_SQL = "(SELECT ['json-shop', 'csv-shop', 'xml-shop'][p_partkey % 3 + 1] AS slug, ['json.example', 'csv.example', 'xml.example'][p_partkey % 3 + 1] AS domain, " + ", ".join(f"{x} AS {c}" for c, x in ITEM.items()) + " FROM part)"


def registry(spark: SparkSession, d: str) -> plugins.Registry:
    """Lands the feeds in the shared folder and names them."""
    root = shared_folder(spark)
    rows = table(spark, d, "part").select(*(F.expr(x).alias(c) for c, x in ITEM.items()), (F.col("p_partkey") % 3).alias("third"))
    own = lambda k: rows.where(F.col("third") == k).drop("third")
    own(0).write.json(f"{root}/0")
    own(1).write.option("header", True).csv(f"{root}/1")
    own(2).write.format("xml").option("rootTag", "feed").option("rowTag", "item").save(f"{root}/2")
    return plugins.Registry(plugins.Source(slug, slug.title(), domain, f"{root}/{k}", slug[:-5], serves) for k, (slug, domain, serves) in enumerate(FEEDS))


@query("s9_registered_sources", f"SELECT slug, domain, count(*) AS n, CAST(sum(CAST(price AS BIGINT)) AS BIGINT) AS total FROM {FEED_SQL} GROUP BY slug, domain")
def s9(spark: SparkSession, d: str) -> DataFrame:
    own = registry(spark, d).read(spark)
    return own.groupBy("slug", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("long")).alias("total"))


@query("s9_source_by_address", f"SELECT id, name, price FROM {FEED_SQL} WHERE slug = 'csv-shop'")
def s9_one(spark: SparkSession, d: str) -> DataFrame:
    """The items of the one source that an address belongs to; the others' files are no partitions."""
    known = registry(spark, d)
    return known.read(spark).where(F.col("slug") == known.by_url("https://www.csv.example/x").slug).select("id", "name", "price")


@query("s14_federated_adapters", f"SELECT slug, brand, count(*) AS n FROM {FEED_SQL} WHERE slug IN ('json-shop', 'csv-shop') GROUP BY slug, brand")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """What the sources have that serve a category, or one that holds it."""
    return registry(spark, d).read(spark, "vehicule.moto").groupBy("slug", "brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q5_routed_search",
    f"WITH f AS (SELECT slug, id, url, CAST(price AS DOUBLE) AS price, row_number() OVER (PARTITION BY slug ORDER BY CAST(price AS DOUBLE), id) AS place FROM {FEED_SQL} WHERE slug IN ('json-shop', 'csv-shop') AND contains(lower(name), 'ring')), u AS (SELECT *, row_number() OVER (PARTITION BY string_split(url, '?')[1] ORDER BY price, slug, id) AS rn FROM f WHERE place <= 20) SELECT slug, id, price FROM u WHERE rn = 1 ORDER BY price, slug, id LIMIT 30",
)
def q5(spark: SparkSession, d: str) -> DataFrame:
    """Routing by category, the cheapest of each source, one row an address, best first."""
    return plugins.federated(spark, registry(spark, d), "vehicule.moto", ["ring"], 20, 30).select("slug", "id", "price")
