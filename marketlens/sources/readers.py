"""Sources: feeds in JSON, XML, CSV and Parquet, mapped to the listing schema; landed files of many sites by name; sitemap and snapshot reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import brand_in, deep_normalize
from ..functions.values import parsed_price, year_in_text


def json_feed(spark: SparkSession, path: str, items: str | None = None, schema: str | None = None) -> DataFrame:
    """A JSON feed; ``items`` is the dotted path of the array of items in each file."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.explode(F.col(items)).alias("item")).select("item.*") if items else df


def xml_feed(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True)
    return (reader.schema(schema) if schema else reader).load(path)


def csv_feed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def sitemap(spark: SparkSession, path: str, keep: str = ".*", drop: str = "^$") -> DataFrame:
    """(loc): the URLs of a sitemap that match one pattern and not the other, once each."""
    urls = xml_feed(spark, path, "url", "loc string")
    return urls.select(F.trim("loc").alias("loc")).where(F.col("loc").rlike(keep) & ~F.col("loc").rlike(drop)).distinct()


def mapped(df: DataFrame, columns: dict[str, str], casts: dict[str, str] | None = None, specs: list[str] | None = None) -> DataFrame:
    """Columns under the listing's names, leniently cast; ``specs`` go into one map."""
    out = [F.col(src).try_cast(casts[dst]).alias(dst) if dst in (casts or {}) else F.col(src).alias(dst) for dst, src in columns.items()]
    if specs:
        out.append(F.create_map(*(x for s in specs for x in (F.lit(s), F.col(s).cast("string")))).alias("specs"))
    return df.select(*out)


def union_of(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All frames by name, one row a key."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).dropDuplicates(keys)


def landed(spark: SparkSession, root: str, sites: list[str]) -> DataFrame:
    """The landed folders of several sites as one frame with a ``site_domain`` column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{root}/{s}").withColumn("site_domain", F.lit(s)) for s in sites])


def fresh(df: DataFrame, at: str, as_of: str, ttl: str = "6 HOURS") -> DataFrame:
    """Rows no older than the time to live at ``as_of``."""
    return df.where(F.col(at) >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {ttl}"))


# The fields of search and marketplace results, and what marketplace states mean.
SHOPPING = "shopping_results array<struct<title:string,extracted_price:double,price:string,source:string,product_id:string,link:string,product_link:string,thumbnail:string>>"
MARKET = (
    "itemSummaries array<struct<title:string,itemId:string,itemWebUrl:string,condition:string,price:struct<value:string,currency:string>,seller:struct<username:string>,"
    "additionalProductIdentities:array<struct<productIdentity:array<struct<identifierType:string,identifierValue:string>>>>>>"
)
CATALOG = "items array<struct<title:string,asin:string,detail_page_url:string,brand:string,price:string,identifiers:struct<upc:string,ean:string,gtin:string>>>"
MARKET_STATES = {"NEW": "neuf", "USED_EXCELLENT": "occasion", "USED_GOOD": "occasion", "USED_ACCEPTABLE": "occasion"}


def results(landed: DataFrame, body: str, schema: str) -> DataFrame:
    """One row a result with a title of landed JSON bodies; bodies that don't parse give none."""
    return landed.select(F.explode(F.from_json(body, schema)[schema.split()[0]]).alias("x")).select("x.*").where("title <> ''")


def of_title(title: str = "title") -> tuple[Column, Column]:
    """Brand and year that a title names."""
    return F.nullif(brand_in(deep_normalize(F.col(title))), F.lit("")).alias("raw_brand"), year_in_text(F.col(title)).alias("raw_year")


def shopping_results(landed: DataFrame, body: str) -> DataFrame:
    price = F.coalesce("extracted_price", parsed_price(F.col("price")))
    return results(landed, body, SHOPPING).select(
        F.col("title").alias("raw_title"), F.coalesce("source", F.lit("Google Shopping")).alias("retailer"), F.col("product_id").alias("source_product_id"), F.coalesce("link", "product_link").alias("source_url"), *of_title(), price.alias("price"),
        F.filter(F.array("thumbnail"), lambda x: x.isNotNull()).alias("images"),
    )


def market_results(landed: DataFrame, body: str) -> DataFrame:
    """Results of a marketplace search; of several identities of a kind the last counts."""
    ids = F.flatten(F.transform("additionalProductIdentities", lambda a: a["productIdentity"]))
    last = lambda kind: F.try_element_at(F.filter(ids, lambda v: v["identifierType"] == kind), F.lit(-1))["identifierValue"]
    states = F.create_map(*(F.lit(v) for kv in MARKET_STATES.items() for v in kv))
    return results(landed, body, MARKET).select(
        F.col("title").alias("raw_title"), F.coalesce("seller.username", F.lit("eBay")).alias("retailer"), F.col("itemId").alias("source_product_id"), F.col("itemWebUrl").alias("source_url"), *of_title(),
        last("GTIN").alias("gtin"), last("MPN").alias("mpn"), parsed_price(F.col("price.value")).alias("price"), F.coalesce("price.currency", F.lit("CAD")).alias("currency"), F.coalesce(states[F.col("condition")], F.lit("inconnu")).alias("condition"),
    )


def catalog_results(landed: DataFrame, body: str) -> DataFrame:
    """Results of a marketplace's own catalogue: all new, with identifiers."""
    brand, _ = of_title()
    return results(landed, body, CATALOG).select(
        F.col("title").alias("raw_title"), F.lit("Amazon.ca").alias("retailer"), F.col("asin").alias("source_product_id"), F.col("detail_page_url").alias("source_url"), F.coalesce(brand, F.col("brand")).alias("raw_brand"),
        "identifiers.upc", "identifiers.ean", "identifiers.gtin", parsed_price(F.col("price")).alias("price"), F.lit("neuf").alias("condition"),
    )


# Sub-sitemaps that are read first, and those that aren't read.
FIRST_MAPS, NO_MAPS = "inventory|inventaire|vehicle|newinventory|usedinventory|demo", "compare|comparison"


def sitemap_index(spark: SparkSession, path: str, keep: str = ".*", drop: str = "^$") -> DataFrame:
    """(loc, rank): URLs of an index's sub-sitemaps, 0 where an inventory map has them, else 1, once each; of a page in French and English the French one.

    The driver sees the names of the sub-sitemaps alone, which the protocol limits to 50,000 an index.
    """
    maps = [r.loc for r in xml_feed(spark, path, "sitemap", "loc string").select(F.trim("loc").alias("loc")).distinct().where(~F.lower("loc").rlike(NO_MAPS)).collect()]
    parts = [spark.createDataFrame([], "loc string, rank int")]
    for rank, own in enumerate(([m for m in maps if re.search(FIRST_MAPS, m.lower())], [m for m in maps if not re.search(FIRST_MAPS, m.lower())])):
        if own:
            reader = spark.read.format("xml").options(rowTag="url", ignoreNamespace=True).schema("loc string")
            parts.append(reader.load(own).select(F.trim("loc").alias("loc"), F.lit(rank).alias("rank")))
    urls = reduce(DataFrame.unionByName, parts).where(F.col("loc").rlike(keep) & ~F.col("loc").rlike(drop)).groupBy("loc").agg(F.min("rank").alias("rank"))
    french = urls.where("contains(loc, '/fr/')").select(F.expr("replace(loc, '/fr/', '/en/')").alias("loc"))
    return urls.join(french, "loc", "left_anti")
