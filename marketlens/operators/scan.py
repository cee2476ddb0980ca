"""A site's landed pages as products: which pages are products', what they say, one row an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.condition import page_field, page_text, product_condition, section
from . import html
from .hits import host, no_product
from .sheets import page_key

ROW = ["url", "name", "price", "source", "etat"]


def site_scan(pages: DataFrame, categories: Column | None = None, inventory_only: bool = False) -> DataFrame:
    """(site, page, url, name, price, source, etat), one row an address (``page``, without www. and what follows ?), of pages (url, html).

    Addresses that are no product's, without a host, or without a name in the page give none; ``categories`` is a test on an address, e.g. ``F.col("url").rlike("/vtt/")``.
    ``inventory_only`` leaves catalogue pages out. Of several pages of an address the first by URL counts, then the first by name. Pages are read where they
    lie; only the extracted rows move.
    """
    kept = pages.where(~F.coalesce(no_product(F.col("url")), F.lit(True)) & (categories if categories is not None else F.lit(True)))
    none = F.lit(None).cast("string")
    source = section(F.col("url"), none, none)
    if inventory_only:
        kept = kept.where(source != "catalogue")
    state = product_condition(F.col("x.name"), none, F.col("url"), none, F.col("field"), F.col("text"), none, F.col("source"), none)
    rows = kept.select("url", page_field(F.col("html")).alias("field"), page_text(F.col("html")).alias("text"), source.alias("source"), html.extracted("html").alias("x"))
    rows = rows.where("x.name <> ''").select(host(F.col("url")).alias("site"), page_key(F.col("url")).alias("page"), "url", "x.name", "x.price", "source", state.alias("etat"))
    first = rows.where("site <> ''").groupBy("site", "page").agg(F.min(F.struct(*ROW)).alias("r"))
    return first.select("site", "page", "r.*")


def scan_info(products: DataFrame) -> DataFrame:
    """What a scan gave, one row a site: products, how many have a price, how many are used."""
    return products.groupBy("site").agg(F.count(F.lit(1)).alias("products"), F.count("price").alias("priced"), F.count_if(F.col("etat") == "occasion").alias("used"))
