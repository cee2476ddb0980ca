"""Units of one model as one product: duplicates of a page or a stock number go first, then units group by model, year and state, or by VIN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a VIN that tells units apart.
VIN = 10


def text(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))


def first_of(rows: DataFrame, key: Column) -> DataFrame:
    """Of rows of a site with one key that isn't empty, the first seen (of those seen at once the least by price and state)."""
    at = F.row_number().over(Window.partitionBy("site", "_key").orderBy("ord", "unit_key", "prix", "etat"))
    keyed = rows.withColumn("_key", key)
    return keyed.where("_key <> ''").withColumn("_at", at).where("_at = 1").drop("_at").unionByName(keyed.where("_key = ''")).drop("_key")


def group_products(rows: DataFrame, by_url: bool = True, by_stock: bool = False, vin_split: bool = False) -> DataFrame:
    """(site, k, quantity, prix, multi_unit, urls, units): one row for each product of a site.

    rows: site, ord, unit_key, url, stock, vin, marque, modele, name, annee, etat, prix. The price is the least one known, urls are the first unit's and those of
    others that have one, units the keys in the order seen (none for a single unit). With both kinds of duplicates the URL's go first.
    """
    if by_url:
        rows = first_of(rows, F.rtrim(F.coalesce("url", F.lit("")), F.lit("/")))
    if by_stock:
        rows = first_of(rows, F.coalesce(F.col("stock").cast("string"), F.lit("")))
    year, state = F.coalesce(F.col("annee"), F.lit(0)).cast("string"), F.coalesce(F.nullif(text("etat"), F.lit("")), F.lit("neuf"))
    model = F.when((text("marque") != "") & (text("modele") != ""), F.concat_ws("|", text("marque"), text("modele"), year, state)).otherwise(F.concat_ws("|", F.concat(F.lit("name:"), text("name")), year, state))
    vin = F.upper(F.trim(F.coalesce("vin", F.lit(""))))
    key = F.when(F.length(vin) >= VIN, F.concat(F.lit("vin:"), vin)).otherwise(model) if vin_split else model
    units = F.array_sort(F.collect_list(F.struct("ord", "unit_key", F.coalesce("url", F.lit("")).alias("url"))))
    g = rows.groupBy("site", key.alias("k")).agg(F.count(F.lit(1)).alias("quantity"), F.min(F.when(F.col("prix") != 0, F.col("prix"))).alias("prix"), units.alias("u"))
    urls = F.transform(F.filter("u", lambda x, i: (i == 0) | (x["url"] != "")), lambda x: x["url"])
    return g.select("site", "k", "quantity", "prix", (F.col("quantity") >= 2).alias("multi_unit"), urls.alias("urls"), F.when(F.col("quantity") >= 2, F.transform("u", lambda x: x["unit_key"])).alias("units"))
