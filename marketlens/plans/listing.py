"""The listing view: line items as product listings of retailers (suppliers), with supplier 0 as the reference site.

Brand and model keys belong to the product, so they are made once for each content of parts, before the join, in a view of their own for the queries that match.
``ord`` with ``unit_key`` gives the first-seen order that first-wins rules go by; it is computed row by row, never by numbering a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import with_keys

REFERENCE = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing view with brand_key, model_key and base_key."""
    part = with_keys(table(spark, sf_dir, "part"), F.col("p_brand"), F.concat_ws(" ", "p_type", "p_size"), F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return _listing(table(spark, sf_dir, "lineitem"), part, "brand_key", "model_key", "base_key")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def _listing(li: DataFrame, part: DataFrame, *more: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "N", "neuf").when(F.col("l_returnflag") == "R", "occasion").otherwise("demonstrateur")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"),
        F.col("l_suppkey").cast("long").alias("site"),
        F.col("l_partkey").cast("long").alias("product"),
        F.col("p_brand").alias("marque"),
        F.concat_ws(" ", "p_type", "p_size").alias("modele"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"),
        F.year("l_shipdate").cast("int").alias("annee"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("prix"),
        state.alias("etat"),
        F.col("l_linestatus").alias("disponibilite"),
        F.col("p_type").alias("category"),
        F.col("l_shipdate").alias("scraped_at"),
        *more,
    )


#: The same view for DuckDB, as the start of a WITH clause.
SQL = """WITH listing AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_key, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
 CAST(l_suppkey AS BIGINT) AS site, CAST(l_partkey AS BIGINT) AS product, p_brand AS marque, concat_ws(' ', p_type, p_size) AS modele, concat_ws(' ', p_name, p_brand, p_type) AS name,
 CAST(year(l_shipdate) AS INTEGER) AS annee, l_extendedprice / l_quantity AS prix, CASE l_returnflag WHEN 'N' THEN 'neuf' WHEN 'R' THEN 'occasion' ELSE 'demonstrateur' END AS etat,
 l_linestatus AS disponibilite, p_type AS category, l_shipdate AS scraped_at FROM lineitem JOIN part ON l_partkey = p_partkey)"""
