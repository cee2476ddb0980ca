"""A view of canonical products' prices (number, mean, lowest, highest) kept up to date by changes, with retraction.

A product's state is its number of listings, their sum and, for either end, the few extreme prices with how often each occurs. Numbers and sums add and
subtract. An end knows every price up to its bound, so a price beyond it needs no place; where deletions use an end up while the product still has
listings, and only there, the product's listings are read again. Prices are decimals, so that what is added can be taken away exactly.

A change has the image of a listing before it (null for a new one) and after it (null for one that is gone); one that moves to another product, or whose price
changes, is both. All of it is joins and grouping: a product with a great many changes is first counted by price.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: Prices that an end keeps.
KEEP = 8
PRICE = "decimal(18,6)"
#: (column of the state, sign that turns its order to ascending)
ENDS = (("lows", 1), ("highs", -1))


def signed(changes: DataFrame) -> DataFrame:
    """(product, price, net): what changes (old_product, old_price, new_product, new_price) add to the number of listings at a price; null prices or products count for nothing."""
    images = F.array(F.struct(F.col("old_product").alias("product"), F.col("old_price").cast(PRICE).alias("price"), F.lit(-1).alias("net")), F.struct(F.col("new_product").alias("product"), F.col("new_price").cast(PRICE).alias("price"), F.lit(1).alias("net")))
    rows = changes.select(F.explode(images).alias("x")).select("x.*").where("product is not null and price is not null")
    return rows.groupBy("product", "price").agg(F.sum("net").alias("net")).where("net <> 0")


def ends_of(counted: DataFrame, keep: int) -> DataFrame:
    """(product, lows, highs) of (product, price, net): for each end its first prices in order, and whether those are all that the product has."""
    sides = []
    for name, sign in ENDS:
        order = Window.partitionBy("product").orderBy(F.col("price") * sign)
        first = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep + 1)
        held = F.slice(F.array_sort(F.collect_list(F.struct((F.col("price") * sign).cast(PRICE).alias("key"), F.col("net").alias("n")))), 1, keep)
        sides.append(first.groupBy("product").agg(F.struct(held.alias("held"), (F.count(F.lit(1)) <= keep).alias("whole")).alias(name)))
    return reduce(lambda a, b: a.join(b, "product"), sides)


def start(listings: DataFrame, keep: int = KEEP) -> DataFrame:
    """The state (product, n, total, lows, highs) of listings (product, price)."""
    counted = listings.select("product", F.col("price").cast(PRICE).alias("price")).where("product is not null and price is not null").groupBy("product", "price").agg(F.count(F.lit(1)).alias("net"))
    sums = counted.groupBy("product").agg(F.sum("net").alias("n"), F.sum(F.col("price") * F.col("net")).cast("decimal(38,6)").alias("total"))
    return sums.join(ends_of(counted, keep), "product")


def touched(state: DataFrame, changes: DataFrame, keep: int = KEEP) -> DataFrame:
    """The new state of the products that changes touch, with ``dry`` where an end is used up and must be counted again; a product without listings has n = 0."""
    delta = kept(signed(changes))
    sums = delta.groupBy("product").agg(F.sum("net").alias("more"), F.sum(F.col("price") * F.col("net")).alias("more_total"))
    own = kept(state.join(sums.select("product"), "product", "left_semi"))
    base = sums.join(own.select("product", "n", "total"), "product", "left")
    base = base.select("product", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), (F.coalesce("total", F.lit(0)) + F.col("more_total")).cast("decimal(38,6)").alias("total"))
    for name, sign in ENDS:
        # prices beyond the bound of an end that isn't whole have no place in it
        bound = own.select("product", F.when(F.col(f"{name}.whole"), None).otherwise(F.element_at(f"{name}.held", -1)["key"]).alias("bound"))
        inside = delta.join(bound, "product", "left").select("product", (F.col("price") * sign).cast(PRICE).alias("key"), F.col("net").alias("n"), "bound").where("bound is null or key <= bound").drop("bound")
        merged = own.select("product", F.explode(f"{name}.held").alias("x")).select("product", "x.key", "x.n").unionByName(inside).groupBy("product", "key").agg(F.sum("n").alias("n")).where("n > 0")
        first = merged.withColumn("at", F.row_number().over(Window.partitionBy("product").orderBy("key"))).where(F.col("at") <= keep + 1)
        held = first.groupBy("product").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "n"))), 1, keep).alias("held"), F.count(F.lit(1)).alias("found"))
        side = sums.select("product").join(held, "product", "left").join(own.select("product", F.col(f"{name}.whole").alias("was_whole")), "product", "left")
        whole = F.coalesce("was_whole", F.lit(True)) & (F.coalesce("found", F.lit(0)) <= keep)
        none = F.array().cast(f"array<struct<key:{PRICE},n:bigint>>")
        base = base.join(side.select("product", F.struct(F.coalesce("held", none).alias("held"), whole.alias("whole")).alias(name)), "product")
    return base.withColumn("dry", (F.col("n") > 0) & ((F.size("lows.held") == 0) | (F.size("highs.held") == 0)))


def apply(state: DataFrame, changes: DataFrame, listings: DataFrame, keep: int = KEEP) -> DataFrame:
    """The state of the touched products after the changes, to be merged by product (n = 0: to be removed). ``listings`` are those after the changes; only the products with an end used up are read of them."""
    new = kept(touched(state, changes, keep))
    again = start(listings.join(new.where("dry").select("product"), "product", "left_semi"), keep)
    return new.where("not dry").drop("dry").unionByName(again)


def merged(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The whole state: untouched products as they are, touched ones as changed."""
    return state.join(changed.select("product"), "product", "left_anti").unionByName(changed).where("n > 0")


def view(state: DataFrame) -> DataFrame:
    """(product, n, mean, low, high)."""
    return state.where("n > 0").select("product", "n", (F.col("total").cast("double") / F.col("n")).alias("mean"), F.col("lows.held")[0]["key"].cast("double").alias("low"), (-F.col("highs.held")[0]["key"]).cast("double").alias("high"))
