"""Price change sheets with manual prices, comparison tables for export, and which of several copies of a site's products is used. No Python over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hits import host


# --- keys ----------------------------------------------------------------------------------------------------------------------------------
def page_key(url: Column) -> Column:
    """An address as a key: scheme, host in small letters without www., path without slashes at its end. What doesn't parse: small letters, no slashes at the end."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    whole = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), host(url), path)
    odd = F.regexp_replace(F.regexp_replace(F.lower(url), "/+$", ""), r"^https?://www\.", "https://")
    return F.coalesce(whole, odd)


def price_key(key: Column) -> Column:
    """A product's key as users write it: ``ref:`` with an address, an address, or a name."""
    name = F.regexp_replace(F.lower(key), "/+$", "")
    return F.when(F.startswith(key, F.lit("ref:")), F.concat(F.lit("ref:"), page_key(F.substr(key, F.lit(5))))).when(key.rlike("(?i)^https?://"), page_key(key)).otherwise(name)


def item_keys(product_key: Column, reference_url: Column) -> Column:
    """The keys under which an item can be asked for, in the order in which manual prices are looked up: its own, its address, ``ref:`` with its address."""
    page = page_key(F.nullif(reference_url, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(price_key(product_key), page, F.concat(F.lit("ref:"), page))))


def change_sheet(items: DataFrame, requested: DataFrame, manual: DataFrame) -> DataFrame:
    """The requested items with new prices: manual ones where given, else the recommended ones.

    items: product_key, reference_url (null: none), old_price, recommended_price, strategy, reliability, basis_state and others, which stay; requested: key;
    manual: key, price, at. An item is requested, and has a manual price, by any of its keys; the first key with a price decides. Prices below 0 or not
    finite don't count, the others are rounded half up; of several for one key the last (by at, then the largest) holds. Null or empty keys ask for nothing.
    Added: new_price, difference, manual_price, original_price (where manual), strategy_label, applied.

    Requests and manual prices become one row a key before they meet the keys of items; only keys that meet something go on.
    """
    number = F.col("price").cast("double")
    fit = manual.where((number >= 0) & ~F.isnan(number) & (number < float("inf"))).select("key", F.floor(number + 0.5).cast("double").alias("price"), F.col("at").alias("at"))
    kind = "struct<at: string, price: double>"
    place = manual.schema["at"].dataType.simpleString()
    both = requested.select("key", F.lit(True).alias("asked"), F.lit(None).cast(kind.replace("string", place)).alias("p")).unionByName(fit.select("key", F.lit(False).alias("asked"), F.struct("at", "price").alias("p")))
    known = both.where("key <> ''").groupBy(price_key(F.col("key")).alias("key")).agg(F.bool_or("asked").alias("asked"), F.max("p").alias("p"))
    ids = items.select("product_key", "reference_url").distinct()
    keys = ids.select("*", F.posexplode(item_keys(F.col("product_key"), F.col("reference_url"))).alias("place", "key"))
    price = F.col("p.price")
    met = keys.join(known, "key").groupBy(F.col("product_key").alias("_k"), F.col("reference_url").alias("_u")).agg(F.bool_or("asked").alias("_asked"), F.min_by(price, F.when(price.isNotNull(), F.col("place"))).alias("manual_price"))
    met = met.where("_asked").drop("_asked")
    sheet = items.join(met, F.col("product_key").eqNullSafe(F.col("_k")) & F.col("reference_url").eqNullSafe(F.col("_u"))).drop("_k", "_u")
    label = F.concat("strategy", F.when(F.col("reliability") == "low", F.concat(F.lit(" · moins fiable (basé "), F.coalesce("basis_state", F.lit("")), F.lit(")"))).otherwise(""))
    new = F.coalesce("manual_price", "recommended_price")
    return sheet.withColumns({"new_price": new, "difference": new - F.col("old_price"), "original_price": F.when(F.col("manual_price").isNotNull(), F.col("recommended_price")), "strategy_label": label, "applied": F.lit(False)})


# --- export ----------------------------------------------------------------------------------------------------------------------------------
def signed(delta: Column) -> Column:
    """A difference as a report shows it: ``+12 $``, ``-3 $``, ``= 0 $``; null stays null."""
    size = F.round(F.abs(delta)).cast("long").cast("string")
    return F.when(delta > 0, F.concat(F.lit("+"), size, F.lit(" $"))).when(delta < 0, F.concat(F.lit("-"), size, F.lit(" $"))).when(delta == 0, F.lit("= 0 $"))


def comparison(offers: DataFrame, by: list[str], dealers: list[str]) -> DataFrame:
    """A row a product with ``reference``, and ``<dealer> price`` and ``<dealer> delta`` for each dealer, from offers (by columns, reference, dealer, price, at).

    A dealer's first offer counts (by at, then the lower price). The dealers are columns, so they are named; others' offers don't show, but their products do.
    """
    first = offers.groupBy(*by, "dealer").agg(F.min_by(F.struct("price"), F.struct("at", "price")).alias("x"), F.max("reference").alias("reference"))
    return _wide(first.select(*by, "dealer", "reference", "x.price"), by, dealers)


def _wide(first: DataFrame, by: list[str], dealers: list[str]) -> DataFrame:
    own = lambda c: F.max(F.when(F.col("dealer") == c, F.col("price")))
    g = first.groupBy(*by).agg(F.max("reference").alias("reference"), *(own(c).alias(f"{c} price") for c in dealers))
    return g.select(*by, "reference", *(x for c in dealers for x in (F.col(f"`{c} price`"), signed(F.col(f"`{c} price`") - F.col("reference")).alias(f"{c} delta"))))


def export_info(table: DataFrame, dealers: list[str], generated_by: str) -> DataFrame:
    """The sheet that goes with a comparison: what made it, how many products and dealers it has."""
    return table.agg(F.count(F.lit(1)).alias("products")).select(F.lit(generated_by).alias("generated_by"), "products", F.lit(len(dealers)).cast("long").alias("dealers"))


def write_export(table: DataFrame, dealers: list[str], path: str, generated_by: str) -> None:
    """Writes a comparison and its info as two folders of CSV with headers."""
    table.write.mode("overwrite").option("header", True).csv(f"{path}/comparison")
    export_info(table, dealers, generated_by).write.mode("overwrite").option("header", True).csv(f"{path}/info")


# --- which copy of a site's products -----------------------------------------------------------------------------------------------------------
def merged_sources(sites: DataFrame, cached: DataFrame, fresh: DataFrame, now: Column, locked: bool, default_hours: float) -> DataFrame:
    """Each site's products, from the kept copy or read anew, with ``outcome``.

    sites: domain (once each), site_url, max_hours (null: default_hours); cached: domain, source_site, scraped_at and others; fresh: domain, source_site and the same others.
    A kept copy not older than its site's limit is used (``cache``). An older one is used while a run holds the lock (``locked``), and where nothing new was
    read (``stale``), else the new rows are (``refreshed``). Without a kept copy, new rows are used (``fallback``) unless a run holds the lock. A copy's age is that
    of its newest row; one without any time is old. Rows without source_site get their site's address. Sites without rows give none; rows of other domains go.

    Sites are decided from one row a domain on each side; products move once, to meet the decision.
    """
    age = cached.groupBy("domain").agg(F.max("scraped_at").alias("_at")).withColumn("_kept", F.lit(True))
    new = fresh.select("domain").distinct().withColumn("_new", F.lit(True))
    late = F.col("_at") < now - F.make_dt_interval(hours=F.lit(0), secs=(F.coalesce("max_hours", F.lit(default_hours)) * 3600).cast("decimal(18,6)"))
    stale, has_new = F.coalesce(late, F.lit(True)), F.coalesce("_new", F.lit(False))
    outcome = F.when(F.col("_kept") & ~stale, "cache").when(F.col("_kept") & F.lit(locked), "locked").when(F.col("_kept") & has_new, "refreshed").when(F.col("_kept"), "stale").when(has_new & F.lit(not locked), "fallback")
    told = sites.join(age, "domain", "left").join(new, "domain", "left").select("domain", "site_url", outcome.alias("outcome")).where("outcome is not null")
    anew = F.col("outcome").isin("refreshed", "fallback")
    rows = lambda side, test: side.join(told.where(test), "domain").withColumn("source_site", F.coalesce(F.nullif("source_site", F.lit("")), "site_url")).drop("site_url")
    return rows(cached, ~anew).drop("scraped_at").unionByName(rows(fresh, anew))
