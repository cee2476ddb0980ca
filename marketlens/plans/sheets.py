"""Queries of change sheets, exports, site scans, states, variants, vehicle numbers and kept copies in full; the smaller ones stay in ``more`` and ``engine``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import condition as c
from ..functions.text import model_tokens, precise_model
from ..operators import resolve, scan, sheets, variants
from .listing import REFERENCE, SQL, listing, table
from .market import TEXT
from .scalars import PLAIN

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- change sheets ---------------------------------------------------------------------------------------------------------------------------
# How products, requests and manual prices spell their keys; read the same in both dialects.
PRODUCT_KEY = "CASE product % 3 WHEN 0 THEN concat('Item|', product, '/') WHEN 1 THEN concat('ref:https://www.Shop.example/P/', product, '/') ELSE concat('HTTPS://shop.example/P/', product) END"
PRODUCT_URL = "CASE product % 4 WHEN 1 THEN concat('https://WWW.shop.example/P/', product, '//?x=1') WHEN 2 THEN concat('http://shop.example/p/', product) WHEN 3 THEN concat('shop.example/ID/', product, '/') END"
REQUESTED = "CASE o_orderkey % 4 WHEN 0 THEN concat('https://www.shop.example/P/', o_custkey, '/') WHEN 1 THEN concat('ref:http://shop.example/p/', o_custkey) WHEN 2 THEN concat('ITEM|', o_custkey) ELSE concat('ref:SHOP.example/id/', o_custkey) END"
MANUAL = "CASE event_id % 4 WHEN 0 THEN concat('https://shop.example/P/', user_id, '/') WHEN 1 THEN concat('http://www.shop.example/p/', user_id) WHEN 2 THEN concat('item|', user_id, '//') ELSE concat('ref:shop.example/ID/', user_id) END"


def page_sql(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '^[A-Za-z]+://') THEN lower(regexp_extract({x}, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract({x}, '://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract({x}, '://[^/?#]*([^?#]*)', 1), '/+$', '') ELSE regexp_replace(lower({x}), '/+$', '') END"""


def key_sql(x: str) -> str:
    return f"CASE WHEN starts_with({x}, 'ref:') THEN 'ref:' || {page_sql(f'substr({x}, 5)')} WHEN regexp_matches(lower({x}), '^https?://') THEN {page_sql(x)} ELSE regexp_replace(lower({x}), '/+$', '') END"


ITEMS_SQL = f"""{SQL}, prices AS (SELECT product, min(CASE WHEN site = {REFERENCE} THEN prix END) AS old_price, min(CASE WHEN site <> {REFERENCE} THEN prix END) - 1 AS recommended_price, count(*) AS n FROM listing GROUP BY product),
 items AS (SELECT *, {PRODUCT_KEY} AS product_key, {PRODUCT_URL} AS reference_url FROM prices)"""


@query(
    "v3_change_sheets",
    f"""{ITEMS_SQL}, keys AS (SELECT product, unnest([1, 2, 3]) AS place, unnest([{key_sql('product_key')}, {page_sql('reference_url')}, 'ref:' || {page_sql('reference_url')}]) AS key FROM items),
    asked AS (SELECT DISTINCT key FROM (SELECT {key_sql('k')} AS key FROM (SELECT {REQUESTED} AS k FROM orders))),
    manual AS (SELECT key, arg_max(price, event_id) AS price FROM (SELECT {key_sql('k')} AS key, floor(price + 0.5) AS price, event_id FROM (SELECT {MANUAL} AS k, value - 40 AS price, event_id FROM events) WHERE price >= 0) GROUP BY key),
    met AS (SELECT product, bool_or(asked.key IS NOT NULL) AS asked, min(CASE WHEN price IS NOT NULL THEN place END) AS place FROM keys LEFT JOIN asked USING (key) LEFT JOIN manual USING (key) GROUP BY product)
    SELECT product_key, reference_url, round(old_price, 6) AS old_price, round(coalesce(price, recommended_price), 6) AS new_price, round(coalesce(price, recommended_price) - old_price, 6) AS difference, price IS NOT NULL AS is_manual,
      'lowest_minus_amount' || CASE WHEN n < 20 THEN ' · moins fiable (basé neuf)' ELSE '' END AS strategy_label FROM met JOIN items USING (product) LEFT JOIN keys USING (product, place) LEFT JOIN manual USING (key) WHERE asked""",
)
def v3(spark: SparkSession, d: str) -> DataFrame:
    """The products that orders ask for, under any spelling of any of their keys, with the manual prices that events state."""
    own = F.col("site") == REFERENCE
    prices = listing(spark, d).groupBy("product").agg(F.min(F.when(own, F.col("prix"))).alias("old_price"), (F.min(F.when(~own, F.col("prix"))) - 1).alias("recommended_price"), F.count(F.lit(1)).alias("n"))
    low = F.when(F.col("n") < 20, "low").otherwise("good").alias("reliability")
    items = prices.select("*", F.expr(PRODUCT_KEY).alias("product_key"), F.expr(PRODUCT_URL).alias("reference_url"), F.lit("lowest_minus_amount").alias("strategy"), low, F.lit("neuf").alias("basis_state"))
    asked = table(spark, d, "orders").select(F.expr(REQUESTED).alias("key"))
    manual = table(spark, d, "events").select(F.expr(MANUAL).alias("key"), (F.col("value") - 40).alias("price"), F.col("event_id").alias("at"))
    sheet = sheets.change_sheet(items, asked, manual)
    return sheet.select("product_key", "reference_url", *(F.round(x, 6).alias(x) for x in ("old_price", "new_price", "difference")), F.col("manual_price").isNotNull().alias("is_manual"), "strategy_label")


# --- exports -----------------------------------------------------------------------------------------------------------------------------------
DEALERS = [f"nation{k}" for k in range(25)]
DELTA = "CASE WHEN {0} > 0 THEN '+' || CAST(CAST(round({0}) AS BIGINT) AS VARCHAR) || ' $' WHEN {0} < 0 THEN '-' || CAST(CAST(round(abs({0})) AS BIGINT) AS VARCHAR) || ' $' WHEN {0} = 0 THEN '= 0 $' END"
OFFERS_SQL = f"{SQL}, offer AS (SELECT product, min(CASE WHEN site = {REFERENCE} THEN prix END) OVER (PARTITION BY product) AS reference, 'nation' || s_nationkey AS dealer, prix, ord FROM listing JOIN supplier ON s_suppkey = site), first AS (SELECT product, dealer, max(reference) AS reference, round(arg_min(prix, (ord, prix)), 6) AS price FROM offer GROUP BY 1, 2)"


def export_sql() -> str:
    own = lambda k: f"max(CASE WHEN dealer = '{k}' THEN price END)"
    wide = f"SELECT product, round(max(reference), 6) AS reference, {', '.join(f'{own(k)} AS \"{k} price\"' for k in DEALERS)} FROM first GROUP BY product"
    deltas = ", ".join(f'{DELTA.format(f"(\"{k} price\" - reference)")} AS "{k} delta"' for k in DEALERS)
    return f"{OFFERS_SQL}, wide AS ({wide}) SELECT *, {deltas} FROM wide"


def compared(spark: SparkSession, d: str) -> DataFrame:
    """Every product's first price of each nation's suppliers, beside the reference site's least price."""
    rows, s = listing(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("site"), F.concat(F.lit("nation"), "s_nationkey").alias("dealer"))
    own = rows.where(F.col("site") == REFERENCE).groupBy("product").agg(F.round(F.min("prix"), 6).alias("reference"))
    offers = rows.join(s, "site").join(own, "product", "left").select("product", "reference", "dealer", F.round("prix", 6).alias("price"), F.col("ord").alias("at"))
    return sheets.comparison(offers, ["product"], DEALERS)


@query("s23_comparison_export", export_sql())
def s23(spark: SparkSession, d: str) -> DataFrame:
    return compared(spark, d)


@query("s23_export_info", f"{OFFERS_SQL} SELECT 'marketlens' AS generated_by, count(DISTINCT product) AS products, CAST(25 AS BIGINT) AS dealers FROM first")
def s23_info(spark: SparkSession, d: str) -> DataFrame:
    return sheets.export_info(compared(spark, d), DEALERS, "marketlens")


# --- kept copies -------------------------------------------------------------------------------------------------------------------------------
NOW = "1998-08-01 00:00:00"


def merged_sql(locked: bool) -> str:
    anew = "" if locked else "WHEN is_new THEN 'fallback'"
    stale = "'locked'" if locked else "CASE WHEN is_new THEN 'refreshed' ELSE 'stale' END"
    return f"""WITH kept AS (SELECT o_custkey AS domain, max(o_orderdate) AS latest FROM orders GROUP BY 1), told AS (SELECT c_custkey AS domain, CASE WHEN latest >= TIMESTAMP '{NOW}' - to_hours(CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey * 240 ELSE 4800 END) THEN 'cache' WHEN latest IS NOT NULL THEN {stale} {anew} END AS outcome
      FROM (SELECT c_custkey, c_nationkey, latest, c_custkey IN (SELECT user_id FROM events) AS is_new FROM customer LEFT JOIN kept ON domain = c_custkey))
    SELECT domain, outcome, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE 'site' || domain END AS source_site FROM told JOIN orders ON o_custkey = domain WHERE outcome IN ('cache', 'locked', 'stale')
    UNION ALL SELECT domain, outcome, event_id, 'site' || domain FROM told JOIN events ON user_id = domain WHERE outcome IN ('refreshed', 'fallback')"""


def merged(spark: SparkSession, d: str, locked: bool) -> DataFrame:
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("domain"), F.concat(F.lit("site"), "c_custkey").alias("site_url"), F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey") * 240.0).alias("max_hours"))
    cached = table(spark, d, "orders").select(F.col("o_custkey").alias("domain"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("source_site"), F.col("o_orderdate").alias("scraped_at"), F.col("o_orderkey").alias("id"))
    fresh = table(spark, d, "events").select(F.col("user_id").alias("domain"), F.lit("").alias("source_site"), F.col("event_id").alias("id"))
    return sheets.merged_sources(sites, cached, fresh, F.lit(NOW).cast("timestamp_ntz"), locked, 4800.0).select("domain", "outcome", "id", "source_site")


@query("st14_merged_sources", merged_sql(False))
def st14(spark: SparkSession, d: str) -> DataFrame:
    """Orders as each customer's kept copy with a limit of its own, events as what is read anew."""
    return merged(spark, d, False)


@query("st14_merged_while_locked", merged_sql(True))
def st14_locked(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d, True)


# --- states, variants, models --------------------------------------------------------------------------------------------------------------------
# What a part's offer shows, in both dialects.
OFFER = {
    "name": "concat(p_name, CASE p_partkey % 13 WHEN 0 THEN ' Démo' WHEN 1 THEN ' demos' ELSE '' END)",
    "model": "CASE WHEN p_partkey % 17 = 0 THEN 'DEMO 4' END",
    "product_url": "CASE p_partkey % 7 WHEN 0 THEN concat('https://x.example/fr/Usage/', p_partkey) WHEN 1 THEN 'https://x.example/a-new-one' WHEN 2 THEN 'https://x.example/vehicules-demonstrateur/1' WHEN 3 THEN 'https://x.example/usedbikes/1' WHEN 4 THEN '' END",
    "page_url": "CASE p_size % 5 WHEN 0 THEN 'https://x.example/inventaire-neuf/' WHEN 1 THEN 'https://x.example/catalogue/' WHEN 2 THEN 'https://x.example/en-stock/' ELSE 'https://x.example/used/' END",
    "field": "CASE p_partkey % 6 WHEN 0 THEN 'Véhicule d’occasion' WHEN 1 THEN 'Démo' WHEN 2 THEN 'Brand New' WHEN 3 THEN 'as seen' END",
    "text": "CASE p_partkey % 5 WHEN 0 THEN 'Used, like new' WHEN 1 THEN 'Modèle neuf!' WHEN 2 THEN 'Unused démonstrateur' WHEN 3 THEN 'refused' END",
    "km": "CASE p_partkey % 11 WHEN 0 THEN '12 000 km' WHEN 1 THEN '0 km' WHEN 2 THEN 'n/a' END",
    "source": "CASE WHEN p_partkey % 19 = 0 THEN 'vehicules_occasion' END",
    "given": "CASE p_partkey % 23 WHEN 0 THEN 'occasion' WHEN 1 THEN 'demonstrateur' WHEN 2 THEN '' END",
}


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def address_sql(u: str) -> str:
    return f"CASE WHEN {any_of(u, c.USED_ADDRESS)} THEN 'occasion' WHEN {any_of(u, c.DEMO_ADDRESS)} THEN 'demonstrateur' WHEN {any_of(u, c.NEW_ADDRESS)} THEN 'neuf' END"


def word_sql(x: str, words: list[str]) -> str:
    return f"regexp_matches({x}, '{c.words_pattern(words)}')"


@query(
    "f14_product_condition",
    f"""WITH o AS (SELECT p_partkey, {', '.join(f'{x} AS {k}' for k, x in OFFER.items())} FROM part),
    l AS (SELECT p_partkey, given, lower(concat_ws(' ', name, model)) AS n, lower(coalesce(product_url, '')) AS u, lower(coalesce(page_url, '')) AS v, lower(coalesce(field, '')) AS f, lower(coalesce(text, '')) AS t, coalesce(TRY_CAST(regexp_replace(km, '[^0-9]', '', 'g') AS BIGINT), 0) > 0 AS went, source FROM o),
    s AS (SELECT *, coalesce(source, CASE WHEN {any_of("(u || ' ' || v)", c.USED_SECTION)} THEN 'vehicules_occasion' WHEN {any_of("(u || ' ' || v)", c.CATALOGUE_SECTION)} THEN 'catalogue' ELSE 'inventaire' END) AS section,
      coalesce(nullif(given, ''), CASE WHEN {word_sql('n', c.DEMO_NAMES)} THEN 'demonstrateur' END, {address_sql('u')}, {address_sql('v')}) AS early,
      CASE WHEN {any_of('f', c.STATED_USED)} THEN 'occasion' WHEN {any_of('f', c.STATED_DEMO)} THEN 'demonstrateur' WHEN {any_of('f', c.STATED_NEW)} THEN 'neuf' END AS said,
      CASE WHEN {word_sql('t', c.SHOWN_USED)} THEN 'occasion' WHEN {word_sql('t', c.SHOWN_DEMO)} THEN 'demonstrateur' WHEN {word_sql('t', c.SHOWN_NEW)} THEN 'neuf' END AS seen FROM l),
    e AS (SELECT *, coalesce(early, said, seen, CASE WHEN went OR section = 'vehicules_occasion' THEN 'occasion' ELSE 'neuf' END) AS state, went OR {any_of("(u || ' ' || v)", c.SURE_USED_ADDRESS)} OR (early IS NULL AND coalesce(said = 'occasion', false)) AS sure FROM s)
    SELECT p_partkey, section, CASE WHEN state = 'occasion' AND NOT sure THEN 'neuf' ELSE state END AS etat FROM e""",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    x = {k: F.col(k) for k in OFFER}
    rows = table(spark, d, "part").select("p_partkey", *(F.expr(e).alias(k) for k, e in OFFER.items()))
    rows = rows.withColumn("section", c.section(x["product_url"], x["page_url"], x["source"]))
    state = c.product_condition(x["name"], x["model"], x["product_url"], x["page_url"], x["field"], x["text"], x["km"], F.col("section"), x["given"])
    return rows.select("p_partkey", "section", state.alias("etat"))


VARIANT_NAME = "concat(p_name, CASE p_partkey % 8 WHEN 0 THEN ' TURBO Ltd' WHEN 1 THEN ' X-RS 19/16' WHEN 2 THEN ' pare-brise le' WHEN 3 THEN ' ledger xtp' WHEN 4 THEN ' Factory Edition' WHEN 5 THEN ' north_star XP' WHEN 6 THEN ' Track Kit toît' ELSE '' END)"
VARIANT_URL = "CASE p_partkey % 5 WHEN 0 THEN 'https://x.example/offre/xt-eps-crew' WHEN 1 THEN 'https://x.example/maverick/heritage' END"
KIND = "CASE p_type WHEN 'PROMO' THEN 'moto' WHEN 'ECONOMY' THEN 'vtt' WHEN 'SMALL' THEN 'sxs' WHEN 'LARGE' THEN 'motoneige' END"


def variants_sql(rules: variants.Variants) -> str:
    tests = [" OR ".join(f"regexp_matches(t, '(^|[^a-z0-9_]){variants.plain(a)}($|[^a-z0-9_])')" for a in aliases) for aliases, _ in rules.values()]
    return f"list_filter([{', '.join(f"CASE WHEN {test} THEN '{k}' END" for k, test in zip(rules, tests, strict=True))}], lambda k: k IS NOT NULL)"


def premium_sql(rules: variants.Variants) -> str:
    return "CASE k " + " ".join(f"WHEN '{k}' THEN {float(p)}" for k, (_, p) in rules.items()) + " END"


def by_kind(sql) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {sql(t)}" for k, t in variants.KINDS.items()) + f" ELSE {sql(variants.COMMON)} END"


@query(
    "v6_variants_by_kind",
    f"WITH o AS (SELECT p_partkey, {KIND} AS kind, {TEXT.format(PLAIN.format(f"lower(concat_ws(' ', {VARIANT_NAME}, {VARIANT_URL}))"))} AS t FROM part), v AS (SELECT p_partkey, kind, {by_kind(variants_sql)} AS keys FROM o) SELECT p_partkey, array_to_string(keys, ',') AS variants, CAST(coalesce(list_sum(list_transform(keys, lambda k: {by_kind(premium_sql)})), 0) AS DOUBLE) AS premium FROM v",
)
def v6(spark: SparkSession, d: str) -> DataFrame:
    """Variants that a part's name or address states, by its kind's aliases."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(KIND).alias("kind"), F.expr(VARIANT_NAME).alias("name"), F.expr(VARIANT_URL).alias("url"))
    rows = rows.withColumn("keys", variants.variant_keys(F.col("kind"), F.col("name"), F.col("url")))
    return rows.select("p_partkey", F.array_join("keys", ",").alias("variants"), variants.premium(F.col("kind"), F.col("keys")).alias("premium"))


MODEL = "concat(CASE p_partkey % 6 WHEN 0 THEN 'YZ' WHEN 1 THEN 'Summit ' WHEN 2 THEN 'TC-' WHEN 3 THEN '' WHEN 4 THEN p_name ELSE concat(p_name, ' ') END, p_size, CASE p_size % 4 WHEN 0 THEN 'F' WHEN 1 THEN ' SX' WHEN 2 THEN '' ELSE ' R é 2' END)"


@query("f10_precise_models", f"SELECT p_partkey, array_to_string(w, ' ') AS tokens, len(w) BETWEEN 2 AND 4 AND len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 AND len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+'))) > 0 AS precise FROM (SELECT p_partkey, regexp_extract_all({MODEL}, '[A-Za-z]+|[0-9]+') AS w FROM part)")
def f10(spark: SparkSession, d: str) -> DataFrame:
    model = F.expr(MODEL)
    return table(spark, d, "part").select("p_partkey", F.array_join(model_tokens(model), " ").alias("tokens"), precise_model(model).alias("precise"))


# --- vehicle numbers and scans -----------------------------------------------------------------------------------------------------------------------
# A number's first eleven characters tell maker, model and year, here brand, type and size; each line item has a number of its own, in several spellings.
PREFIX = "upper(substr(md5(concat_ws('|', p_brand, p_type, p_size)), 1, 11))"
VIN = f"CASE l_linenumber % 4 WHEN 0 THEN concat(lower(substr({PREFIX}, 1, 3)), '-', substr({PREFIX}, 4, 8), ' ', l_orderkey) WHEN 1 THEN concat({PREFIX}, l_orderkey) WHEN 2 THEN substr({PREFIX}, 1, 10) END"


@query("m2_vin_resolution", f"WITH c AS (SELECT {PREFIX} AS prefix, min(p_partkey) AS product FROM part WHERE p_partkey % 3 > 0 GROUP BY 1), l AS (SELECT l_orderkey, l_linenumber, upper(regexp_replace({VIN}, '[\\s-]', '', 'g')) AS v FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT l_orderkey, l_linenumber, product, 0.99::DOUBLE AS confidence FROM l JOIN c ON length(v) >= 11 AND substr(v, 1, 11) = prefix")
def m2(spark: SparkSession, d: str) -> DataFrame:
    """Line items resolved by the vehicle number to the products whose specs state its prefix; two of three products state one."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    catalogue = p.select(F.col("p_partkey").alias("c_id"), F.create_map(F.lit("vin_prefix"), F.when(F.col("p_partkey") % 3 > 0, F.expr(PREFIX))).alias("c_specs"))
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.struct("l_orderkey", "l_linenumber").alias("l_id"), F.expr(VIN).alias("vin"))
    return resolve.vin_matches(rows, catalogue).select("l_id.*", F.col("c_id").alias("product"), "confidence")


SCANNED = "concat(url, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/catalogue' WHEN 2 THEN '/usage/a' WHEN 3 THEN '/panier/' ELSE '/' END)"


@query("s10_site_scan")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Every site's inventory from its pages, some of them at addresses of catalogues, used vehicles and carts."""
    return scan.site_scan(table(spark, d, "pages").select(F.expr(SCANNED).alias("url"), "html"), inventory_only=True)
