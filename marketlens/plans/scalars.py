"""Queries of scalar functions: each runs over a whole table, with the same expression in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values as v
from ..functions.vocab import ACCENTS, AT, AVAILABILITY, BRANDS, CANONICAL_BRANDS, CATEGORIES, COLORS, DEALER_WORDS, DEPRECIATION, KINDS_IN_FRONT, OFFERED, ORDINALS, POWERSPORT_WORDS, PREORDERS, SHOP_WORDS, STATES, TITLE_NOISE, TRIMS, VEHICLE_WORDS
from .listing import SQL, listing, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def cases(x: str, of: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in of.items()) + " END"


PLAIN = f"translate({{0}}, '{ACCENTS[0]}', '{ACCENTS[1]}')"


def deep(x: str) -> str:
    """DuckDB SQL of deep_normalize; it has no look-behind, so words join by a list."""
    s = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({PLAIN.format(f'lower(trim({x}))')}, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    w = f"string_split({s}, ' ')"
    one = lambda i: f"regexp_full_match(w[{i}], '[a-z]')"
    return f"(SELECT array_to_string(list_transform(range(1, len(w) + 1), lambda i: (CASE WHEN i > 1 AND NOT ({one('i')} AND {one('i - 1')}) THEN ' ' ELSE '' END) || w[i]), '') FROM (SELECT {w} AS w))"


def model_sql(x: str, colors: bool = True) -> str:
    """DuckDB SQL of cleaned_model over SQL of a normalised model: rules over its list of words, one after another."""
    phrase = lambda at, n: " || ' ' || ".join(f"w[{at} + {k}]" for k in range(n))
    step = lambda of, x: f"(SELECT {of} FROM (SELECT {x} AS w))"
    without = lambda words: f"list_filter(w, lambda y: y NOT IN {listed(words)})"
    x = f"list_filter(string_split({x}, ' '), lambda y: y <> '')"
    offers = " OR ".join([f"w[i] IN {listed(DEALER_WORDS)}", *(f"{phrase('i', n)} IN {listed(phrases)} AND w[i + {n}] IN {listed(AT)}" for n, phrases in t.sized(OFFERED).items())])
    x = step(f"w[1:coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: {offers})) - 1, len(w))]", x)
    for place, kinds in ((0, POWERSPORT_WORDS), (1, VEHICLE_WORDS), (0, SHOP_WORDS)):
        x = step(f"CASE WHEN len(w) >= 2 AND w[len(w) - {place}] IN {listed(kinds)} THEN w[1:len(w) - 2] ELSE w END", x)
    for group in KINDS_IN_FRONT:
        x = step("CASE " + " ".join(f"WHEN len(w) > {n} AND {phrase('1', n)} IN {listed(phrases)} THEN w[{n + 1}:]" for n, phrases in t.sized(group).items()) + " ELSE w END", x)
    x = step(without(STATES), x)
    alone, ends = listed([p for p in PREORDERS if " " not in p]), listed([p.split()[1] for p in PREORDERS if " " in p])
    x = step(f"list_filter(w, lambda y, i: NOT (y IN {alone} OR coalesce(y = 'pre' AND w[i + 1] IN {ends}, false) OR coalesce(i > 1 AND y IN {ends} AND w[i - 1] = 'pre', false)))", x)
    x = step(without(COLORS), x) if colors else x
    form, number = "(w[{0}] = 'anniv' OR starts_with(w[{0}], 'annivers'))", "regexp_full_match(w[{0}], '[0-9]+')"
    x = step(f"list_transform(w, lambda y, i: CASE WHEN i > 2 AND {form.format('i')} AND w[i - 1] IN {listed(ORDINALS)} AND {number.format('i - 2')} THEN 'anniversaire' ELSE y END)", x)
    return step(f"array_to_string(list_filter(w, lambda y, i: NOT coalesce(i > 1 AND y IN {listed(ORDINALS)} AND {form.format('i + 1')} AND {number.format('i - 1')}, false)), ' ')", x)


@query("f1_deep_normalize", f"SELECT doc_id, md5({deep('text')}) AS normalized FROM documents")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(t.deep_normalize(F.col("text"))).alias("normalized"))


@query("f2_strip_accents", f"SELECT doc_id, md5({PLAIN.format('lower(text)')}) AS plain FROM documents")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(t.strip_accents(F.lower("text"))).alias("plain"))


PAINTED = "concat(p_name, ' ', CASE p_size % 4 WHEN 0 THEN 'Noir Mat' WHEN 1 THEN 'Rouge' WHEN 2 THEN 'Phantom Black' ELSE 'ABS Sport' END, ' ', p_size)"


@query("f3_remove_colors", f"SELECT p_partkey, array_to_string(list_filter(string_split({deep(PAINTED)}, ' '), lambda x: x NOT IN {listed(COLORS)}), ' ') AS plain FROM part")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.remove_colors(F.expr(PAINTED)).alias("plain"))


@query("f4_strip_trims", f"SELECT p_partkey, trim(regexp_replace(regexp_replace({deep(PAINTED)}, '(?i)\\b(?:{'|'.join(TRIMS)})\\b', '', 'g'), '\\s+', ' ', 'g')) AS base_model FROM part")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.strip_trims(t.deep_normalize(F.expr(PAINTED))).alias("base_model"))


TAGGED = "concat(CASE p_size % 3 WHEN 0 THEN 'EN STOCK - ' WHEN 1 THEN 'Pré-commande ' ELSE '' END, p_name, CASE p_size % 2 WHEN 0 THEN ' - Sold out' ELSE ' – liquidation' END)"
STATUS_RE2 = t.status_tags([x for x in AVAILABILITY if x.isascii() or not x.startswith("é") and not x.endswith("é")])


@query("f6_clean_name", f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({TAGGED}, '{STATUS_RE2}', '', 'g'), '^[\\s\\-–—]+|[\\s\\-–—]+$', '', 'g'), '\\s[\\-–—]\\s', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS cleaned FROM part")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.clean_name(F.expr(TAGGED)).alias("cleaned"))


@query("f7_product_name_key", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[\"''“”‘’«»]', '', 'g'), '\\s+', ' ', 'g'))) AS name_key FROM documents")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(t.product_name_key(F.col("text"))).alias("name_key"))


RAW_BRAND = "CASE p_size % 5 WHEN 0 THEN ' can am ' WHEN 1 THEN 'harley davidson' WHEN 2 THEN 'KTM' WHEN 3 THEN p_brand ELSE 'mv agusta' END"
RAW_CATEGORY = "CASE p_size % 4 WHEN 0 THEN 'Motorcycle' WHEN 1 THEN 'SXS' WHEN 2 THEN 'jet ski' ELSE p_type END"
TITLE_SQL = f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace({PLAIN.format('lower(title)')}, '\\$[0-9,]+\\.?[0-9]*', '', 'g'), '[^a-z0-9_\\s\\-.]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN {listed(TITLE_NOISE)}), ' ')"


@query(
    "f8_normalize_fields",
    f"""SELECT p_partkey, coalesce({cases(f'lower(trim({RAW_BRAND}))', CANONICAL_BRANDS)}, array_to_string(list_transform(string_split(lower(trim({RAW_BRAND})), '#'), lambda x: upper(x[1:1]) || x[2:]), '#')) AS brand,
    coalesce({cases(f'lower(trim({RAW_CATEGORY}))', CATEGORIES)}, lower(trim({RAW_CATEGORY}))) AS category, nullif(upper(regexp_replace(concat(p_brand, '-', p_partkey, ' x'), '[\\s-]', '', 'g')), '') AS identifier,
    (SELECT {TITLE_SQL} FROM (SELECT concat(p_name, ' for the $', p_size, ',000.50 ', p_type, '!') AS title)) AS title FROM part""",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    title = F.expr("concat(p_name, ' for the $', p_size, ',000.50 ', p_type, '!')")
    return table(spark, d, "part").select(
        "p_partkey", t.canonical_brand(F.expr(RAW_BRAND)).alias("brand"), t.canonical_category(F.expr(RAW_CATEGORY)).alias("category"), t.identifier(F.expr("concat(p_brand, '-', p_partkey, ' x')")).alias("identifier"), t.title_key(title).alias("title")
    )


BRANDED = "concat('used ', CASE p_size % 6 WHEN 0 THEN 'Kawasaki Ninja' WHEN 1 THEN 'CF Moto 450' WHEN 2 THEN 'scrambler' WHEN 3 THEN 'Can-Am Ryker' WHEN 4 THEN 'Gas Gas EC' ELSE 'nothing' END, ' ', p_size)"
BRAND_CASE = "CASE " + " ".join(f"WHEN contains(n, '{b}') THEN '{b}'" for b in sorted(BRANDS, key=lambda b: (-len(b), b[::1]), reverse=False)) + " END"


@query("f9_brand_in_name", f"SELECT p_partkey, CASE b WHEN 'cf moto' THEN 'cfmoto' WHEN 'gas gas' THEN 'gasgas' WHEN 'sur ron' THEN 'surron' ELSE b END AS brand FROM (SELECT p_partkey, {BRAND_CASE} AS b FROM (SELECT p_partkey, {deep(BRANDED)} AS n FROM part))")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.aliased_brand(t.brand_in(t.deep_normalize(F.expr(BRANDED)))).alias("brand"))


@query("f11_model_core", f"SELECT p_partkey, CASE WHEN c <> '' THEN trim(regexp_replace(c, '\\s+', ' ', 'g')) ELSE string_split(m, ' ')[1] END AS core FROM (SELECT p_partkey, m, regexp_extract(m, '^(.*?\\b[0-9]+)\\b', 1) AS c FROM (SELECT p_partkey, {deep(PAINTED)} AS m FROM part))")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.model_core(t.deep_normalize(F.expr(PAINTED))).alias("core"))


LABEL = "CASE p_size % 6 WHEN 0 THEN 'Neuf' WHEN 1 THEN 'Usagé' WHEN 2 THEN 'Démo' WHEN 3 THEN 'pre-owned' WHEN 4 THEN 'brand new' ELSE '' END"


@query("f13_state_family", f"SELECT p_partkey, CASE WHEN regexp_matches(x, 'occas|usag|used|pre.?owned|d[ée]mo') THEN 'occasion' WHEN regexp_matches(x, 'neuf|new') THEN 'neuf' END AS state FROM (SELECT p_partkey, lower({LABEL}) AS x FROM part)")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", v.state_family(F.expr(LABEL)).alias("state"))


VEHICLE_URL = "concat('https://x.com/', CASE p_size % 7 WHEN 0 THEN 'motocyclette' WHEN 1 THEN 'atv' WHEN 2 THEN 'motoneiges' WHEN 3 THEN 'boat' WHEN 4 THEN 'argo' ELSE 'p' END, '/', p_partkey)"
VEHICLE_NAME = "CASE p_size % 5 WHEN 0 THEN 'Ninja 500' WHEN 1 THEN 'Brute Force 300' WHEN 2 THEN 'Teryx' WHEN 3 THEN 'Jet Ski Ultra' ELSE p_name END"


def vehicle_sql() -> str:
    rules = [f"WHEN regexp_matches(u, '{p}') THEN '{k}'" for k, p in v.VEHICLE_URLS] + [f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in v.VEHICLE_NAMES]
    return f"SELECT p_partkey, CASE {' '.join(rules)} ELSE 'autre' END AS vehicle_type FROM (SELECT p_partkey, lower({VEHICLE_URL}) AS u, lower({VEHICLE_NAME}) AS n FROM part)"


@query("f15_vehicle_type", vehicle_sql())
def f15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", v.vehicle_type(F.expr(VEHICLE_URL), F.expr(VEHICLE_NAME)).alias("vehicle_type"))


@query("f16_format_price", "SELECT o_orderkey, replace(format('{:,.2f}', o_totalprice), ',', ' ') || ' $' AS price FROM orders")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", v.formatted_price(F.col("o_totalprice")).alias("price"))


@query("f17_slug", f"SELECT p_partkey, regexp_replace(regexp_replace({PLAIN.format(f'lower({PAINTED})')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.slug(F.expr(PAINTED)).alias("slug"))


@query("f18_short_md5", SQL + " SELECT unit_key, substr(md5(name || '|' || etat), 1, 12) AS k FROM listing")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).select("unit_key", v.short_md5(F.concat_ws("|", "name", "etat")).alias("k"))


UNIT = {"vin": "CASE p_size % 5 WHEN 0 THEN concat(' vin00000', p_partkey) ELSE 'short' END", "stock": "CASE p_size % 5 WHEN 1 THEN concat('ins', p_partkey) ELSE ' ' END", "url": "CASE p_size % 5 WHEN 2 THEN concat('https://x.com/a-vendre-INS', p_size, '/') WHEN 3 THEN 'https://x.com/page/' ELSE '' END"}


@query(
    "f19_unit_key",
    f"""SELECT p_partkey, coalesce(CASE WHEN length(vin) >= 10 THEN vin END, nullif(stock, ''), nullif(lower(regexp_extract(url, '(?i)-([a-z]{{0,8}}[0-9]{{1,10}})$', 1)), ''), nullif(url, ''), substr(md5(lower(trim(p_name)) || '|' || lower(trim(p_brand))), 1, 12)) AS unit_key
    FROM (SELECT *, upper(trim({UNIT['vin']})) AS vin, trim({UNIT['stock']}) AS stock, regexp_replace({UNIT['url']}, '/+$', '') AS url FROM part)""",
)
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", v.unit_key(F.expr(UNIT["vin"]), F.expr(UNIT["stock"]), F.expr(UNIT["url"]), F.col("p_name"), F.col("p_brand")).alias("unit_key"))


@query("f21_excerpt", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS excerpt FROM documents")
def f21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.col("text")).alias("excerpt"))


WRITTEN = "CASE o_orderkey % 5 WHEN 0 THEN '1 234,56 $' WHEN 1 THEN '$12,345.60' WHEN 2 THEN '8.995,00 EUR' WHEN 3 THEN '12,345' ELSE 'call us' END"
PARSED = """TRY_CAST(CASE WHEN contains(x, ',') AND contains(x, '.') AND strpos(reverse(x), ',') < strpos(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.') WHEN contains(x, ',') AND contains(x, '.') THEN replace(x, ',', '')
 WHEN regexp_matches(x, '^[0-9]+([,.][0-9]{3})+$') THEN regexp_replace(x, '[,.]', '', 'g') ELSE replace(x, ',', '.') END AS DOUBLE)"""


@query("f23_parse_price", f"SELECT o_orderkey, {PARSED} AS price FROM (SELECT o_orderkey, regexp_replace({WRITTEN}, '[^0-9,.]', '', 'g') AS x FROM orders)")
def f23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", v.parsed_price(F.expr(WRITTEN)).alias("price"))


@query("f26_guarded_cast", "SELECT o_orderkey, CASE WHEN regexp_matches(s, '^-?[0-9.]+$') THEN TRY_CAST(s AS DOUBLE) END AS n FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN '1.2.3' WHEN 2 THEN '-7' ELSE 'n/a' END AS s FROM orders)")
def f26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", v.guarded_number(F.expr("CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN '1.2.3' WHEN 2 THEN '-7' ELSE 'n/a' END")).alias("n"))


@query("f27_currency", f"SELECT o_orderkey, CASE WHEN regexp_matches(x, 'US\\$|USD') THEN 'USD' WHEN regexp_matches(x, '€|EUR') THEN 'EUR' WHEN regexp_matches(x, '£|GBP') THEN 'GBP' WHEN regexp_matches(x, '\\$|CAD') THEN 'CAD' END AS currency FROM (SELECT o_orderkey, upper({WRITTEN}) AS x FROM orders)")
def f27(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", v.currency(F.expr(WRITTEN)).alias("currency"))


@query("f28_percent_and_rounding", "SELECT event_id, floor((value - 50) * 10 + 0.5) / 10 AS half_up, CASE WHEN user_id <> 0 THEN round((value - user_id) / user_id * 100, 4) END AS pct FROM events")
def f28(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", v.half_up(F.col("value") - 50, 1).alias("half_up"), F.round(v.percent_change(F.col("user_id").cast("double"), F.col("value")), 4).alias("pct"))


def depreciation_sql(phases: str) -> str:
    out, before = [], 0
    for until, rate in DEPRECIATION[phases]:
        out.append(f"pow({1 - rate!r}, greatest(0, least(age, {until}) - {before}))")
        before = until
    return " * ".join(out)


@query("f31_depreciation", SQL + f" SELECT unit_key, round(prix * {depreciation_sql('powersport')}, 4) AS left_powersport, round(prix * {depreciation_sql('truck')}, 4) AS left_truck FROM (SELECT *, 2003 - annee AS age FROM listing)")
def f31(spark: SparkSession, d: str) -> DataFrame:
    age = F.lit(2003) - F.col("annee")
    return listing(spark, d).select("unit_key", F.round(F.col("prix") * v.depreciated(age), 4).alias("left_powersport"), F.round(F.col("prix") * v.depreciated(age, "truck"), 4).alias("left_truck"))


@query("f_year_from_url", "SELECT page_id, coalesce(TRY_CAST(regexp_extract(u, '[/-](20[12][0-9])(?:[/-]|\\.html|$)', 1) AS INTEGER), CASE WHEN TRY_CAST(regexp_extract(u, '[/-]((?:19|20)[0-9]{2})(?:[/-]|\\.html|$)', 1) AS INTEGER) BETWEEN 1990 AND 2100 THEN TRY_CAST(regexp_extract(u, '[/-]((?:19|20)[0-9]{2})(?:[/-]|\\.html|$)', 1) AS INTEGER) END) AS year FROM (SELECT page_id, concat('https://x.com/ninja-', 1990 + page_id % 40, '/') AS u FROM pages)")
def f_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", v.year_in_url(F.expr("concat('https://x.com/ninja-', 1990 + page_id % 40, '/')")).alias("year"))


@query("f_iso_week_day", "SELECT event_id, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m-%d') AS day, CAST(isodow(ts) AS INTEGER) AS dow FROM events")
def f_week(spark: SparkSession, d: str) -> DataFrame:
    week = F.concat(F.expr("extract(YEAROFWEEK FROM ts)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return table(spark, d, "events").select("event_id", week.alias("week"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.weekday("ts") + 1).alias("dow"))


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1)), '^www\\.', '')"


@query("f_url_host", f"SELECT page_id, {HOST_SQL} AS host, nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/(fr|en|es|de)(?:/|$)', 1), '') AS lang FROM pages")
def f_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", v.host(F.col("url")).alias("host"), v.url_language(F.col("url")).alias("lang"))


URL_KEY_SQL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:{v.TRACKING}|page)=[^&]*&?)+', '\\1', 'g'), '[?&]+$', ''), '/+$', '')"


@query("f_url_key", f"SELECT page_id, {URL_KEY_SQL} AS url_key FROM pages")
def f_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", v.url_key(F.col("url")).alias("url_key"))


@query("f_json_scalar", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
