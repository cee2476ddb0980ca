"""Rules of listings, pages, alerts and runs in full: predicates, joins, aggregates and state whose SQL reads the same for Spark and DuckDB.

Words and numbers that decide results are fixed values, kept in tables; the SQL is built from them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed_mojibake
from .listing import SQL, table
from .relational import STEP, views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Spark's name of a function -> DuckDB's.
NAMES = {"regexp_like(": "regexp_matches(", "split(": "string_split(", "array_size(": "len("}


def add(name: str, text: str, duck: str | None = None) -> None:
    """One text; ``duck`` where more than names part."""
    QUERIES[name] = lambda spark, d: spark.sql(text, **views(spark, d, text))
    own = duck or text
    for ours, theirs in NAMES.items():
        own = own if duck else own.replace(ours, theirs)
    reads_listing = "{listing}" in own
    own = re.sub(r"\{(\w+)\}", r"\1", own).strip()
    ORACLE[name] = (SQL + ("," + own[4:] if own.upper().startswith("WITH") else " " + own)) if reads_listing else own


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def share(tests: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests) + ")"


# --- predicates -----------------------------------------------------------------------------------------------------------------
SANE = "BETWEEN 1 AND 1000000"
PRICES = ("prix", "total", "was")
add(
    "p2_sanitize_price",
    f"SELECT site, {' + '.join(f'count(*) FILTER (WHERE NOT {x} {SANE})' for x in PRICES)} AS rejected, {', '.join(f'count(*) FILTER (WHERE {x} {SANE}) AS n_{x}' for x in PRICES)}, round(avg(CASE WHEN total {SANE} THEN total END), 4) AS mean_total FROM (SELECT site, prix, prix * 800 AS total, prix - 900 AS was FROM {{listing}}) GROUP BY site",
)

HOST = "replace(regexp_extract(lower(u), '^[a-z]+://([^/:?#]+)', 1), 'www.', '')"
add(
    "p4_site_filter",
    f"SELECT page_id FROM (SELECT page_id, u, {HOST} AS h FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN substr(url, instr(url, '://') + 3) ELSE url END AS u FROM {{pages}})) WHERE CASE WHEN h <> '' THEN h = 'blog.tionsh.example.net' ELSE contains(lower(u), 'blog.tionsh.example.net') END",
)

# Endings and path parts that no product page has, and path parts that say a page is one.
NO_PRODUCT_ENDINGS = "pdf jpg jpeg png gif svg webp ico css js xml txt".split()
NO_PRODUCT_PARTS = (
    "/blog /contact /about /a-propos /politique /privacy /terms /conditions /emploi /carrieres /careers /nouvelles /news /tag/ /category/ /wp-content/ /page/ /css/ /js/ /images/ /assets/ /fonts/ "
    "/login /account /compte /cart /panier /checkout /wishlist /favoris /comparer /compare /service/ /financement/ /pieces/ /parts/ /equipe/ /team/ /promotions/ /promotion/ /store-locator /magasins /boutiques "
    "/shipping /livraison /returns /retour /faq /aide /help /support /gallery /galerie /photos /media /heures /hours /directions /map /carte /temoignages /testimonials /reviews "
    "/calculator /calculatrice /mortgage /hypotheque /agents /courtiers /gift-card /carte-cadeau"
).split()
PRODUCT_PARTS = (
    "/neuf/ /neufs/ /occasion/ /occasions/ /usage/ /usages/ /inventory/ /inventaire/ /vehicle/ /vehicule/ /moto/ /motoneige/ /vtt/ /quad/ /side-by-side/ /new/ /used/ /certified/ /pre-owned/ /cars/ /trucks/ /suv/ /sedan/ "
    "/voiture/ /camion/ /vus/ /listing/ /stock/ /vin/ /products/ /product/ /produit/ /produits/ /p/ /-p- /item/ /detail/ /collections/ /property/ /propriete/ /maison/ /condo/ /mls /jobs/ /job/ /emploi/ /emplois/ /career/ /posting/"
).split()
#: A product's number or name in a path.
DETAIL = ["-id[0-9]+/?$", "-a-vendre-[0-9]+/?$", "/[0-9]+-[a-z]", "/(new|used|neuf|occasion|usage|usages)/([0-9][0-9][0-9][0-9]-|[a-z]+-[a-z])"]
#: Pages with a product's or another page's path behind.
PATHS = "lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) || CASE page_id % 8 WHEN 0 THEN '/neuf/2024-honda' WHEN 1 THEN '-a-vendre-825' WHEN 2 THEN '/photo.jpg' WHEN 3 THEN '/15-honda-cbr' WHEN 4 THEN '/contact' WHEN 5 THEN '/products/x' ELSE '' END"
add(
    "p5_product_url",
    f"""SELECT page_id, p NOT IN ('', '/', '/fr', '/fr/', '/en', '/en/') AND NOT regexp_like(p, '[.]({'|'.join(NO_PRODUCT_ENDINGS)})$') AND NOT {any_of('p', NO_PRODUCT_PARTS)}
    AND (regexp_like(p, '^/fr/[0-9]+/?$') OR {any_of('p', PRODUCT_PARTS)} OR {' OR '.join(f"regexp_like(p, '{x}')" for x in DETAIL)}) AS is_product FROM (SELECT page_id, {PATHS} AS p FROM {{pages}})""",
)

# Words of catalogue pages.
CATALOGUE = ["catalogue", "catalog", "modele", "model", "gamme", "range"]
SHOWN_URL = "lower(url) || CASE page_id % 3 WHEN 0 THEN '/catalogue' WHEN 1 THEN '/inventaire' ELSE '' END"
add(
    "p7_url_category_filter",
    f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, NOT {any_of('v', CATALOGUE)} AS kept FROM (SELECT page_id, url, {SHOWN_URL} AS v FROM {{pages}})), h AS (SELECT host AS h, max(CASE WHEN kept THEN 1 ELSE 0 END) AS any_kept FROM u GROUP BY host)
    SELECT 'stock' AS categories, page_id FROM u JOIN h ON host = h WHERE kept OR any_kept = 0 UNION ALL SELECT 'all', page_id FROM u""",
)

# Words before a bar in titles of pages that are no product.
PAGE_WORDS = "blog blogue service contact team équipe equipe parts accessories pièces pieces accessoires sell vendez vendre guide formation entretien réparation reparation maintenance promotion promotions crédit credit dealership concessionnaire rencontrez achetez financing financement privacy confidentialité politique terms termes conditions offer offers".split()
PAGE_PHRASES = ["meet the", "no credit", "aucun crédit", "purchase your"]
TITLES = "concat(CASE p_size % 6 WHEN 0 THEN 'New ' WHEN 1 THEN 'Used 2019 ' WHEN 2 THEN 'Meet the ' WHEN 3 THEN 'Service ' ELSE '' END, p_name, CASE p_size % 5 WHEN 0 THEN ' neufs' WHEN 1 THEN ' usagées' ELSE '' END, CASE p_size % 3 WHEN 0 THEN '' ELSE ' | Dealer' END)"
add(
    "p8_listing_page_product",
    f"""SELECT p_partkey FROM (SELECT p_partkey, p_size, contains(t, '|') AS bar, trim(regexp_extract(lower(t), '^([^|]*)', 1)) AS b FROM (SELECT p_partkey, p_size, {TITLES} AS t FROM {{part}})) WHERE bar AND (
    (regexp_like(b, '^(new|used|neuf|usagée?s?|usages?|tous|all) ') AND NOT regexp_like(b, '(^|[^0-9a-z])(19|20)[0-9][0-9]([^0-9a-z]|$)')) OR regexp_like(b, '(^| )(neufs?|usag.?.?.?e?s?)( +(. )?[a-z]+)?$') OR regexp_like(b, '(^|[^a-zé])({'|'.join([*PAGE_WORDS, *PAGE_PHRASES])})([^a-zé]|$)'))""",
)

#: What adapters serve, by the routing rule: a chosen category asks for adapters that serve it or something above or below it.
ADAPTERS = [("powersport", "vehicule.moto", "moto"), ("auto", "vehicule", "auto"), ("market", "*", ""), ("home", "maison", ""), ("open", "", "")]
CHOSEN = "CASE p_size % 4 WHEN 0 THEN 'vehicule.moto.sport' WHEN 1 THEN 'maison' ELSE '' END"
add(
    "p18_source_routing",
    f"""SELECT p_partkey, adapter, CASE WHEN want <> '' AND serves <> '' THEN serves = '*' OR want = serves OR starts_with(want, serves || '.') OR starts_with(serves, want || '.') WHEN kinds = '' THEN true ELSE kind IS NULL OR kind = kinds END AS applies
    FROM (SELECT p_partkey, {CHOSEN} AS want, CASE p_size % 3 WHEN 0 THEN 'moto' WHEN 1 THEN 'auto' END AS kind FROM {{part}}) JOIN (VALUES {', '.join(map(str, ADAPTERS))}) AS a(adapter, serves, kinds) ON true""".replace("starts_with(", "startswith("),
    f"""SELECT p_partkey, adapter, CASE WHEN want <> '' AND serves <> '' THEN serves = '*' OR want = serves OR starts_with(want, serves || '.') OR starts_with(serves, want || '.') WHEN kinds = '' THEN true ELSE kind IS NULL OR kind = kinds END AS applies
    FROM (SELECT p_partkey, {CHOSEN} AS want, CASE p_size % 3 WHEN 0 THEN 'moto' WHEN 1 THEN 'auto' END AS kind FROM {{part}}) CROSS JOIN (VALUES {', '.join(map(str, ADAPTERS))}) AS a(adapter, serves, kinds)""",
)

#: Alerts: by interval (its own minutes or hours, else 40 minutes; five minutes early is on time), daily at an hour, or else every 40 minutes.
NOW = "TIMESTAMP '2024-01-30 08:10:00'"
WAIT = "CASE kind WHEN 'interval' THEN coalesce(nullif(every_min, 0), 60 * nullif(every_h, 0), 40) ELSE 40 END - 5"
add(
    "p19_alert_due",
    f"""SELECT user_id, kind, CASE WHEN kind = 'daily' THEN coalesce(at_hour, 8) = hour({NOW}) ELSE last IS NULL OR {NOW} >= last + ({WAIT}) * INTERVAL 1 MINUTE END AS due FROM (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'interval' WHEN 1 THEN 'daily' ELSE '' END AS kind,
    CASE WHEN user_id % 2 = 0 THEN user_id % 60 END AS every_min, CASE WHEN user_id % 5 = 0 THEN 6 END AS every_h, CASE WHEN user_id % 7 > 2 THEN user_id % 24 END AS at_hour, CASE WHEN user_id % 11 > 0 THEN max(ts) END AS last FROM {{events}} GROUP BY user_id)""",
)

# Words of part listings' titles and categories.
PART_WORDS = "adapter bearing bracket brake cable caliper cap case chain clutch cover crank crankshaft cylinder exhaust filter fork gasket graphics handlebar kit lever mount oem piston plastics radiator rebuild reed ring seat shock silencer sprocket valve wheel".split()
PART_CATEGORIES = ["accessories", "components", "parts", "piston", "rebuild", "rings", "scooter parts"]
PART_CATEGORY = "CASE WHEN p_size % 9 = 0 THEN 'Scooter Parts' ELSE p_type END"
add(
    "p21_part_listing",
    f"SELECT p_partkey FROM {{part}} WHERE {any_of(f'lower({PART_CATEGORY})', PART_CATEGORIES)} OR arrays_overlap(split(regexp_replace(lower(p_name), '[^a-z]+', ' '), ' '), array({', '.join(map(repr, PART_WORDS))}))",
    f"SELECT p_partkey FROM {{part}} WHERE {any_of(f'lower({PART_CATEGORY})', PART_CATEGORIES)} OR list_has_any(string_split(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g'), ' '), {PART_WORDS})",
)

#: Conditions of fields: the values that a product must have, one or several, for the field to apply.
CONDITIONS = {"mileage": {"etat": ["occasion", "Demonstrateur"]}, "stock": {"disponibilite": ["f"], "etat": ["neuf"]}, "price": {}}
add(
    "p22_field_applies",
    "SELECT unit_key, " + ", ".join((" AND ".join(f"coalesce(lower(trim({c})) IN ({', '.join(repr(v.strip().lower()) for v in values)}), false)" for c, values in of.items()) or "true") + f" AS {name}" for name, of in CONDITIONS.items()) + " FROM {listing}",
)

#: Queries: of words that aren't numbers 60 % must be there, with spaces or without; a number as a whole, and then (up to four words) all.
GATES = {"red small": ["red", "small"], "blue widget 13": ["blue", "widget", "13"], "hot gear ring bolt anvil": ["hot", "gear", "ring", "bolt", "anvil"]}
HAY = "(SELECT unit_key, lower(concat_ws(' ', name, marque, modele)) AS h, replace(lower(concat_ws(' ', name, marque, modele)), ' ', '') AS c FROM {listing})"


def gate(words: list[str]) -> str:
    tests = [f"regexp_like(h, '(^|[^0-9]){w}([^0-9]|$)')" if w.isdigit() else f"(contains(h, '{w}') OR contains(c, '{w}'))" for w in words]
    need = 1 if any(map(str.isdigit, words)) and len(words) <= 4 else 0.6
    return f"{share(tests)} >= {need} * {len(words)}"


add("p23_relevance_gate", " UNION ALL ".join(f"SELECT '{q}' AS query, unit_key FROM {HAY} AS x WHERE {gate(words)}" for q, words in GATES.items()))

# --- joins ------------------------------------------------------------------------------------------------------------------------
KINDS = ("gtin", "upc", "ean", "mpn")
#: Listings' identifiers, the cross-reference table and the catalogue's own columns; of each kind the table comes first.
add(
    "j10_identifier_cascade",
    f"""WITH want AS (SELECT k, t, pr, v FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey AS p, l_suppkey AS s FROM {{lineitem}}) JOIN (VALUES {', '.join(f"('{t}', {n})" for n, t in enumerate(KINDS))}) AS i(t, pr) ON (p + pr) % 3 > 0 JOIN (SELECT p_partkey AS pk, 'x' || p_partkey AS v FROM {{part}}) ON pk = CASE t WHEN 'gtin' THEN p WHEN 'upc' THEN s WHEN 'ean' THEN p + 1 ELSE p - 1 END),
    crossref AS (SELECT t, 'x' || p_partkey AS v, p_partkey + 100000 AS c FROM {{part}} JOIN (VALUES ('gtin'), ('ean')) AS i(t) ON p_size % 5 = 0), own AS (SELECT t, 'x' || p_partkey AS v, p_partkey AS c FROM {{part}} JOIN (VALUES ('upc'), ('ean'), ('mpn')) AS i(t) ON p_size % 5 < 3)
    SELECT k, t AS id_type, c AS canonical FROM (SELECT k, t, c, row_number() OVER (PARTITION BY k ORDER BY pr, src, c) AS rn FROM (SELECT k, w.t, pr, 0 AS src, x.c FROM want w JOIN crossref x ON x.t = w.t AND x.v = w.v UNION ALL SELECT k, w.t, pr, 1, o.c FROM want w JOIN own o ON o.t = w.t AND o.v = w.v)) WHERE rn = 1""",
)
add("j11_vin_prefix", "SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, upper(substr(lpad(CAST(o_custkey AS VARCHAR(10)), 6, '0') || 'jkaex8a1234', 1, 11)) AS vp FROM {orders}) JOIN (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR(10)), 6, '0') || 'JKAEX' AS wp FROM {part}) ON vp = wp")
add(
    "j16_existing_listing",
    """SELECT o_orderkey, coalesce(a.k, b.k) AS found, CASE WHEN a.k IS NOT NULL THEN 'source_id' WHEN b.k IS NOT NULL THEN 'vin' END AS via FROM {orders}
    LEFT JOIN (SELECT c_custkey AS k, c_custkey AS sp, c_nationkey AS ds FROM {customer}) a ON a.sp = o_custkey AND a.ds = o_orderkey % 25
    LEFT JOIN (SELECT c_custkey AS k, c_name AS vin FROM {customer}) b ON b.vin = 'Customer#' || (o_custkey + 1)""",
)
# Path parts in French and in English.
TRANSLATED = [("/fr/", "/en/"), ("/neuf/", "/new/"), ("/usage/", "/used/"), ("/motocyclette/", "/motorcycle/"), ("/vtt/", "/atv/"), ("/cote-a-cote/", "/side-by-side/"), ("/ponton/", "/pontoon/"), ("/motoneige/", "/snowmobile/"), ("/inventaire/", "/inventory/"), ("/3-roues/", "/3-wheel-motorcycle/"), ("/moteur-hors-bord/", "/outboard-motor/")]


def translated(x: str) -> str:
    for fr, en in TRANSLATED:
        x = f"replace({x}, '{fr}', '{en}')"
    return x


#: Each page in both languages: a host is bilingual with ten pages or more of either, at least four of one to ten of the other. Of twins the French stays.
add(
    "j27_bilingual_pairs",
    f"""WITH u AS (SELECT host, url, min(id) AS id, {translated('url')} AS en FROM (SELECT page_id * 2 + 1 AS id, 'h' || page_id % 7 AS host, 'h' || page_id % 7 || '/en/new/' || page_id % 40 AS url FROM {{pages}} WHERE page_id % 7 < 5 OR page_id % 2 = 0 UNION ALL SELECT page_id * 2, 'h' || page_id % 7, 'h' || page_id % 7 || '/fr/neuf/' || page_id % 50 FROM {{pages}} WHERE page_id % 7 <> 3) GROUP BY host, url),
    two AS (SELECT host AS h2 FROM (SELECT host, count(*) AS n, count(*) FILTER (WHERE contains(url, '/fr/')) AS f, count(*) FILTER (WHERE contains(url, '/en/')) AS e FROM u GROUP BY host) WHERE n >= 20 AND f >= 10 AND e >= 10 AND least(f, e) >= 0.4 * greatest(f, e)),
    twin AS (SELECT DISTINCT host AS h3, en AS twin FROM u WHERE contains(url, '/fr/')) SELECT u.id, url FROM u LEFT JOIN two ON host = h2 LEFT JOIN twin ON host = h3 AND url = twin AND contains(url, '/en/') WHERE h2 IS NULL OR twin IS NULL""",
)

# --- aggregates ------------------------------------------------------------------------------------------------------------------
WEEK, MONTH = "TIMESTAMP '2024-01-23 00:00:00'", "TIMESTAMP '2024-01-10 00:00:00'"
RUNS = f"count(*) FILTER (WHERE ts >= {WEEK}) AS runs_7d, count(*) AS runs_30d, round(sum(CASE WHEN ts >= {WEEK} THEN value ELSE 0 END), 2) AS cost_7d, round(sum(value), 2) AS cost_30d, round(avg(CASE WHEN ts >= {WEEK} THEN value END), 6) AS mean_7d, round(avg(value), 6) AS mean_30d, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS share_hybrid, round(count(*) FILTER (WHERE event_type = 'view') / count(*), 6) AS share_full"
add(
    "a17_cost_rollup",
    f"SELECT user_id, {RUNS}, max_by(event_id, named_struct('t', ts, 'i', event_id)) AS latest FROM {{events}} WHERE ts >= {MONTH} AND value IS NOT NULL GROUP BY user_id",
    f"SELECT user_id, {RUNS}, max_by(event_id, (ts, event_id)) AS latest FROM {{events}} WHERE ts >= {MONTH} AND value IS NOT NULL GROUP BY user_id",
)
#: Fields with weight, threshold of coverage and the condition under which they are expected; prices and years within ranges; a base of 5 and 3 without mojibake.
FIELDS = [("name", 3, 0.9, "true"), ("prix", 3, 0.8, "true"), ("modele", 2, 0.9, "true"), ("km", 2, 0.5, "etat = 'occasion'")]


def quality() -> str:
    total = sum(x[1] for x in FIELDS)
    parts = []
    for field, weight, threshold, test in FIELDS:
        n, have = f"count(*) FILTER (WHERE {test})", f"count(*) FILTER (WHERE {test} AND {field} IS NOT NULL)"
        parts.append(f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, {have} / {n} / {threshold}) END * {50 * weight} / {total}")
    within = lambda x, a, b: f"CASE WHEN count({x}) = 0 THEN 5.0 ELSE count(*) FILTER (WHERE {x} BETWEEN {a} AND {b}) / count({x}) * 5.0 END"
    return f"least(1.0, count(*) / greatest(1, max(attempted))) * 30 + {' + '.join(parts)} + {within('prix', 500, 1500)} + {within('annee', 1996, 2026)} + 5 + CASE WHEN count(*) FILTER (WHERE contains(name, 'Ã©')) = 0 THEN 3 ELSE 0 END"


add(
    "a22_quality_score",
    f"""SELECT site, round(score, 6) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM (SELECT site, CAST({quality()} AS DOUBLE) AS score FROM (SELECT site, name, annee, etat, CASE WHEN ord % 7 > 0 THEN prix END AS prix, CASE WHEN ord % 9 > 0 THEN modele END AS modele,
    CASE WHEN ord % 3 = 0 THEN ord END AS km, 50 AS attempted FROM {{listing}}) GROUP BY site)""",
)
ACTIVE = "(SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE))"
add(
    "a25_peak_day",
    f"SELECT user_id, max(n) AS peak, min(CASE WHEN n = top THEN day END) AS peak_day, round(avg(n), 6) AS mean_active, CAST(sum(CASE WHEN nth <= 30 THEN n ELSE 0 END) AS BIGINT) AS last_30 FROM (SELECT user_id, day, n, max(n) OVER (PARTITION BY user_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS nth FROM {ACTIVE} AS d) GROUP BY user_id",
)
add(
    "a31_centroid",
    "SELECT p_type, p_brand, w AS word FROM (SELECT p_type, p_brand, w, count(*) AS c FROM (SELECT DISTINCT p_partkey, p_type, p_brand, w FROM {part} LATERAL VIEW explode(split(p_name, ' ')) t AS w) GROUP BY p_type, p_brand, w) JOIN (SELECT p_type AS t2, p_brand AS b2, count(*) AS n FROM {part} GROUP BY p_type, p_brand) ON p_type = t2 AND p_brand = b2 WHERE c >= greatest(1, floor(n / 2))",
    "SELECT p_type, p_brand, w AS word FROM (SELECT p_type, p_brand, w, count(*) AS c FROM (SELECT DISTINCT p_partkey, p_type, p_brand, unnest(string_split(p_name, ' ')) AS w FROM {part}) GROUP BY p_type, p_brand, w) JOIN (SELECT p_type AS t2, p_brand AS b2, count(*) AS n FROM {part} GROUP BY p_type, p_brand) ON p_type = t2 AND p_brand = b2 WHERE c >= greatest(1, floor(n / 2))",
)
# Words of inventory paths.
INVENTORY = ["inventaire", "inventory", "occasion", "usage", "used", "pre-owned", "pre-possede", "vehicules-occasion"]
STOCK_PATH = "CASE page_id % 4 WHEN 0 THEN '/inventaire/x' WHEN 1 THEN '/used-bikes/inventaire/' || page_id WHEN 2 THEN '/occasion/y' ELSE '/p/' || page_id END"
add(
    "a32_url_segments",
    f"WITH u AS (SELECT page_id % 11 AS site, {STOCK_PATH} AS p FROM {{pages}}) SELECT site, seg, n FROM (SELECT site, seg, count(*) AS n FROM (SELECT site, seg FROM u LATERAL VIEW explode(split(p, '/')) t AS seg) WHERE {any_of('seg', INVENTORY)} GROUP BY site, seg) JOIN (SELECT site AS s2, count(*) AS urls FROM u GROUP BY site) ON site = s2 WHERE n >= greatest(urls * 0.3, 2)",
    f"WITH u AS (SELECT page_id % 11 AS site, {STOCK_PATH} AS p FROM {{pages}}) SELECT site, seg, n FROM (SELECT site, seg, count(*) AS n FROM (SELECT site, unnest(string_split(p, '/')) AS seg FROM u) WHERE {any_of('seg', INVENTORY)} GROUP BY site, seg) JOIN (SELECT site AS s2, count(*) AS urls FROM u GROUP BY site) ON site = s2 WHERE n >= greatest(urls * 0.3, 2)",
)
PHASES = ("click", "error", "purchase", "signup", "view")
add(
    "a42_cost_tiers",
    f"SELECT user_id, CASE WHEN avg(value) >= 25 THEN 'pass' WHEN avg(value) >= 20 THEN 'warn' ELSE 'fail' END AS verdict, {', '.join(f'''round(sum(CASE WHEN event_type = '{p}' THEN value ELSE 0 END), 3) AS cost_{p}''' for p in PHASES)}, round(sum(CASE WHEN event_type IS NULL THEN value ELSE 0 END), 3) AS cost_unknown FROM {{events}} GROUP BY user_id",
)
#: Hints of kinds of sites: JSON-LD types 10 each, URL patterns by weight, page words 1 each; the first largest wins, below 3 none.
HINTS = {"vehicle": (["\"Vehicle\""], [("/moto", 4), ("example.com", 2)], ["the", "nav", "article"]), "shop": (["\"Product\""], [("/product", 4), (".org", 3)], ["table", "form", "cart"]), "news": (["\"NewsArticle\""], [("blog.", 5)], ["article", "<p>"])}


def votes(of: tuple) -> str:
    types, urls, words = of
    return " + ".join([f"CASE WHEN contains(html, '{x}') THEN 10 ELSE 0 END" for x in types] + [f"CASE WHEN contains(url, '{x}') THEN {n} ELSE 0 END" for x, n in urls] + [f"CASE WHEN contains(lower(substr(html, 1, 200000)), '{x}') THEN 1 ELSE 0 END" for x in words])


BEST = "greatest(vehicle, shop, news)"
add("a45_weighted_vote", f"SELECT page_id, CASE WHEN {BEST} < 3 THEN 'generic' WHEN vehicle = {BEST} THEN 'vehicle' WHEN shop = {BEST} THEN 'shop' ELSE 'news' END AS kind FROM (SELECT page_id, {', '.join(f'{votes(of)} AS {k}' for k, of in HINTS.items())} FROM {{pages}})")

# --- windows, order, dedup ----------------------------------------------------------------------------------------------------------
#: A product's first and last price, at the first site (by first observation) that has two or more, else at any.
add(
    "w6_first_last",
    """WITH s AS (SELECT product, site, count(*) AS n, min(named_struct('t', scraped_at, 'o', ord, 'k', unit_key, 'p', prix)) AS f, max(named_struct('t', scraped_at, 'o', ord, 'k', unit_key, 'p', prix)) AS l FROM {listing} WHERE prix > 0 GROUP BY product, site),
    g AS (SELECT product, sum(n) AS n, min(f) AS f, max(l) AS l, min_by(named_struct('f', f, 'l', l), CASE WHEN n >= 2 THEN f END) AS own, max(n) AS most FROM s GROUP BY product),
    x AS (SELECT product, CASE WHEN most >= 2 THEN own.f ELSE f END AS a, CASE WHEN most >= 2 THEN own.l ELSE l END AS b FROM g WHERE n >= 2), y AS (SELECT product, (b.p - a.p) / a.p * 100 AS pct FROM x WHERE a.t <> b.t AND abs((b.p - a.p) / a.p * 100) >= 1)
    SELECT product, round(pct, 6) AS pct, CASE WHEN pct < 0 THEN 'drop' ELSE 'increase' END AS side FROM (SELECT product, pct, row_number() OVER (PARTITION BY pct < 0 ORDER BY abs(pct) DESC, product) AS rn FROM y) WHERE rn <= 10""",
    """WITH o AS (SELECT *, count(*) OVER (PARTITION BY product, site) AS n, min((scraped_at, ord, unit_key)) OVER (PARTITION BY product, site) AS began FROM {listing} WHERE prix > 0),
    c AS (SELECT product, site, row_number() OVER (PARTITION BY product ORDER BY CASE WHEN n >= 2 THEN 0 ELSE 1 END, began) AS rn, max(n) OVER (PARTITION BY product) AS most FROM (SELECT DISTINCT product, site, n, began FROM o)),
    k AS (SELECT o.* FROM o JOIN (SELECT * FROM c WHERE rn = 1) c USING (product) WHERE most < 2 OR o.site = c.site),
    y AS (SELECT product, (b - a) / a * 100 AS pct FROM (SELECT product, min_by(prix, (scraped_at, ord, unit_key)) AS a, max_by(prix, (scraped_at, ord, unit_key)) AS b, count(*) AS n, min(scraped_at) AS t0, max(scraped_at) AS t1 FROM k GROUP BY product) WHERE n >= 2 AND t0 <> t1 AND abs((b - a) / a * 100) >= 1)
    SELECT product, round(pct, 6) AS pct, CASE WHEN pct < 0 THEN 'drop' ELSE 'increase' END AS side FROM (SELECT product, pct, row_number() OVER (PARTITION BY pct < 0 ORDER BY abs(pct) DESC, product) AS rn FROM y) WHERE rn <= 10""",
)
SPANS = ", ".join(f"round(avg(CASE WHEN ts BETWEEN e - INTERVAL {n} DAY AND e THEN value END), 6) AS now_{n}, round(avg(CASE WHEN ts BETWEEN e - INTERVAL {2 * n} DAY AND e - INTERVAL {n} DAY THEN value END), 6) AS before_{n}" for n in (7, 30))
add("w8_period_over_period", f"SELECT event_type, {SPANS} FROM {{events}} JOIN (SELECT max(ts) AS e FROM {{events}}) ON true GROUP BY event_type")
add(
    "t6_capped_changes",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, rank FROM {events} JOIN (SELECT user_id AS u, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id)) ON u = user_id) WHERE rn <= 200 AND rank <= 10",
)
add("t12_sort_nulls_as_zero", "SELECT c_custkey, round(abs(diff), 2) AS impact FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN t - 100 * c_acctbal END AS diff FROM {customer} LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey) ORDER BY coalesce(abs(diff), 0) DESC, c_custkey LIMIT 50")
#: New suggestions first, then what was remembered; each once, at most 50, none of fewer than three characters.
add(
    "t15_history_merge",
    "SELECT user_id, s, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pr, seen) AS INTEGER) AS place FROM (SELECT user_id, s, pr, seen, row_number() OVER (PARTITION BY user_id ORDER BY pr, seen) AS rn FROM (SELECT user_id, s, min(pr) AS pr, min(CASE WHEN pr = 0 THEN event_id ELSE event_id + 1000000000 END) AS seen FROM (SELECT user_id, event_id, event_type || ' ' || CAST(floor(value) AS BIGINT) AS s, CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN 0 ELSE 1 END AS pr FROM {events}) WHERE length(s) >= 3 GROUP BY user_id, s)) WHERE rn <= 50",
)
#: First of each URL, then of each stock number; a row that its URL drops keeps its number from no one.
add(
    "dd1_dedup_url",
    """WITH r AS (SELECT unit_key, ord, site, regexp_replace(CASE WHEN ord % 13 > 0 THEN 'u/' || product || '/' ELSE '' END, '/+$', '') AS url, CASE WHEN ord % 4 > 0 THEN CAST(product % 300 AS VARCHAR(9)) ELSE '' END AS inv FROM {listing}), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY ord, unit_key) AS ru FROM r) WHERE ru = 1 OR url = '')
    SELECT unit_key FROM (SELECT unit_key, inv, row_number() OVER (PARTITION BY site, inv ORDER BY ord, unit_key) AS ri FROM a) WHERE ri = 1 OR inv = ''""",
)
add(
    "dd4_keep_max_score",
    "SELECT k, max(score) AS top, max_by(page_id, named_struct('s', score, 'i', -page_id)) AS page_id FROM (SELECT page_id, lower(regexp_replace(split(url, '[?]')[0], '/+$', '')) AS k, length(html) % 97 AS score FROM {pages} WHERE url <> '') GROUP BY k",
    "SELECT k, max(score) AS top, max_by(page_id, (score, -page_id)) AS page_id FROM (SELECT page_id, lower(regexp_replace(string_split(url, '?')[1], '/+$', '')) AS k, CAST(length(html) % 97 AS INTEGER) AS score FROM {pages} WHERE url <> '') GROUP BY k",
)

# --- state, in batch form -----------------------------------------------------------------------------------------------------------
#: An update of a listing's price writes a row with the old price; the first insert writes none, an unchanged price neither.
add("st3_price_updates", f"SELECT site, product, y AS t, was AS previous, p AS prix FROM ({STEP}) WHERE was IS NOT NULL AND p <> was")
add(
    "st10_sessions",
    "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, round(avg(seconds), 3) AS mean_seconds FROM (SELECT user_id, count(*) AS n, CAST(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP)) AS DOUBLE) / 1000000 AS seconds FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')) GROUP BY user_id",
    "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, round(avg(seconds), 3) AS mean_seconds FROM (SELECT user_id, count(*) AS n, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 AS seconds FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM {events})) GROUP BY user_id, s) GROUP BY user_id",
)
#: Entries live seven days; a write renews them, and what is past its time at the last write is gone.
add("st11_ttl", "SELECT o_custkey, max(o_orderdate) + INTERVAL 7 DAY AS expires, count(*) AS writes, max(o_orderdate) + INTERVAL 7 DAY > TIMESTAMP '1998-01-01 00:00:00' AS alive FROM {orders} GROUP BY o_custkey")
#: A digest goes out at the user's hour where they live, unless one went out within the last twenty hours.
HERE = "from_utc_timestamp(ts, 'America/Toronto')"
DUE = "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT user_id, event_id, ts, {0} AS h FROM {{events}}) WHERE h = user_id % 24) WHERE was IS NULL OR ts >= was + INTERVAL 20 HOUR"
add("st13_local_hour", DUE.format(f"hour({HERE})"), DUE.format("hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto')"))

# --- flags of a site, by grouping: a site with a third of all rows is no single task ------------------------------------------------------
STOCK = "disponibilite = 'F' AND etat <> 'neuf'"
add("p10_catalogue_exclusion", f"SELECT unit_key FROM {{listing}} JOIN (SELECT site AS s2, max(CASE WHEN {STOCK} THEN 1 ELSE 0 END) AS any_kept FROM {{listing}} GROUP BY site) ON site = s2 WHERE ({STOCK}) OR any_kept = 0")
STRICT = "CASE WHEN etat = 'neuf' AND annee = 1998 THEN 1 ELSE 0 END"
add("t2_strict_then_relaxed", f"SELECT site, unit_key FROM (SELECT site, unit_key, row_number() OVER (PARTITION BY site ORDER BY prix, unit_key) AS rn FROM {{listing}} JOIN (SELECT site AS s2, max({STRICT}) AS any_kept FROM {{listing}} GROUP BY site) ON site = s2 WHERE {STRICT} = any_kept) WHERE rn <= 3")
add("t3_strict_suppresses_approximate", "SELECT site, CASE WHEN strict > 0 THEN strict ELSE n - strict END AS n FROM (SELECT site, count(*) AS n, count(*) FILTER (WHERE etat = 'neuf' AND annee = 1999) AS strict FROM {listing} GROUP BY site)")

# --- sources, scalars, valuation parts ---------------------------------------------------------------------------------------------------
# States of scraped products, and the specs that go along.
BRIDGE = {"neuf": "neuf", "occasion": "occasion", "demonstrateur": "demonstrateur", "usagé": "occasion", "usagee": "occasion", "certifié": "certifie"}
SPECS = ["cylindree", "kilometrage", "couleur", "transmission", "poids"]
SCRAPED = "CASE product % 6 WHEN 0 THEN 'Usagé' WHEN 1 THEN 'certifié' WHEN 2 THEN '' ELSE etat END"
STATES_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in BRIDGE.items())
SPECS_SQL = ", ".join(f"nullif({c}, '') AS spec_{c}" for c in SPECS)
add(
    "s8_scraper_bridge",
    f"SELECT unit_key, CASE lower(state) {STATES_SQL} ELSE 'inconnu' END AS condition, annee AS raw_year, {SPECS_SQL} FROM (SELECT unit_key, {SCRAPED} AS state, annee, CAST(product % 900 AS VARCHAR(9)) AS cylindree, CASE WHEN etat = 'occasion' THEN CAST(ord AS VARCHAR(20)) END AS kilometrage, CASE WHEN ord % 2 = 0 THEN 'noir' ELSE '' END AS couleur, CASE WHEN ord % 3 = 0 THEN 'manuelle' END AS transmission, '' AS poids FROM {{listing}} WHERE name <> '')",
)
#: Seeds of a marketplace: models of the sites whose configurations name it, brand and at most three words of the model.
SEEDS = "SELECT lower(trim(marque)) || ' ' || {0} AS seed, count(*) AS n FROM (SELECT marque, split(lower(trim(name || ' ' || modele)), ' ') AS w FROM {{listing}} WHERE site IN (SELECT s_suppkey FROM {{supplier}} WHERE s_suppkey % 4 = 0 AND s_acctbal > 0) AND marque <> '') GROUP BY 1 ORDER BY n DESC, seed LIMIT 40"
add("s13_seed_derivation", SEEDS.format("concat_ws(' ', try_element_at(w, 1), try_element_at(w, 2), try_element_at(w, 3))"), SEEDS.format("concat_ws(' ', w[1], w[2], w[3])").replace("split(", "string_split("))
#: Golden values: numbers within 5 %, texts without regard to case and outer space; every third text is another.
add("v8_golden_equivalence", "SELECT o_orderkey, abs(got - o_totalprice) <= 0.05 * abs(o_totalprice) AS same_number, lower(trim(o_orderpriority)) = lower(trim(shown)) AS same_text FROM (SELECT o_orderkey, o_totalprice, o_orderpriority, o_totalprice * (1 + (o_orderkey % 21 - 10) / 90.0) AS got, CASE o_orderkey % 3 WHEN 0 THEN ' ' || upper(o_orderpriority) || ' ' WHEN 1 THEN o_orderpriority ELSE 'other' END AS shown FROM {orders})")
#: Texts with accents that were read as Latin-1, made by hand, so that the expected text doesn't come from the same functions.
MENDED = {"CafÃ© glacÃ©": "Café glacé", "MontrÃ©al": "Montréal", "dÃ©jÃ\xa0": "déjà", "plain text": "plain text", "Café": "Café", "naÃ¯ve": "naïve", "lâ\x80\x99eau": "l’eau"}


def f12(spark: SparkSession, d: str) -> DataFrame:
    """Each document's digest behind one of the texts."""
    shown = F.element_at(F.array(*map(F.lit, MENDED)), (F.col("doc_id") % len(MENDED) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", fixed_mojibake(F.concat_ws(" ", shown, F.md5("text"))).alias("repaired"))


QUERIES["f12_fix_mojibake"] = f12
ORACLE["f12_fix_mojibake"] = f"SELECT doc_id, concat_ws(' ', ({list(MENDED.values())})[doc_id % {len(MENDED)} + 1], md5(text)) AS repaired FROM documents"
#: A price text's signs go; a dot before more than two digits is none; 1 to 1,000,000 count. A year is the first of 1900 to 2099.
PRICE_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN '$ ' || CAST(o_custkey AS VARCHAR(9)) || ',000.50' WHEN 1 THEN CAST(o_custkey AS VARCHAR(9)) || '.000 $' WHEN 2 THEN 'Prix: 0.25' ELSE CAST(o_custkey AS VARCHAR(9)) || '99999999' END"
CLEANED = """SELECT o_orderkey, CASE WHEN v BETWEEN 1 AND 1000000 THEN v END AS price, km AS mileage, nullif(y, '') AS year FROM (SELECT o_orderkey, TRY_CAST(CASE WHEN contains(c, '.') AND length(regexp_extract(c, '[.]([0-9]*)$', 1)) > 2 THEN replace(c, '.', '') ELSE c END AS DOUBLE) AS v,
    TRY_CAST(regexp_replace(k, '[^0-9]', ''{0}) AS BIGINT) AS km, regexp_extract(m, '((?:19|20)[0-9][0-9])', 1) AS y FROM (SELECT o_orderkey, regexp_replace(p, '[^0-9.]', ''{0}) AS c, k, m FROM (SELECT o_orderkey, {1} AS p, CAST(o_custkey AS VARCHAR(9)) || ' 5' || CAST(o_orderkey % 100 AS VARCHAR(3)) || ' km' AS k, 'no ' || CAST(o_custkey AS VARCHAR(9)) || ', of ' || CAST(year(o_orderdate) AS VARCHAR(4)) AS m FROM {{orders}})))"""
add("f24_clean_mileage_year", CLEANED.format("", PRICE_TEXT), CLEANED.format(", 'g'", PRICE_TEXT))
#: Prices in dollars for a million tokens read and written, by the beginning of the model's name; cached reading costs a tenth, caching 1.25 times.
RATES = {"large-v2": (12.0, 60.0), "large": (15.0, 75.0), "medium": (3.0, 15.0), "small": (0.8, 4.0)}
MODEL = "CASE conv_id % 5 WHEN 0 THEN 'large-v2-0614' WHEN 1 THEN 'large-v1' WHEN 2 THEN 'medium-3' WHEN 3 THEN 'small' ELSE 'unknown' END"


def rate(k: int) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(model, '{p}') THEN CAST({x[k]} AS DOUBLE)" for p, x in RATES.items()) + " ELSE CAST(0 AS DOUBLE) END"


COST = f"SELECT conv_id, model, round(CAST((got * {rate(0)} + wrote * {rate(1)} + cached * {rate(0)} * 0.1e0 + caching * {rate(0)} * 1.25e0) / 1000000 AS DOUBLE), 6) AS usd FROM (SELECT conv_id, {MODEL} AS model, sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS got, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS wrote, sum(turn * 100) AS cached, sum(CASE WHEN turn = 0 THEN length(text) ELSE 0 END) AS caching FROM {{conversations}} GROUP BY conv_id)"
add("f32_token_cost", COST.replace("starts_with(", "startswith("), COST)
#: How sure a valuation is, by number, spread and sources of offers, and where a price stands against it.
LEVELS = "CASE WHEN n < 4 OR s < 2 OR disp > 0.25 THEN 'low' WHEN n >= 8 AND s >= 4 AND disp < 0.1 THEN 'good' ELSE 'indicative' END AS reliability, CASE WHEN target < low THEN 'below' WHEN target > high * 1.15 THEN 'off' WHEN target > high THEN 'above' ELSE 'aligned' END AS position, round(target / mid - 1, 6) AS vs_median, round(greatest(0e0, least(100e0, (target - low) / greatest(1e0, high - low) * 100)), 6) AS marker"
add(
    "v5_reliability",
    f"SELECT product, {LEVELS} FROM (SELECT product, n, s, low, mid, high, target, (high - low) / mid AS disp FROM (SELECT product, count(*) AS n, count(DISTINCT site) AS s, percentile_cont(0.25) WITHIN GROUP (ORDER BY prix) AS low, percentile_cont(0.5) WITHIN GROUP (ORDER BY prix) AS mid, percentile_cont(0.75) WITHIN GROUP (ORDER BY prix) AS high FROM {{listing}} WHERE prix > 0 GROUP BY product) JOIN (SELECT p_partkey, p_retailprice * (1 + (p_partkey % 9 - 4) / 20e0) AS target FROM {{part}}) ON p_partkey = product)",
)
