"""Queries of candidates and similar names, misspelt words, the taxonomy, shop platforms and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import deep_normalize
from ..operators import phrases, search, setjoin
from .listing import SQL, listing, table
from .scalars import deep, listed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- candidates and similar names ----------------------------------------------------------------------------------------------------------
#: Candidates that a product gets, by id.
MOST = 100


@query("j12_blocking_candidates", f"SELECT a, b FROM (SELECT x.p_partkey AS a, y.p_partkey AS b, row_number() OVER (PARTITION BY x.p_partkey ORDER BY y.p_partkey) AS rn FROM part x JOIN part y ON lower(x.p_brand) = lower(y.p_brand) AND x.p_type = y.p_type AND y.p_size BETWEEN x.p_size - 1 AND x.p_size + 1 WHERE x.p_partkey <> y.p_partkey) WHERE rn <= {MOST}")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """The first candidates of each product, those of its block with a size at most one off.

    Products of one block and size have one list, of the first MOST + 1 ids there, and each takes it without itself, so pairs are made where they are handed
    out and not moved. An id that several rows have counts as often in lists, and is itself the only one whose pairs are put in order again.
    """
    p = table(spark, d, "part").where("p_partkey is not null").select("p_partkey", F.lower("p_brand").alias("brand"), "p_type", "p_size")
    block = ["brand", "p_type", "p_size"]
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("b"))
    first = p.groupBy(*block, F.col("p_partkey").alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("at", at(*block)).where(F.col("at") <= MOST + 1)
    beside = first.select("brand", "p_type", F.explode(F.array(F.col("p_size") - 1, F.col("p_size"), F.col("p_size") + 1)).alias("p_size"), "b", "n").groupBy(*block, "b").agg(F.sum("n").alias("n"))
    lists = beside.withColumn("at", at(*block)).where(F.col("at") <= MOST + 1).groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("b", F.least("n", F.lit(MOST)).cast("int").alias("n")))).alias("near"))
    own = p.groupBy(F.col("p_partkey").alias("a")).agg(F.collect_list(F.struct(*block)).alias("blocks")).select("a", F.size("blocks").alias("rows"), F.explode("blocks").alias("x")).select("a", "rows", "x.*")
    others = F.flatten(F.transform(F.filter("near", lambda x: x["b"] != F.col("a")), lambda x: F.array_repeat(x["b"], x["n"])))
    met = own.join(lists, block).select("a", "rows", F.explode(F.slice(others, 1, MOST)).alias("b"))
    several = met.where("rows > 1").withColumn("at", at("a")).where(F.col("at") <= MOST)
    return met.where("rows = 1").select("a", "b").unionByName(several.select("a", "b"))


#: Jaccard similarity from which names are similar.
ALIKE = 0.6
SHOWN = "lower(concat_ws(' ', p_name, p_type, p_size))"


@query(
    "u3_similar_names",
    f"WITH x AS (SELECT p_partkey, p_brand, list_distinct(string_split({SHOWN}, ' ')) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM x a JOIN x b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) >= {ALIKE} * len(list_distinct(list_concat(a.w, b.w)))",
)
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Similar products of a brand, by prefixes of their words in order of rarity."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.split(F.expr(SHOWN), " ").alias("tokens"))
    return setjoin.similar(rows, ALIKE, 6)


# --- misspelt words ------------------------------------------------------------------------------------------------------------------------
#: Names as typed: letters left out, doubled, put in the wrong order or taken for others, in every fifth name none.
TYPED = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(substr(p_name, 1, 2), substr(p_name, 4)) WHEN 2 THEN concat(substr(p_name, 1, 3), substr(p_name, 3)) WHEN 3 THEN concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3)) ELSE concat('zq', substr(p_name, 3)) END"
KNOWN = "SELECT w AS term, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY w"


@query(
    "q1_typos_in_listings",
    f"""{SQL}, known AS ({KNOWN}), typed AS (SELECT p_partkey, unnest(string_split(lower({TYPED}), ' ')) AS word FROM part), meant AS (
    SELECT word, term FROM (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), n DESC, term) AS rn FROM (SELECT DISTINCT word FROM typed WHERE word <> '') CROSS JOIN known
    WHERE levenshtein(word, term) <= CASE WHEN length(word) < 4 THEN 0 WHEN length(word) < 7 THEN 1 ELSE 2 END) WHERE rn = 1)
    SELECT unit_key, words AS meant FROM listing JOIN (SELECT p_partkey, string_agg(DISTINCT term, ' ' ORDER BY term) AS words FROM typed JOIN meant USING (word) GROUP BY p_partkey) ON p_partkey = product""",
)
def q1(spark: SparkSession, d: str) -> DataFrame:
    """What every listing's typed name means, word by word."""
    p = table(spark, d, "part")
    split = lambda x: F.explode(F.split(F.lower(x), " "))
    known = p.select(split(F.col("p_name")).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    typed = p.select("p_partkey", split(F.expr(TYPED)).alias("word"))
    meant = typed.join(setjoin.corrections(typed, known), "word").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("meant"))
    return listing(spark, d).join(meant, F.col("product") == F.col("p_partkey")).select("unit_key", "meant")


# --- taxonomy and platforms ------------------------------------------------------------------------------------------------------------------
#: Names with something of the taxonomy in them.
IN_TREE = "concat(p_name, CASE p_size % 9 WHEN 0 THEN ' Motocyclette usagée' WHEN 1 THEN ' Snowmobile jacket' WHEN 2 THEN ' Ski-Doo' WHEN 3 THEN ' quad' WHEN 4 THEN ' casque moto KTM' WHEN 5 THEN ' Remorque' WHEN 6 THEN ' gear' WHEN 7 THEN ' chaîne moto' ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN ' yamaha' ELSE '' END)"
WORDS = [(len(w), -at, form, phrases.paths(phrases.NODES)[slug]) for at, (slug, w) in enumerate((s, w) for s, name, parent, aliases in phrases.NODES if parent for w in (*aliases, name.lower(), s)) for form in sorted({w, w.replace("-", " ")})]


@query("q6_category_from_text", f"SELECT p_partkey, max_by(path, (n, place)) AS path FROM (SELECT p_partkey, lower({IN_TREE}) AS t FROM part) JOIN (VALUES " + ", ".join(f"({n}, {at}, {quoted(form)}, {quoted(path)})" for n, at, form, path in WORDS) + ") v(n, place, form, path) ON contains(t, form) GROUP BY p_partkey")
def q6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", phrases.category_of(F.expr(IN_TREE)).alias("path")).where("path is not null")


def holds_sql(x: str, terms: list[str]) -> str:
    # without look-behind a word is one between spaces; the text is normalised
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" if " " in t else f"contains(' ' || {x} || ' ', {quoted(f' {t} ')})" for t in terms) + ")"


ASKED = "vehicule.moto"
OWN, OTHER = phrases.terms_of(phrases.NODES, "moto"), [t for s, _, p, _ in phrases.NODES if p == "vehicule" and s != "moto" for t in phrases.terms_of(phrases.NODES, s)]


@query("p17_category_fit", f"SELECT p_partkey, {holds_sql('t', OWN)} OR p_size = 12 OR NOT {holds_sql('t', OTHER)} AS fits FROM (SELECT p_partkey, p_size, {deep(IN_TREE)} AS t FROM part)")
def p17(spark: SparkSession, d: str) -> DataFrame:
    """Which products may be motorcycles: by the category's own terms, or as exactly what is asked for, or as of no sibling category."""
    return table(spark, d, "part").select("p_partkey", phrases.fits(deep_normalize(F.expr(IN_TREE)), ASKED, F.col("p_size") == 12).alias("fits"))


@query("p16_taxonomy_closure", "WITH RECURSIVE n(slug, parent) AS (VALUES " + ", ".join(f"({quoted(s)}, {quoted(p) if p else 'NULL'})" for s, _, p, _ in phrases.NODES) + f"), up AS (SELECT slug AS ancestor, slug, 0 AS depth FROM n UNION ALL SELECT n.parent, up.slug, up.depth + 1 FROM up JOIN n ON n.slug = up.ancestor WHERE n.parent IS NOT NULL), x AS (SELECT p_partkey, ['moto', 'vtt', 'accessoire-moto', 'piece-moto'][p_size % 4 + 1] AS slug FROM part) SELECT ancestor, max(depth) AS depth, count(*) AS n FROM x JOIN up USING (slug) GROUP BY ancestor")
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Products under every node of the tree, by its closure."""
    x = table(spark, d, "part").select(F.array(*map(F.lit, ("moto", "vtt", "accessoire-moto", "piece-moto")))[F.col("p_size") % 4].alias("slug"))
    return x.join(phrases.closure(spark), "slug").groupBy("ancestor").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"))


#: Pages with marks of platforms in some of them.
MARKED = "concat(html, CASE page_id % 7 WHEN 0 THEN '<meta name=\"generator\" content=\"PrestaShop\"><div class=\"product-miniature\">' WHEN 1 THEN '<script src=\"//cdn.shopify.com/a.js\">' WHEN 2 THEN 'x-mage-init Magento checkout/cart' WHEN 3 THEN '__NEXT_DATA__ powergo' WHEN 4 THEN 'made with prestashop' WHEN 5 THEN '<iframe src=\"dealersocket\">' ELSE '' END)"
MARKS = [(k, kind, m.lower()) for k, (_, marks, generators, _, addresses) in enumerate(phrases.PLATFORMS) for kind, own in (("page", marks), ("generator", generators), ("address", addresses)) for m in own]
CHECKS = {k: len(p[1]) + len(p[2]) + len(p[3]) + len(p[4]) for k, p in enumerate(phrases.PLATFORMS)}


@query(
    "h7_platform_fingerprint",
    f"""WITH p AS (SELECT page_id, lower({MARKED}) AS h, lower(url) AS u FROM pages), m(k, kind, mark) AS (VALUES {', '.join(f"({k}, '{kind}', {quoted(m)})" for k, kind, m in MARKS)}), names(k, name, checks) AS (VALUES {', '.join(f"({k}, {quoted(p[0])}, {CHECKS[k]})" for k, p in enumerate(phrases.PLATFORMS))}),
    s AS (SELECT page_id, k, sum(CASE kind WHEN 'page' THEN CASE WHEN contains(h, mark) THEN 1.0 ELSE 0 END WHEN 'address' THEN CASE WHEN contains(h, mark) OR contains(u, mark) THEN 1.0 ELSE 0 END
      ELSE CASE WHEN contains(h, 'generator" content="' || mark) OR contains(h, 'generator'' content=''' || mark) THEN 1.0 WHEN contains(h, mark) THEN 0.5 ELSE 0 END END) AS score FROM p CROSS JOIN m GROUP BY page_id, k),
    best AS (SELECT page_id, arg_max(name, (score / checks, -k)) AS name, max(score / checks) AS ratio FROM s JOIN names USING (k) GROUP BY page_id)
    SELECT page_id, CASE WHEN (contains(h, '__next_data__') OR contains(h, '_next/static')) AND (contains(h, 'powergo') OR contains(h, 'pg-vehicle')) THEN {quoted(phrases.POWERGO)} WHEN ratio >= {phrases.LEAST} THEN name ELSE {quoted(phrases.GENERIC)} END AS platform FROM p JOIN best USING (page_id)""",
)
def h7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", phrases.platform_of(F.expr(MARKED), F.col("url"))["name"].alias("platform"))


# --- coverage and completion -----------------------------------------------------------------------------------------------------------------
@query("a15_greedy_coverage")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return search.greedy_coverage(listing(spark, d).select("site", "product"), "site", "product", 8)


@query("t14_prefix_completion", "SELECT prefix, completion FROM (SELECT lower(substr(c, 1, k)) AS prefix, c AS completion, row_number() OVER (PARTITION BY lower(substr(c, 1, k)) ORDER BY length(c), first_seen, c) AS rn FROM (SELECT p_name AS c, min(p_partkey) AS first_seen, unnest(range(1, least(20, length(p_name) - 1) + 1)) AS k FROM part GROUP BY p_name)) WHERE rn = 1")
def t14(spark: SparkSession, d: str) -> DataFrame:
    return search.completions(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("first_seen")))
