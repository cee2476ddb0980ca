"""Operators on small literal tables, with the values that the rules give by hand."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as t
from marketlens.functions import values as v
from marketlens.operators import changes, html, match, merge, resolve, search, table_query
from marketlens.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("KLX110R L", "klx 110 rl"), ("Ninja500", "ninja 500"), ("Côte-à-Côte", "cote a cote"), ("  s x f  450 ", "sxf 450"), ("", ""), (None, "")],
)
def test_deep_normalize(spark, text, expected):
    assert one(spark, t.deep_normalize(F.lit(text).cast("string"))) == expected


def test_unit_key_cascade(spark):
    def key(vin=None, stock=None, url=None, name=None, color=None):
        return one(spark, v.unit_key(*(F.lit(x).cast("string") for x in (vin, stock, url, name, color))))

    assert key(vin="sn1tlc9b5sc629648", stock="1") == "SN1TLC9B5SC629648"
    assert key(vin="short", stock=" ins52090 ") == "ins52090"
    assert key(url="https://x.com/fr/i/royal-enfield-a-vendre-84565/") == "84565"
    assert key(url="https://x.com/page/") == "https://x.com/page"
    assert key(name="Yamaha MT-07 2026", color="Bleu") == "389ba0e9c24a"


@pytest.mark.parametrize(("text", "expected"), [("1 234,56 $", 1234.56), ("$12,345.60", 12345.6), ("8.995,00", 8995.0), ("12,345", 12345.0), ("call", None)])
def test_parsed_price(spark, text, expected):
    assert one(spark, v.parsed_price(F.lit(text))) == expected


def test_half_up_goes_towards_positive_infinity(spark):
    assert one(spark, v.half_up(F.lit(-2.5))) == -2
    assert one(spark, v.half_up(F.lit(2.5))) == 3


def test_mojibake(spark):
    assert one(spark, t.fixed_mojibake(F.lit("cafÃ©"))) == "café"
    assert one(spark, t.fixed_mojibake(F.lit("café"))) == "café"


LISTING = "unit_key string, ord long, site long, marque string, modele string, name string, annee int, prix double, etat string, category string"


def test_match_takes_the_nearest_price_and_keeps_the_rest_apart(spark):
    rows = spark.createDataFrame(
        [("r1", 1, 0, "Yamaha", "MT-07 ABS", "", 2024, 9000.0, "neuf", "moto"), ("r2", 2, 0, "yamaha", "mt07 abs", "", 2024, 7000.0, "neuf", "moto"), ("c1", 3, 1, "YAMAHA", "MT 07 ABS", "", 2024, 7200.0, "neuf", "moto"), ("c2", 4, 1, "Yamaha", "MT-07", "", 2023, None, "neuf", "moto"), ("c3", 5, 1, "Honda", "", "", 2023, 1.0, "neuf", "moto")],
        LISTING,
    )
    assert [(r.unit_key, r.ref_unit_key, r.difference) for r in match.match(rows, 0).collect()] == [("c1", "r2", 200.0)]
    flexible = {r.unit_key: (r.ref_unit_key, r.difference) for r in match.match(rows, 0, "flexible").collect()}
    assert flexible == {"c1": ("r2", 200.0), "c2": ("r1", None)}
    kinds = {r.unit_key: r.kind for r in match.union_of_sites(rows, 0).collect()}
    assert kinds == {"r1": "reference", "r2": "reference", "c1": "matched", "c2": "unmatched"}
    with pytest.raises(ValueError):
        match.keyed(rows, "other")


SNAP = "site long, unit_key string, prix double, disponibilite string"


def snap(spark, *units):
    return spark.createDataFrame([(1, k, p, "F") for k, p in units], SNAP)


def found(df):
    return sorted((r.unit_key, r.change_type) for r in df.collect())


def test_changes(spark):
    a, b = snap(spark, ("u", 8495.0), ("w", 100.0)), snap(spark, ("u", 8495.0))
    assert found(changes.detect(a, a, b)) == []  # one snapshot without w proves nothing
    assert found(changes.detect(a, b, b)) == [("w", "removed_product")]
    assert found(changes.detect(a, b, a)) == []  # w comes back
    assert found(changes.detect(b, b, a)) == [("w", "new_product")]
    assert found(changes.detect(b, b, snap(spark, ("u", 7995.0)))) == [("u", "price_decrease")]
    assert found(changes.detect(None, a, b)) == [("w", "removed_product")]
    assert found(changes.detect(b, b, snap(spark, ("u", 8500.0)), min_pct=1.0)) == []


def test_price_history_gives_a_new_baseline_after_an_absence(spark):
    rows = spark.createDataFrame([(1, 1, "u", 5.0), (1, 2, "x", 5.0), (1, 3, "u", 5.0), (1, 4, "u", 6.0)], "site long, t int, unit_key string, prix double")
    got = [(r.t, r.change_type) for r in changes.price_history(rows).where("unit_key = 'u'").orderBy("t").collect()]
    assert got == [(1, "baseline"), (3, "baseline"), (4, "price_change")]


def test_upsert_keeps_values_of_failed_rows(spark):
    s = "k int, status string, v int"
    old, new = spark.createDataFrame([(1, "success", 1), (2, "success", 2)], s), spark.createDataFrame([(2, "error", 0), (3, "error", 9)], s)
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "success", 1), (2, "error", 2), (3, "error", 9)]


def test_table_query_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "B"), (3, None)], "n int, s string")
    ask = lambda **f: [r.n for r in table_query.query(df, filters=f, order="n.desc").collect()]
    assert ask(s="is.null") == [3]
    assert ask(s="not.is.null", n="gte.2") == [2]
    assert ask(s="ilike.b*") == [2]
    assert ask(n="in.(1, 3)") == [3, 1]
    for bad in ({"n": "what.1"}, {"m": "eq.1"}):
        with pytest.raises(ValueError):
            table_query.query(df, filters=bad)


def test_html():
    page = '<html><!-- c --><head><style>x</style><script>var a</script><script type="application/ld+json">{"a":1}</script></head><body data-x="1" class="p"><p style="q">A &amp; B</p></body></html>'
    out = html.cleaned(page)
    assert '{"a":1}' in out and "A &amp; B" in out and 'class="p"' in out
    assert not any(x in out for x in ("<style", "var a", "data-x", "style=", "<!--"))
    assert html.keys("<div class='b a'><p>x</p></div>") == [">div.a.b", "div.a.b>p"]
    assert html.cleaned(None) == ""


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(resolve.seq_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, 0.0]


def test_greedy_coverage(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 1), (3, 2)], "site long, product long")
    assert [tuple(r) for r in search.greedy_coverage(pairs, "site", "product", 3).collect()] == [(1, 1, 3), (2, 2, 1)]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"items": [{"id": "1", "p": "9.5"}, {"id": "2", "p": "x"}]}}')
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://x/p/1 </loc></url><url><loc>https://x/blog</loc></url></urlset>")
    (tmp_path / "c.csv").write_text("id,p\n7,1\n")
    items = readers.mapped(readers.json_feed(spark, str(tmp_path / "a.json"), "data.items"), {"id": "id", "price": "p"}, {"price": "double"}, ["p"])
    assert [(r.id, r.price, r.specs) for r in items.orderBy("id").collect()] == [("1", 9.5, {"p": "9.5"}), ("2", None, {"p": "x"})]
    assert [r.loc for r in readers.sitemap(spark, str(tmp_path / "s.xml"), "/p/").collect()] == ["https://x/p/1"]
    assert [tuple(r) for r in readers.csv_feed(spark, str(tmp_path / "c.csv")).collect()] == [("7", "1")]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "A", "offers": {"price": "1,200.50"},}]}</script><h1>B</h1>', ("A", 1200.5, "json-ld")),
        ('<div itemprop="name">C <b>d</b></div><meta itemprop="price" content="99">', ("C d", 99.0, "microdata")),
        ('<meta property="og:title" content="E"><meta property="og:price:amount" content="5">', ("E", 5.0, "opengraph")),
        ("<title>F</title>", ("F", None, "heading")),
        (None, (None, None, "none")),
    ],
)
def test_product_extraction_takes_the_first_layer(page, expected):
    x = html.product(page)
    assert (x["name"], x["price"], x["layer"]) == expected


def test_listed_items():
    assert html.listed_items("<ul><li>Ninja 500 2024 - 7 995.00 $</li><li>x</li><li>plain</li></ul>") == [
        {"position": 0, "text": "Ninja 500 2024 - 7 995.00 $", "year": 2024, "price": 7995.0},
        {"position": 1, "text": "plain", "year": None, "price": None},
    ]


def test_fuzzy_contains():
    assert resolve.contained("royal enfeild", "new Royal Enfield Himalayan")
    assert resolve.contained("mt 07", "Yamaha MT07")
    assert not resolve.contained("ducati", "Honda CB")
    assert not resolve.contained("", "x")


def test_query_parsing():
    q = search.parse("KTM 390 Duke 2023 usagé moins de 8k", ["ktm", "honda"])
    assert (q.brand, q.year, q.max_price, q.state, q.words) == ("ktm", 2023, 8000.0, "occasion", ("390", "duke"))
    assert search.parse("", []) == search.Query()


def test_search_vetoes_and_relaxation(spark):
    rows = spark.createDataFrame([("a", 1, 0, "ktm", "", "duke", 2023, 10.0, "neuf", ""), ("b", 2, 0, "honda", "", "duke", 2023, 10.0, "neuf", ""), ("c", 3, 1, "ktm", "", "duke", 2019, 10.0, "neuf", "")], LISTING)
    q = search.Query(("duke",), "ktm", 2023)
    strict = {r.unit_key: r.s for r in rows.select("unit_key", search.score(q).alias("s")).collect()}
    assert strict["a"] == pytest.approx(0.8) and strict["b"] == strict["c"] == 0
    kept = {r.unit_key: (round(r.score, 3), r.is_approximate) for r in search.strict_or_relaxed(rows, q).collect()}
    assert kept == {"a": (0.8, False), "c": (0.64, True)}


@pytest.mark.parametrize(
    ("name", "expected"),
    [("Kawasaki Ninja 500 2024", ("kawasaki", "ninja 500")), ("VTT CF Moto CForce 600 noir", ("cfmoto", "vtt cforce 600")), ("Unknown X1 usage a Laval", ("", "unknown x 1"))],
)
def test_product_key_from_a_name(spark, name, expected):
    brand, model = t.product_key(F.lit(""), F.lit(""), F.lit(name))
    got = spark.range(1).select(brand.alias("b"), model.alias("m")).head()
    assert got.b == expected[0]
    assert got.m in (expected[1], expected[1].removeprefix("vtt "))


@pytest.mark.parametrize("tile", [256, 3])
def test_similarity_join_is_brute_force(spark, monkeypatch, tile):
    """Names that begin differently, equal names, and a ratio that depends on the order; empty ones match nothing."""
    monkeypatch.setattr(resolve, "TILE", tile)
    names = ["large ring", "blue ring", "large ring", "tide", "diet", "ring large", "small red anvil", "red small anvil", "", "", None, "x" * 250 + "y", "x" * 250 + "z"]
    rows = [(k, f"b{k % 2}" if k > 40 else "b", n) for k, n in enumerate(names * 4)] + [(100, "", "large ring"), (101, None, "large ring"), (102, "", "large ring")]
    got = {(r.a, r.b, r.r) for r in resolve.similar_pairs(spark.createDataFrame(rows, "key long, brand string, n string"), 0.6).collect()}
    expected = {(a, b, SequenceMatcher(None, x, y).ratio()) for a, p, x in rows for b, q, y in rows if a < b and p and p == q and x and y}
    assert got == {x for x in expected if x[2] >= 0.6}
    assert {r for _, _, r in got} >= {1.0} and (0, 1) in {(a, b) for a, b, _ in got}


def test_ratios_are_rounded_before_pairs_are_handed_out(spark):
    rows = spark.createDataFrame([(k, "b", ("tide", "diet", "tides")[k % 3]) for k in range(30)], "key long, brand string, n string")
    got = resolve.similar_pairs(rows, 0.1, 3)
    plain = {(r.a, r.b, round(r.r, 3)) for r in resolve.similar_pairs(rows, 0.1).collect()}
    assert {tuple(r) for r in got.collect()} == plain
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]


def test_similarity_query_has_no_prefix_rule(spark):
    import __spark_entry__
    import pyarrow.parquet as pq

    parts = [(r["p_partkey"], r["p_brand"], r["p_name"]) for r in pq.read_table("/root/testdata/sf0.001/part.parquet").to_pylist()]
    expected = {(a, b, round(SequenceMatcher(None, x, y).ratio(), 6)) for a, p, x in parts for b, q, y in parts if a < b and p == q}
    rows = __spark_entry__.queries()["j13_similarity_join"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.a, r.b, r.ratio) for r in rows) == sorted(x for x in expected if x[2] >= 0.6)


def test_keys_are_made_once_a_content(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    def counting(marque, modele, name, colors=True):
        return marque, F.udf(count, "string")(modele)

    monkeypatch.setattr(match, "product_key", counting)
    rows = spark.range(3000).coalesce(1).selectExpr("cast(id as string) AS unit_key", "id AS ord", "id % 3 AS site", "'Yamaha' AS marque", "concat('MT-0', id % 2) AS modele", "concat('n', id) AS name", "2024 AS annee", "1.0 * id AS prix", "'neuf' AS etat", "'moto' AS category")
    assert match.match(rows, 0).count() == 2000
    assert made.value == 2


def test_keys_of_contents_are_those_of_rows(spark):
    odd = [None, "", " ", "Yamaha", "Marque: ", "marque : Honda", "--", "é", "BRP", "Model: MT-07", "MT 07 rouge ABS"]
    rows = spark.createDataFrame([(a, b, c) for a in odd for b in odd for c in (None, "", "2024 Honda CRF 450", "Yamaha MT-07 2023")], "marque string, modele string, name string").withColumn("annee", F.lit(2024))
    for colors in (True, False):
        brand, model = t.product_key(F.col("marque"), F.col("modele"), F.col("name"), colors)
        plain = rows.select("*", brand.alias("k_marque"), t.strip_trims(model).alias("k_modele"), F.lit(0).alias("k_annee"))
        got = match.keyed(rows, "flexible", colors)
        assert got.columns == plain.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_similar_classes_stand_for_every_pair(spark):
    """Each pair of keys follows from the classes and their copies, and common names are no product of their numbers."""
    names = ["large ring", "blue ring", "large ring", "tide", "diet", "ring large", "", None]
    rows = [(k, f"b{k % 2}", n) for k, n in enumerate(names * 12)]
    df = spark.createDataFrame(rows, "key long, brand string, n string")
    got = resolve.similar_classes(df, 0.5).collect()
    assert len(got) <= len(rows) + 2 * 2 * 6 * 5
    of = {k: k for k, _, n in rows if n} | {r.b: r.a for r in got if r.kind == "copy"}
    link = {(r.a, r.b): r.r for r in got if r.kind == "similar"} | {(k, k): 1.0 for k in of.values()}
    spread = {(a, b, link[of[a], of[b]]) for a in of for b in of if a < b and (of[a], of[b]) in link}
    assert spread == {tuple(r) for r in resolve.similar_pairs(df, 0.5).collect()}
