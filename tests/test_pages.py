"""Searches, valuations, reposted offers and pages on literal cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import changes, html, search, valuation

LISTING = "unit_key string, ord long, site long, marque string, modele string, name string, annee int, prix double, etat string, category string, sku string"


def scores(spark, q, *rows, **how):
    df = spark.createDataFrame([(str(k), k, 1, *r) for k, r in enumerate(rows)], LISTING)
    return [round(r.s, 6) for r in df.select("ord", search.score(q, **how).alias("s")).orderBy("ord").collect()]


def test_points_add_up_in_order_and_cuts_meet_what_came_before(spark):
    q = search.Query(("duke",), "ktm", 2023, 1000.0, "neuf", color="noir", keywords=("abs", "sport"))
    full = ("ktm", "Duke", "KTM duke noir abs", 2023, 900.0, "neuf", "", "")
    dear = (*full[:4], 1200.0, "occasion", "", "")
    a_little_dear = (*full[:4], 1050.0, None, "", "")
    assert scores(spark, q, full, dear, a_little_dear) == [
        1.0,  # 1.025, capped
        pytest.approx(((0.3 + 0.2 + 0.3) * 0.5 + 0.05) * 0.7 + 0.025, abs=1e-6),
        pytest.approx(0.8 + 0.05 + 0.025, abs=1e-6),
    ]


def test_a_precise_model_must_be_there_in_full(spark):
    q = search.Query(("tc", "85"), "husqvarna")
    rows = [("husqvarna", "TC 85", "", 2020, 1.0, "", "", ""), ("husqvarna", "TC 850", "", 2020, 1.0, "", "", ""), ("husqvarna", "FE", "", 2020, 1.0, "", "", "")]
    assert q.precise
    assert scores(spark, q, *rows) == [0.6, 0.0, 0.0]
    assert scores(spark, q, *rows, approximate=True) == [0.6, 0.375, 0.3]


def test_year_ranges_and_years_in_names(spark):
    q = search.Query((), "ktm", years=(2018, 2020))
    rows = [("ktm", "", "", 2018, 1.0, "", "", ""), ("ktm", "", "duke 2021", None, 1.0, "", "", ""), ("ktm", "", "", None, 1.0, "", "", "")]
    assert scores(spark, q, *rows) == [0.45, 0.0, 0.3]
    assert scores(spark, q, *rows, approximate=True) == [0.45, 0.34, 0.3]


def test_typos_count_only_where_asked(spark):
    q = search.Query(("himalayan",), "enfield")
    row = ("enfeild", "Himalayen", "Royal Enfeild Himalayen", 2020, 1.0, "", "", "")
    assert scores(spark, q, row) == [0.0]
    assert scores(spark, q, row, typos=True) == [0.6]


def test_generic_products(spark):
    q = search.Query(("256gb",), "apple", sku="A-1", keywords=("iphone",), kind="phone", max_price=1000.0, state="neuf", generic=True)
    rows = [("apple", "", "iPhone 256 GB", None, 900.0, "neuf", "phones", "a-1"), ("other", "", "case a-1", None, 1300.0, "occasion", "", "x")]
    assert scores(spark, q, *rows) == [1.0, 0.0]  # 256 GB is precise, so part of it is another product
    assert scores(spark, q, *rows, approximate=True) == [1.0, 0.15]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Yamaha MT-07 2019 à 2021 max 9k", ("yamaha", None, (2019, 2021), None, 9000.0, ("mt-07",))),
        ("kawazaki zx 600 plus de 2000", ("kawasaki", None, None, 2000.0, None, ("zx", "600"))),
        ("duramax 500 de la", (None, None, None, None, None, ("500",))),
    ],
)
def test_parsed_texts(text, expected):
    q = search.parse(text, ["yamaha", "kawasaki", "kawai"])
    assert (q.brand, q.year, q.years, q.min_price, q.max_price, q.words) == expected


# --- valuation --------------------------------------------------------------------------------------------------------------------------
OFFER = "product long, unit_key string, ord long, site long, name string, prix double, annee int, etat string, kilometrage int, options array<string>, score double"
TARGET = "product long, target_year int, target_state string, target_km int, target_options array<string>"


def worth(spark, offers, target, **how):
    df = spark.createDataFrame([(1, str(k), k, k, f"n{k}", *o) for k, o in enumerate(offers)], OFFER)
    out = valuation.evaluate(df, spark.createDataFrame([(1, *target)], TARGET), 2025, **how).collect()
    return out[0] if out else None


def test_valuation_adjusts_year_state_and_options(spark):
    same = [(1000.0, 2020, "occasion", None, None, 1.0)] * 3
    plain = worth(spark, same, (2020, "occasion", None, None))
    assert (plain.low, plain.median, plain.high, plain.n_used) == (pytest.approx(900), 1000.0, pytest.approx(1100), 3)
    assert plain.reliability == "low"  # three offers are few
    new = worth(spark, [(1000.0, 2020, "neuf", None, None, 1.0)] * 3, (2020, "occasion", None, None))
    assert new.median == pytest.approx(820)
    older = worth(spark, same, (2019, "occasion", None, None))
    assert older.median == pytest.approx(1000 * 0.92)
    better = worth(spark, same, (2020, "occasion", None, ["abs", "heat"]), premiums={"abs": 100.0, "heat": 900.0})
    assert better.median == pytest.approx(1200)  # 30 % at most, and never over 1.2 times the offer


def test_valuation_weighs_mileage(spark):
    # five years at 5000 km: 25,000 expected; the target has 0.4 of it (1.15), the offers just as much as expected (1.0)
    out = worth(spark, [(1000.0, 2020, "occasion", 25_000, None, 1.0)] * 3, (2020, "occasion", 10_000, None))
    assert out.median == pytest.approx(1150)
    none = worth(spark, [(1000.0, 2020, "occasion", 300_000, None, 1.0)] * 3, (2020, "occasion", 10_000, None))
    assert none is None  # implausible distances


def test_valuation_keeps_offers_with_the_options_asked_for(spark):
    with_abs, without = (2000.0, 2020, "occasion", None, ["abs"], 1.0), (1000.0, 2020, "occasion", None, None, 1.0)
    assert worth(spark, [with_abs] * 3 + [without] * 3, (2020, "occasion", None, ["abs"])).n_used == 3
    assert worth(spark, [with_abs] * 2 + [without] * 3, (2020, "occasion", None, ["abs"])).n_used == 5
    few = worth(spark, [without] * 2, (2020, None, None, None))
    assert (few.reliability, few.median, few.n_used) == ("insufficient", None, 2)


def test_price_position(spark):
    df = spark.createDataFrame([(80.0,), (100.0,), (115.0,), (130.0,), (None,)], "p double")
    got = df.select(valuation.price_position(F.col("p"), F.lit(90.0), F.lit(100.0), F.lit(110.0)).alias("x")).collect()
    assert [r.x and r.x.label for r in got] == ["Sous le marché", "Aligné au marché", "Au-dessus du marché", "Hors marché", None]
    assert [got[0].x.marker, got[1].x.marker, got[3].x.marker] == [0, 50, 100]


# --- offers that are posted again ------------------------------------------------------------------------------------------------------------
def units(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "site long, unit_key string, name string, prix double, multi boolean, disponibilite string")


def changed(df):
    return sorted((r.unit_key, r.change_type, r.old_value, r.new_value) for r in df.collect())


def test_an_offer_under_another_key_is_found_by_name(spark):
    before, now = units(spark, ("a1", "Ninja  500", 100.0, False, "F")), units(spark, ("a2", "ninja 500", 90.0, False, "F"))
    assert changed(changes.detect(before, before, now)) == [("a2", "price_decrease", 100.0, 90.0)]
    assert changed(changes.detect(None, before, now)) == [("a2", "price_decrease", 100.0, 90.0)]
    both = units(spark, ("a1", "Ninja 500", 100.0, False, "F"), ("a2", "Ninja 500", 90.0, False, "F"))
    assert changed(changes.detect(before, before, both)) == [("a2", "new_product", None, 90.0)]  # the old key is still there
    nameless = units(spark, ("b1", None, 100.0, False, "F")), units(spark, ("b2", "", 90.0, False, "F"))
    assert [c[1] for c in changed(changes.detect(None, *nameless))] == ["removed_product", "new_product"]


def test_units_of_a_model_are_never_taken_for_one_another(spark):
    one = units(spark, ("a1", "Duke", 100.0, False, "F"))
    split = units(spark, ("a1", "Duke", 120.0, True, "O"), ("a2", "Duke", 130.0, True, "O"))
    assert changed(changes.detect(one, one, split)) == [("a1", "stock_change", None, None)]  # neither new nor compared in price
    gone = units(spark, ("a2", "Duke", 130.0, True, "O"))
    assert changed(changes.detect(split, gone, gone)) == [("a1", "removed_product", 120.0, None)]
    moved = units(spark, ("a1", "Duke", 120.0, True, "F"), ("a2", "Duke", 130.0, True, "F"))
    assert changed(changes.detect(split, split, moved)) == [("a1", "stock_change", None, None)]  # once a model


# --- pages ---------------------------------------------------------------------------------------------------------------------------------------
def page_of(n, item='<div class="card"><a href="/p/{k}">Blue anvil number {k} of 1998</a> <b>{k} 234.50 $</b></div>'):
    return "<html><body><ul><li><a href='/a'>A</a><li><a href='/b'>B</a><li><a href='/c'>C</a><li><a href='/d'>D</a></ul><div>" + "".join(item.format(k=k) for k in range(n)) + "</div></body></html>"


def test_repeated_siblings():
    score, selector, items = html.repeated(page_of(10))[0]
    assert (selector, len(items)) == ("div.card", 10)
    assert score == pytest.approx(0.15 + 0.15 + (0.1 + 0.1 + 0.05) * 0.5, abs=0.01)  # texts of 38 characters count half
    assert html.repeated(page_of(3))[0][0] == 0  # only the menu is left, and it is no listing
    assert html.repeated(page_of(10, '<div class="card"><a href="https://other.example/{k}">A text of more than twenty characters</a></div>'))[0][0] == 0
    assert html.repeated(page_of(10, '<div class="card"><a href="/brand?x={k}">A text of more than twenty characters</a></div>'))[0][0] == 0
    rows = "<table>" + "".join(f"<tr><td><a href='/p/{k}'>A text of twenty characters or more<td>{k} $" for k in range(5)) + "</table>"
    assert [(x[1], len(x[2])) for x in html.repeated(rows)] == [("table > tr", 5)]  # ends that are left out
    assert html.repeated(None) == [] and html.listed_products("") == []


def test_listed_products_take_an_item_list_first():
    block = '<script type="application/ld+json">{"@graph": [{"@type": "ItemList", "itemListElement": [{"item": {"name": "A 2020", "url": "/a", "offers": {"price": "9"}}}, {"name": "B"}, {"x": 1}]}]}</script>'
    assert [(x["name"], x["price"], x["year"], x["layer"]) for x in html.listed_products(block + page_of(10))] == [("A 2020", 9.0, 2020, "itemlist"), ("B", None, None, "itemlist")]
    assert len(html.listed_products(page_of(120))) == 100  # the operator's own limit


@pytest.mark.parametrize(
    ("text", "expected"),
    [("was $10.50 now $9.25", 9.25), ("1 234,56 €", 1234.56), ("1,234 USD", 1234.0), ("5 000 $", 5000.0), ("0 $", None), ("x", None), (None, None)],
)
def test_last_price(text, expected):
    assert html.last_price(text) == expected


def test_leaders():
    a, b = set("abcdefghij"), set("klm")
    assert html.leaders([a, a - {"a"}, b, a]) == [([0, 1, 3], a)]
    assert html.leaders([b]) == [([0], b)] and html.leaders([]) == []


def test_template_clusters_of_a_site(spark):
    def page(k):
        return ("<main class='product'><h1>x</h1><table></table></main>" if k % 3 else "<article data-page-type='b' class='vehicle'><dl></dl><dl></dl></article>") + "x" * 1000

    rows = [("s", f"/p/{k:03d}", page(k)) for k in range(60)] + [("t", f"/q/{k}", page(1)) for k in range(3)] + [(None, "/n", page(1)), ("s", None, page(1))]
    out = html.template_clusters(spark.createDataFrame(rows, "site string, url string, page string"), "site", "url", "page").orderBy("template").collect()
    assert [(r.site, r.template) for r in out] == [("s", "tpl_a")] or [(r.site, r.template) for r in out] == [("s", "tpl_a"), ("s", "tpl_b")]
    assert sum(r.n_pages for r in out) == html.SAMPLE
    assert html.template_clusters(spark.createDataFrame([], "site string, url string, page string"), "site", "url", "page").count() == 0


def test_listing_nodes():
    assert html.listing_nodes('[{"name": "a", "price": {"value": 2}}, {"x": [[{"title": "b", "price": "1,000 $", "url": 3}]]}, {"name": "c"}]') == [
        {"name": "a", "price": 2.0, "url": None},
        {"name": "b", "price": 1000.0, "url": None},
    ]
    deep = '{"k": ' * 900 + '{"name": "d", "price": 1}' + "}" * 900
    assert [x["name"] for x in html.listing_nodes(deep)] == ["d"]
    assert html.listing_nodes("{") == [] and html.listing_nodes(None) == [] and html.listing_nodes("") == []


def test_mileage_and_totals(spark):
    rows = [("<span>Kilométrage:</span><b>12 345</b> km", 12345, None), ("Showing 1-20 of 152", None, 152), ("5 results, total: 99", None, 99), ("Mileage 9,999,999", None, None), (None, None, None)]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, page string")
    got = df.select("k", html.mileage(F.col("page")).alias("km"), html.announced_total(F.col("page")).alias("n")).orderBy("k").collect()
    assert [(r.km, r.n) for r in got] == [r[1:] for r in rows]


def test_mileage_of_any_page_number(spark, tmp_path):
    """The pages of a part table whose keys go on reach a distance of a million."""
    import __spark_entry__

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 50_000).write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["h8_mileage_and_total"](spark, str(tmp_path)).collect()
    assert {r.page: r.mileage for r in got} == {2000 + k: (2000 + k) * 777 + 1 for k in range(8)}


def test_pages_are_cleaned_in_pieces(monkeypatch):
    """A batch's pages and results aren't all Python objects at once; nulls, empty pages and batches, and pages longer than a piece come out in place."""
    import tracemalloc

    import pyarrow as pa

    pages = pa.array([f"<p>{k}{'x' * 10_000}</p><script>y</script>" for k in range(2000)])
    tracemalloc.start()
    got = html.in_pieces(pages, html.cleaned)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * html.PIECE
    assert got.to_pylist() == [html.cleaned(x) for x in pages.to_pylist()]
    monkeypatch.setattr(html, "PIECE", 5)
    odd = [None, "", "<b>long page</b>", "a", None, "b"]
    assert html.in_pieces(pa.array(odd, pa.string()), html.cleaned).to_pylist() == [html.cleaned(x) for x in odd]
    assert html.in_pieces(pa.array([], pa.string()), html.cleaned).to_pylist() == []
