"""Hit scores, addresses, configured sites, ranks and strategies: literal cases."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import hits

HIT = "name string, marque string, modele string, annee int, kilometrage double, etat string, prix double, score double, is_approximate boolean"


def scored(spark, rows, asked):
    return {r.name: r for r in hits.scored_hits(spark.createDataFrame(rows, HIT), asked).collect()}


def test_weights_are_renormalised(spark):
    """Without kilometres asked for, text, year and variant share the whole; with them for a used vehicle, they count too; the price never does."""
    row = [("KTM Duke 390", "KTM", "Duke 390", 2020, 10_000.0, "occasion", 5000.0, 0.8, None)]
    new = scored(spark, row, hits.Asked("ktm duke 390", 2021))["KTM Duke 390"]
    assert new.eval_score == 75  # (80 * .35 + 85 * .2 + 50 * .15) / .7
    used = scored(spark, row, hits.Asked("ktm duke 390", 2021, 20_000, True))["KTM Duke 390"]
    assert used.eval_score == round((80 * 0.35 + 85 * 0.2 + 80 * 0.15 + 50 * 0.15) / 0.85)


@pytest.mark.parametrize(
    ("asked", "name", "kept"),
    [("ktm duke 390", "KTM Duke 3900", False), ("ktm duke 390", "KTM Du-ke 390", True), ("alpha beta gamma delta epsilon", "Alpha BÉTA gamma", True), ("alpha beta gamma delta epsilon", "alpha beta", False), ("", "anything", True), ("mt 07 abs", "MT07 ABS", True), ("mt 07 abs", "MT107 ABS", False)],
)
def test_words_of_a_query(spark, asked, name, kept):
    """A short query with a number needs every word, a longer one most; numbers stand alone."""
    assert (name in scored(spark, [(name, None, "", None, None, None, None, None, False)], hits.Asked(asked))) is kept


def test_approximate_hits_stay_and_deals_are_far_below_the_median(spark):
    rows = [(f"n{k}", None, None, 2020, None, "occasion", p, 1.0, True) for k, p in enumerate((100.0, 100.0, 90.0, None, -5.0))]
    got = scored(spark, rows, hits.Asked("nothing alike", 2020))
    assert {n for n, r in got.items() if r.is_deal} == {"n2"} and got["n2"].price_vs_median == pytest.approx(-0.1) and got["n3"].price_vs_median == 0
    assert scored(spark, rows[:1], hits.Asked("x", 2020))["n0"].is_deal is False


@pytest.mark.parametrize(("km", "state", "asked", "points"), [(None, "Neuf", 300, 100), (5.0, "new", 9000, 60), (None, "", 300, 90), (None, None, 9000, 60), (10_000.0, "occasion", 9000, 98), (1e6, "usagé", 9000, 0)])
def test_kilometres(spark, km, state, asked, points):
    row = spark.createDataFrame([(km, state)], "k double, e string")
    assert row.select(hits.mileage_score(hits.Asked(mileage=asked), F.col("k"), F.col("e"))).head()[0] == points


@pytest.mark.parametrize(("hints", "name", "points"), [((), "x", 50), (("Grande roue", "abs"), "moto 19/16", 50), (("petite roue",), "17 / 14 x", 100), (("S-E",), "vélo", 0), (("s e",), "model se", 100)])
def test_variants(spark, hints, name, points):
    row = spark.createDataFrame([(name,)], "n string")
    assert row.select(hits.variant_score(hits.Asked(variants=hints), hits.plain_column(F.col("n")))).head()[0] == points


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://x.com/blog", True), ("https://x.com/a/BLOG/", True), ("https://x.com/blogs-a", False), ("https://x.com/fr/promotions", True), ("https://x.com/promotions/a", False),
        ("https://x.com/promotion/local-1", True), ("https://x.com", True), ("https://x.com/en/", True), ("https://x.com/en/moto", False), ("https://x.com/vendez-votre-moto", True), ("https://x.com/p/ktm-390", False),
    ],
)
def test_addresses(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(hits.no_product(F.col("u"))).head()[0] is expected


def test_configured_sites_once_a_host(spark):
    rows = [(1, "https://www.A.com/x", ["http://a.com/y", "https://b.com", "https://www.b.com/z", "not an address", None]), (2, "https://c.com", None)]
    got = sorted(tuple(r) for r in hits.configured_sites(spark.createDataFrame(rows, "user long, reference_url string, competitor_urls array<string>")).collect())
    assert got == [(1, "a.com", "https://www.A.com/x", True), (1, "b.com", "https://b.com", False), (2, "c.com", "https://c.com", True)]


@pytest.mark.parametrize(("rows", "rank"), [([(0, 1.0), (1, -3.0), (2, 1.0), (3, 4.0)], 2), ([(0, -9.0)], 1), ([(1, 5.0), (2, 6.0)], 1), ([], 1)])
def test_rank_of_the_reference(spark, rows, rank):
    assert tuple(hits.rank_of_reference(spark.createDataFrame(rows, "site long, aggressivity double"), 0).head()) == (rank, max(1, len(rows)))


@pytest.mark.parametrize(("key", "amount", "expected"), [("market_average", 5.0, ("market_average", None)), ("lowest_minus_amount", -2.0, ("lowest_minus_amount", 0.0)), ("odd", None, ("lowest_minus_amount", 1.0)), (None, float("nan"), ("lowest_minus_amount", 1.0)), ("match_lowest", None, ("match_lowest", None))])
def test_strategies_in_order(spark, key, amount, expected):
    row = spark.createDataFrame([(key, amount)], "k string, a double")
    assert tuple(row.select(hits.strategy(F.col("k"), F.col("a")).alias("s")).head().s) == expected


def test_texts_are_read_once_a_content(spark, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), hits.plain

    def count(x):
        made.add(1)
        return real(x or "")

    monkeypatch.setattr(hits, "plain_column", lambda x: F.udf(count, "string")(x))
    rows = spark.range(600).coalesce(1).selectExpr("concat('Honda CRF ', 250 + id % 2) AS name", "'Honda' AS marque", "'CRF' AS modele", "2024 AS annee", "1 AS kilometrage", "'used' AS etat", "1.0D * id AS prix", "0.5D AS score", "false AS is_approximate")
    assert hits.scored_hits(rows, hits.Asked("honda crf 250", variants=("crf 250",))).count() == 300
    assert made.value <= 4
