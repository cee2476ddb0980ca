"""Set joins, misspelt words, taxonomy, platforms, coverage and completions against brute force and literal cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import phrases, search, setjoin


def sets(seed):
    dice = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, f"b{dice.choice([0, 0, 0, 1])}", dice.choices(words, [40] + [3] * 11, k=dice.randint(0, 6))) for k in range(160)]
    return [*rows, (500, "b0", []), (501, None, ["w1"]), (502, "b0", ["w0"]), (503, "b0", ["w0"])]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 1.0])
def test_similar_sets_are_all_pairs(spark, least):
    rows = sets(2)
    got = sorted((r.a, r.b, round(r.jaccard, 9)) for r in setjoin.similar(spark.createDataFrame(rows, "id long, block string, tokens array<string>"), least).collect())
    expected = sorted((a, b, round(len({*x} & {*y}) / len({*x} | {*y}), 9)) for (a, p, x), (b, q, y) in itertools.combinations(rows, 2) if p and p == q and x and y and len({*x} & {*y}) >= least * len({*x} | {*y}))
    assert got == expected


def test_few_pairs_are_rated_in_a_skewed_block(spark):
    """A word that all names have brings no pair."""
    dice = random.Random(1)
    rows = [("b", str(k), sorted({"common", *(f"r{dice.randrange(600)}" for _ in range(5))})) for k in range(400)]
    met = setjoin.candidates(spark.createDataFrame(rows, "block string, s string, tokens array<string>"), 0.6).count()
    assert met < 0.05 * len(rows) * (len(rows) - 1) / 2


def edits(a, b):
    line = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, line[j] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def test_corrections_find_all_within_two_edits(spark):
    """Recall against brute force is 1: words within two edits have remains in common."""
    dice = random.Random(4)
    terms = sorted({"".join(dice.choices("abcdef", k=dice.randint(3, 9))) for _ in range(60)})
    known = [(t, dice.randrange(5)) for t in terms]
    typed = []
    for t in terms * 3:
        w = list(t)
        for _ in range(dice.randint(0, 3)):
            k = dice.randrange(len(w))
            w[k : k + 1] = dice.choice([[], ["x"], [w[k], "a"]])
            w = w or ["z"]
        typed.append(("".join(w),))
    got = {r.word: (r.term, r.distance) for r in setjoin.corrections(spark.createDataFrame([*typed, ("",)], "word string"), spark.createDataFrame(known, "term string, n long")).collect()}
    expected = {}
    for (w,) in typed:
        most = 0 if len(w) < 4 else 1 if len(w) < 7 else 2
        if near := [(d, -n, t) for t, n in known if (d := edits(w, t)) <= most]:
            expected[w] = (min(near)[2], min(near)[0])
    assert got == expected


def test_deletes(spark):
    got = spark.range(1).select(setjoin.deletes(F.lit("abcd")).alias("x")).head().x
    assert set(got) == {"abcd", *("".join(c) for n in (2, 3) for c in itertools.combinations("abcd", n))}


def test_found_phrases_overlap(spark):
    known = ["ring", "string", "sting", "str", "in", "a.b", "(x"]
    texts = ["a string of a.b", "STRING", "axb (x", None, ""]
    got = [set(r.x) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(phrases.found_in(F.col("t"), known).alias("x")).collect()]
    assert got == [{p for p in known if p in (t or "")} for t in texts]


@pytest.mark.parametrize(
    ("text", "path"),
    [
        ("Motocyclette usagée", "vehicule.moto"),
        ("snowmobile jacket rouge", "accessoire.accessoire-motoneige"),
        ("SNOWMOBILE", "vehicule.motoneige"),
        ("ski doo renegade", "vehicule.motoneige"),
        ("harley davidson", "vehicule.moto"),
        ("vehicules", None),
        ("", None),
        (None, None),
    ],
)
def test_category_of_a_text(spark, text, path):
    """The longest alias wins, of equal ones the first in the tree; roots are no answer."""
    assert spark.createDataFrame([(text,)], "t string").select(phrases.category_of(F.col("t"))).head()[0] == path


@pytest.mark.parametrize(
    ("text", "path", "identity", "expected"),
    [
        ("ktm duke 390", "vehicule.moto", False, True),
        ("polaris sportsman 570", "vehicule.moto", False, False),
        ("polaris sportsman 570", "vehicule.moto", True, True),
        ("quad avec moteur ktm", "vehicule.moto", False, True),
        ("quadrant bleu", "vehicule.moto", False, True),
        ("quad rouge", "vehicule", False, True),
        ("quad rouge", "vehicule.inconnu", False, True),
        ("quad rouge", "vehicule.moto", None, False),
    ],
)
def test_category_fit(spark, text, path, identity, expected):
    """Own terms and an identity outweigh a sibling's terms, which veto; a word is no part of another."""
    row = spark.createDataFrame([(text, identity)], "t string, i boolean")
    assert row.select(phrases.fits(F.col("t"), path, F.col("i"))).head()[0] is expected


def test_closure_has_every_ancestor(spark):
    got = {(r.ancestor, r.slug, r.depth, r.path) for r in phrases.closure(spark).collect()}
    assert ("vehicule", "moto", 1, "vehicule.moto") in got and ("moto", "moto", 0, "vehicule.moto") in got
    assert len(got) == sum(len(p.split(".")) for p in phrases.paths(phrases.NODES).values())


@pytest.mark.parametrize(
    ("html", "url", "cookies", "name"),
    [
        ('<meta name="generator" content="PrestaShop"><article class="product-miniature">', "https://x.com", "", "PrestaShop"),
        ("shop by prestashop", "https://x.com/", "prestashop-1=2", "PrestaShop"),
        ("<p>prestashop</p>", "https://x.com/", "", "Générique"),
        ("Shopify.theme = {}", "https://x.com/products/a", None, "Shopify"),
        ("__NEXT_DATA__ x PowerGO", "", "", "PowerGO / Next.js"),
        ("wix.com wixstatic.com data-mesh-id", "https://x.com", "XSRF-TOKEN=1", "Wix Stores"),
        (None, None, None, "Générique"),
    ],
)
def test_platforms(spark, html, url, cookies, name):
    row = spark.createDataFrame([(html, url, cookies)], "h string, u string, c string")
    assert row.select(phrases.platform_of(F.col("h"), F.col("u"), F.col("c"))["name"]).head()[0] == name


def plain_greedy(pairs, k):
    own, out, covered = {}, [], set()
    for w, x in pairs:
        own.setdefault(w, set()).add(x)
    for step in range(1, k + 1):
        gain, who = min((-len(v - covered), w) for w, v in own.items())
        if not gain:
            break
        out.append((step, who, -gain))
        covered |= own.pop(who)
        if not own:
            break
    return out


def test_lazy_coverage_is_the_plain_greedy(spark, monkeypatch):
    """With many ties, with items of several bitmaps, and with few bounds looked at."""
    monkeypatch.setattr(search, "BATCH", 3)
    monkeypatch.setattr(search, "PAGE", 4)
    dice = random.Random(6)
    pairs = [(w, dice.choice([0, 0, 40_000, 900_000]) + dice.randrange(25)) for w in range(18) for _ in range(dice.randint(1, 30))]
    got = search.greedy_coverage(spark.createDataFrame(pairs, "site long, product long"), "site", "product", 6).collect()
    assert [tuple(r) for r in got] == plain_greedy(pairs, 6)


def test_completions_of_every_prefix(spark):
    names = [("Blue Ring", 4), ("blue", 7), ("Blue Ring Set", 1), ("bolt", 2), ("Bolt", 1), ("", 9), ("x", 3), ("a" * 30, 5)]
    got = {r.prefix: r.completion for r in search.completions(spark.createDataFrame(names, "name string, first_seen long")).collect()}
    expected = {}
    for k in range(1, 21):
        for p in {n[:k].lower() for n, _ in names if len(n) > k}:
            expected[p] = min((len(n), s, n) for n, s in names if n[:k].lower() == p and len(n) > k)[2]
    assert got == expected


def test_ids_of_common_sets_are_joined_in_lists(spark):
    """Copies of three sets: every pair of ids comes once, and what is dealt out are pairs of lists, a fraction of the pairs of ids."""
    words = ["a b c d e", "a b c d", "x y"]
    rows = [(k, "m", words[k % 3].split()) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, block string, tokens array<string>")
    lists = setjoin.listed(df, ["block", "tokens"]).collect()
    assert sorted(i for r in lists for i in r.ids) == [*range(900)] and len(lists) <= 9
    got = sorted(tuple(r) for r in setjoin.similar(df, 0.8, 6).collect())
    assert got == sorted((a, b, 1.0 if a % 3 == b % 3 else 0.8) for a in range(900) for b in range(a + 1, 900) if a % 3 == b % 3 or {a % 3, b % 3} == {0, 1})


def test_common_names_have_every_pair(spark, tmp_path):
    import duckdb

    import __spark_entry__

    name = "u3_jaccard_of_names"
    rows = [(k, ["", "red bolt", "red nut", "red"][k % 4], f"Brand#{k % 2}", ["A", None][k % 7 == 0]) for k in range(700)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    key = lambda r: (r[0], r[1], -1.0 if r[2] is None else r[2])
    assert sorted(key(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == sorted(key(r) for r in duck.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_pairs_of_a_block_move_once_a_tile(spark, tmp_path, monkeypatch):
    """Every two ids of a block, ids that repeat and blocks of many tiles too; no pair of lists is moved."""
    import __spark_entry__
    import duckdb

    monkeypatch.setattr(setjoin, "LIST", 4)
    monkeypatch.setattr(setjoin, "TILE", 16)
    name = "u3_jaccard_of_names"
    rows = [(k % 190, ["", "nut", "red bolt", "red nut red", "red"][k % 5], f"Brand#{k % 2}", ["A", None][k % 11 == 0]) for k in range(300)] + [(None, "red", "Brand#1", "A"), (1, "red", None, "A")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    key = lambda r: (r[0], r[1], -1.0 if r[2] is None else r[2])
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert sorted(key(r) for r in got.collect()) == sorted(key(r) for r in duck.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    moved = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in line]
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert moved and "Repartition" not in above


def test_coverage_takes_room_as_its_pairs_do(spark, monkeypatch):
    """Sources with few items far apart: no row that is held is larger than its items."""
    held, real = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df: held.append(real(df)) or held[-1])
    pairs = [(w, (w * 7 + k) * 1_000_003 - 9) for w in range(40) for k in range(5)]
    got = search.greedy_coverage(spark.createDataFrame(pairs, "site long, product long"), "site", "product", 3).collect()
    assert [tuple(r) for r in got] == plain_greedy(pairs, 3)
    assert max(r[0] for df in held for r in df.select(F.length(F.to_json(F.struct("*")))).collect()) < 200


def test_blocking_candidates_of_ids_that_repeat(spark, tmp_path):
    """Ids of many rows, in one block and in several, null ids and empty blocks, as the SQL has them."""
    import duckdb

    import __spark_entry__

    rows = [(1, "A", "t", 5)] * 103 + [(2, "a", "t", 5)] * 3 + [(2, "a", "t", 6), (2, "b", "t", 6)] + [(None, "a", "t", 5)] * 4 + [(k, "a", "t", 4 + k % 4) for k in range(10, 150)] + [(200, None, "t", 5), (201, "b", None, 5), (202, "b", "t", None), (203, "b", "t", 7)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["j12_blocking_candidates"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duck.execute(__spark_entry__.oracle_sql()["j12_blocking_candidates"]).fetchall())
