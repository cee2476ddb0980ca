"""Grouping, gates, taken-back changes and the resolution cascade on literal cases and against plain versions."""

import collections
import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as t
from marketlens.operators import grouping, match, resolve, snapshots

UNITS = "site long, ord long, unit_key string, url string, stock string, vin string, marque string, modele string, name string, annee int, etat string, prix double"


def unit(k, url, prix, vin=None, stock=None, modele="Himalayan 450"):
    return (1, k, f"k{k}", url, stock, vin, "Royal Enfield", modele, "Royal Enfield Himalayan 450 2025", 2025, "neuf", prix)


@pytest.mark.parametrize(
    ("rows", "flags", "expected"),
    [
        ([unit(1, "a", 8495.0), unit(2, "b", 6995.0), unit(3, "c", 7995.0)], {}, [(3, 6995.0, True, ["a", "b", "c"], ["k1", "k2", "k3"])]),
        ([unit(1, "a/", 8495.0), unit(2, "a", 1.0)], {}, [(1, 8495.0, False, ["a/"], None)]),
        ([unit(1, "a", 8495.0), unit(2, "a", 1.0)], {"by_url": False}, [(2, 1.0, True, ["a", "a"], ["k1", "k2"])]),
        ([unit(1, "a", None), unit(2, "b", 7000.0), unit(3, None, 0.0)], {}, [(3, 7000.0, True, ["a", "b"], ["k1", "k2", "k3"])]),
        ([unit(1, "a", 5.0, vin="SN1TLC9B5SC629648"), unit(2, "b", 6.0, vin="SN1TLC9B5SC629649"), unit(3, "c", 7.0, vin="x")], {"vin_split": True}, [(1, 5.0, False, ["a"], None), (1, 6.0, False, ["b"], None), (1, 7.0, False, ["c"], None)]),
        ([unit(1, "a", 5.0, stock="s"), unit(2, "b", 6.0, stock="s"), unit(3, "c", 7.0)], {"by_stock": True}, [(2, 5.0, True, ["a", "c"], ["k1", "k3"])]),
    ],
)
def test_units_of_a_model_are_one_product(spark, rows, flags, expected):
    got = grouping.group_products(spark.createDataFrame(rows, UNITS), **flags).collect()
    assert sorted(((r.quantity, r.prix, r.multi_unit, r.urls, r.units) for r in got), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ([200, 80], ["success", "partial"]),
        ([200, 80, 80], ["success", "partial", "success"]),
        ([200, 150], ["success", "success"]),
        ([8, 2], ["success", "success"]),
        ([40], ["success"]),
        ([200, 0, 80, 120], ["success", "error", "partial", "success"]),
        ([200, 80, 90, 50], ["success", "partial", "success", "partial"]),
    ],
)
def test_a_partial_snapshot_is_refused_once(spark, counts, expected):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(counts)], "site long, t long, n long")
    assert [r.status for r in snapshots.partial_gate(rows).orderBy("t").collect()] == expected


def test_changes_are_taken_back_in_pairs(spark):
    dice, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(k, dice.randint(1, 2), "s", dice.choice(["A", " a", "b"]), start + dt.timedelta(hours=dice.randint(0, 900)), dice.randint(1, 3), dice.randint(1, 3)) for k in range(250)]
    groups, expected = collections.defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        groups[r[1], r[3].strip().lower()].append(r)
    for g in groups.values():
        pair = {}
        for i, a in enumerate(g):
            for b in g[i + 1 :] if a[0] not in pair else []:
                if b[0] not in pair and (a[5], a[6]) == (b[6], b[5]) and b[4] - a[4] <= dt.timedelta(days=7):
                    pair[a[0]], pair[b[0]] = b[0], a[0]
                    break
        kinds = {(r[5], r[6]) for r in g if r[0] in pair}
        expected |= {r[0]: (pair.get(r[0]), "inverse pair" if r[0] in pair else "repetition") for r in g if r[0] in pair or (r[5], r[6]) in kinds}
    df = spark.createDataFrame(rows, "id long, user long, site string, name string, ts timestamp_ntz, old long, new long")
    assert {r.id: (r.pair, r.reason) for r in snapshots.taken_back(df).collect()} == expected


def test_runs_wait_for_snapshots_and_locks(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, 1, at(0), "start"), (1, 2, at(1), "snapshot"), (1, 3, at(2), "start"), (1, 4, at(3), "snapshot"), (1, 5, at(40), "start"), (1, 6, at(47), "start"), (1, 7, at(48), "end"), (1, 8, at(49), "start"), (1, 9, at(50), "snapshot"), (1, 10, at(51), "start")]
    got = snapshots.gated_runs(spark.createDataFrame(rows, "key long, id long, ts timestamp_ntz, kind string")).orderBy("id").collect()
    assert [(r.id, r.outcome) for r in got] == [(1, "nothing new"), (3, "run"), (5, "locked"), (6, "run"), (8, "nothing new"), (10, "run")]


def cascade(a, c):
    """One listing and one catalogue entry by the plain rules: (confidence, method), or None."""
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    model, title, found = ratio(a["model"], c["model"]), ratio(a["title"], c["title"]), []
    if a["brand"] == c["brand"] and model >= 0.8:
        same = a["year"] == c["year"]
        found.append((0.92 if same and model > 0.95 else min(0.95, 0.7 + model * (1 if same else 0.7) * 0.25), "brand_model_year"))
    x, y = set(a["title"].split(" ")), set(c["title"].split(" "))
    found.append((round(title * 0.6 + len(x & y) / len(x | y) * 0.4, 3), "title_similarity"))
    shared = a["specs"].keys() & c["specs"].keys()
    specs = sum(a["specs"][k] == c["specs"][k] for k in shared) / len(shared) if shared else 0
    found.append((round((a["brand"] == c["brand"]) * 0.25 + model * 0.25 + max(0, 1 - abs(a["year"] - c["year"]) * 0.5) * 0.15 + title * 0.15 + specs * 0.1 + (a["category"] == c["category"]) * 0.1, 3), "composite"))
    found = [f for f in found if f[0] >= 0.5]
    return next((f for f in found if f[0] >= 0.85), max(found, key=lambda f: f[0], default=None))


@pytest.fixture(scope="module")
def resolved(spark):
    from marketlens.plans import engine

    sf = "/root/testdata/sf0.001"
    plain = lambda df, x: [{k.removeprefix(f"{x}_"): v for k, v in r.asDict().items()} for r in df.collect()]
    listings, catalog = engine.sides(spark, sf)
    listings, catalog = plain(listings, "l"), plain(catalog, "c")
    pairs = {(a["id"], c["id"]): m for a in listings for c in catalog if (a["brand"], a["category"]) == (c["brand"], c["category"]) and abs(a["year"] - c["year"]) <= 1 and (m := cascade(a, c))}
    return sf, listings, pairs


def near(a, b):
    return a[1] == b[1] and a[0] == pytest.approx(b[0], abs=0.00051)


def test_review_candidates_are_all_pairs_of_a_block(spark, resolved):
    import __spark_entry__

    sf, _, pairs = resolved
    got = {(r.l_id, r.c_id): (r.confidence, r.method) for r in __spark_entry__.queries()["m6_review_candidates"](spark, sf).collect()}
    assert got.keys() == pairs.keys() and all(near(got[k], pairs[k]) for k in got)


def test_ingestion_routes_every_listing(spark, resolved):
    import __spark_entry__

    sf, listings, pairs = resolved
    got = {r.l_id: r for r in __spark_entry__.queries()["m7_ingest_routing"](spark, sf).collect()}
    assert set(got) == {a["id"] for a in listings}
    for k, r in got.items():
        top = max((m[0] for (x, _), m in pairs.items() if x == k), default=None)
        expected = "updated" if k % 7 == 0 else "new" if top is None else "matched" if top >= 0.85 else "review"
        assert r.outcome == expected or top is not None and abs(top - 0.85) < 0.001
        if r.outcome == "new":
            assert (r.c_id, r.method, r.confidence) == (None, "new_canonical", 1.0)
    assert {r.outcome for r in got.values()} >= {"updated", "new", "matched"}


def test_copies_are_compared_once(spark, resolved):
    """Six copies of the parts: no more pairs are scored, each listing has its match, and each pair of a block its rank."""
    from marketlens.plans import engine

    sf, _, pairs = resolved
    again = lambda rows, x: rows.crossJoin(spark.range(6).withColumnRenamed("id", "k")).withColumn(f"{x}_id", F.col(f"{x}_id") + F.col("k") * 1000).drop("k")
    listings, catalog = engine.sides(spark, sf)
    many, most = again(listings, "l"), again(catalog, "c")
    classes = [resolve.represented(rows, x)[0] for rows, x in ((many, "l"), (most, "c"))]
    assert resolve.blocked(*classes).count() <= resolve.blocked(listings, catalog).count()
    one = {r.l_id: r for r in resolve.best(listings, catalog).collect()}
    got = resolve.best(many, most).collect()
    assert len(got) == 6 * len(one) and all((r.c_id, r.method, r.confidence) == one[r.l_id % 1000][1:] for r in got)
    ranks = {}
    for r in resolve.candidates(many, most).collect():
        ranks.setdefault(r.l_id, []).append((r["rank"], -r.confidence, r.c_id))
    assert {(x, c % 1000) for x, of in ranks.items() for _, _, c in of} == {(a + 1000 * k, c) for a, c in pairs for k in range(6)}
    for of in ranks.values():
        assert [x[0] for x in sorted(of, key=lambda x: x[1:])] == [*range(1, len(of) + 1)]


@pytest.mark.parametrize(("a", "b", "expected"), [({"x": "1", "y": "B "}, {"y": "b", "z": "3"}, 1.0), ({"x": "1", "y": "2"}, {"x": "1", "y": "3"}, 0.5), ({"x": "1"}, {"y": "1"}, 0.0), (None, {"y": "1"}, 0.0)])
def test_spec_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>")
    assert df.select(resolve.spec_similarity(F.col("a"), F.col("b")).alias("s")).head().s == expected


@pytest.mark.parametrize(
    ("model", "expected"),
    [
        ("z 900 usage a laval", "z 900"),
        ("moto sportive z 900 noir", "z 900"),
        ("moto", "moto"),
        ("cote a cote maverick r a vendre chez nous", "maverick r"),
        ("scout 50 th anniversary", "scout 50 anniversaire"),
        ("z 900 rive powersports", "z 900"),
        ("z 900 moto laval", "z 900"),
        ("pre commande mt 07 neuf demo", "mt 07"),
        ("ninja concessionnaire adm", "ninja"),
    ],
)
def test_what_is_no_part_of_a_model_goes(spark, model, expected):
    assert spark.createDataFrame([(model,)], "m string").select(t.cleaned_model(F.col("m")).alias("x")).head().x == expected


def test_nearest_price_is_the_least_distance(spark):
    dice = random.Random(11)
    price = lambda: dice.choice([None, 0.0, *(float(dice.randint(1, 30)) for _ in range(6))])
    rows = [(f"u{k}", k, dice.choice([0, 0, 1, 2]), "Brand", dice.choice("abc"), "n", 2020, price(), "neuf", "c") for k in range(300)]
    df = spark.createDataFrame(rows, "unit_key string, ord long, site long, marque string, modele string, name string, annee int, prix double, etat string, category string")
    got = {r.unit_key: r.ref_unit_key for r in match.match(df, 0).collect()}
    expected = {}
    for r in rows:
        refs = [x for x in rows if x[2] == 0 and x[4] == r[4]]
        if r[2] and refs:
            both = lambda x, r=r: bool(r[7] and x[7])
            expected[r[0]] = min(refs, key=lambda x: (not both(x), abs(r[7] - x[7]) if both(x) else 0, x[1]))[0]
    assert got == expected


def test_a_stream_of_updates_survives_retries(spark, tmp_path):
    from marketlens.operators import merge

    path, of = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(list(rows), "k long, status string, v long")
    write = merge.upsert_stream(path, ["k"])
    now = lambda: {r.k: r.v for r in merge.current(spark, path).collect()}
    assert merge.current(spark, path) is None
    write(of((1, "success", 10), (2, "success", 20)), 0)
    write(of((2, "success", 21)), 1)
    write(of((2, "success", 99)), 1)  # a retry of a batch that was finished
    assert now() == {1: 10, 2: 21}
    of((7, "success", 7)).write.parquet(f"{path}/v2")  # broken off before its pointer
    assert now() == {1: 10, 2: 21}
    write(of((3, "success", 30)), 2)
    write(of((1, "success", 11)), 3)
    assert now() == {1: 11, 2: 21, 3: 30} and merge.versions(spark, path) == [2, 3]


def test_two_contents_are_rated_once_in_whatever_blocks_they_meet(spark, monkeypatch):
    """Five brands with the same names: each two texts are compared once, and the pairs, years missing or not, and matches are those of plain loops."""
    made, ratio = spark.sparkContext.accumulator(0), lambda x, y: SequenceMatcher(None, x or "", y or "").ratio()

    def counted(x, y):
        made.add(1)
        return ratio(x, y)

    monkeypatch.setattr(resolve, "seq_ratio", lambda a, b: F.udf(counted, "double")(a, b))
    names, years = ["red bolt", "red bolts", "gear", None], [None, 2000, 2001, 2003]
    rows = lambda end, at: [(at + 100 * k + 10 * i + j, f"b{k}", f"{n} {end}" if n else None, y, n, "c", {"y": str(y)}) for k in range(5) for i, n in enumerate(names) for j, y in enumerate(years)]
    frame = lambda x, of: spark.createDataFrame(of, ", ".join(f"{x}_{c}" for c in ("id long", "brand string", "model string", "year int", "title string", "category string", "specs map<string,string>")))
    left, right = rows("x", 0), rows("y", 1000)
    listings, catalog = frame("l", left), frame("c", right)
    pairs = {(a[0], c[0]) for a in left for c in right if a[1] == c[1] and (a[3] is None or c[3] is None or abs(a[3] - c[3]) <= 1)}
    met = [(r.l_id, r.c_id) for r in resolve.blocked(listings, catalog).collect()]
    assert len(met) == len(pairs) and set(met) == pairs
    got = {r.l_id: (r.c_id, r.confidence) for r in resolve.best(listings, catalog, "m4", None).collect()}
    assert made.value == 2 * len(names) ** 2

    def m4(a, c):
        x, y = ({*(r[4] or "").split(" ")} for r in (a, c))
        return round(ratio(a[4], c[4]) * 0.6 + len(x & y) / len(x | y) * 0.4, 3) if a[4] and c[4] else 0

    of = {r[0]: r for r in left + right}
    every = {}
    for a, c in pairs:
        if (rate := m4(of[a], of[c])) >= 0.5:
            every.setdefault(a, []).append((-rate, c))
    assert got.keys() == every.keys() and all(got[a] == (min(every[a])[1], pytest.approx(-min(every[a])[0], abs=0.00051)) for a in got)
