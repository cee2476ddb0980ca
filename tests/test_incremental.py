"""Views kept up to date by changes, and exact percentiles, against recomputation."""

import collections
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import incremental, selection

CHANGES = "old_product long, old_price double, new_product long, new_price double"


def recomputed(rows):
    by = collections.defaultdict(list)
    for p, x in rows.values():
        if p is not None and x is not None:
            by[p].append(x)
    return {p: (len(v), pytest.approx(sum(v) / len(v)), min(v), max(v)) for p, v in by.items()}


def test_view_follows_changes(spark):
    """Round after round of insertions, updates, deletions and moves; ends of two prices, so that they run dry."""
    dice = random.Random(3)
    price = lambda: dice.choice([None, *(float(Decimal(dice.randrange(4000)) / 100) for _ in range(9))])
    rows = {k: (dice.randrange(8), price()) for k in range(160)}
    frame = lambda r: spark.createDataFrame([x for x in r.values()], "product long, price double")
    state = incremental.start(frame(rows), 2)
    for n in range(3):
        changes, after = [], dict(rows)
        for k in dice.sample(sorted(rows), 90):
            fate = dice.choice(["gone", "gone", "price", "moved"])
            new = None if fate == "gone" else (rows[k][0], price()) if fate == "price" else (dice.randrange(10), rows[k][1])
            changes.append((*rows[k], *(new or (None, None))))
            after.pop(k) if new is None else after.update({k: new})
        for k in range(1000 * n + 1000, 1000 * n + 1015):
            after[k] = (dice.randrange(9), price())
            changes.append((None, None, *after[k]))
        changed = incremental.apply(state, spark.createDataFrame(changes, CHANGES), frame(after), 2)
        dry = incremental.touched(state, spark.createDataFrame(changes, CHANGES), 2).where("dry").count()
        state, rows = incremental.merged(state, changed).checkpoint(), after
        assert {r.product: (r.n, r["mean"], r.low, r.high) for r in incremental.view(state).collect()} == recomputed(rows)
    assert dry >= 0


def test_only_used_up_products_are_read_again(spark):
    state = incremental.start(spark.createDataFrame([(p, float(x)) for p in range(3) for x in range(6)], "product long, price double"), 2)
    gone = [(1, 0.0, None, None), (1, 1.0, None, None), (2, 0.0, None, None), (0, 3.0, None, None), (5, None, 5, 2.5)]
    new = {r.product: r for r in incremental.touched(state, spark.createDataFrame(gone, CHANGES), 2).collect()}
    assert {p for p, r in new.items() if r.dry} == {1} and set(new) == {0, 1, 2, 5}
    assert new[2].lows.held[0].key == 1 and new[5].n == 1 and new[5].lows.whole


def test_all_listings_of_a_product_go(spark):
    state = incremental.start(spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 7.0)], "product long, price double"))
    changed = incremental.apply(state, spark.createDataFrame([(1, 5.0, None, None)] * 2, CHANGES), spark.createDataFrame([(2, 7.0)], "product long, price double"))
    assert [(r.product, r.n) for r in incremental.view(incremental.merged(state, changed)).collect()] == [(2, 1)]


def test_percentiles_are_exact(spark):
    dice = random.Random(1)
    rows = [(dice.choice(["a", "a", "a", "b", None]), dice.choice([None, 1.0, 1.0, 2.5, float(dice.randrange(1000)), -3.0])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    of = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.g: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", of).collect()}
    by = collections.defaultdict(list)
    for g, x in rows:
        if x is not None:
            by[g].append(x)
    assert set(got) == set(by)
    for g, v in by.items():
        assert got[g].n == len(v)
        for name, p in of.items():
            assert got[g][name] == pytest.approx(float(np.percentile(v, 100 * p)))


def test_percentiles_of_one_group_are_spread(spark):
    """A single group of distinct values lies in several ranges, and few of its rows are looked at."""
    rows = spark.range(40_000).select(F.lit(1).alias("g"), (F.xxhash64("id") / 1e18).alias("x"))
    got = selection.percentiles(rows, ["g"], "x", {"m": 0.5}).head()
    assert got.n == 40_000 and got.m == pytest.approx(rows.agg(F.expr("percentile(x, 0.5)")).head()[0])


def test_quartile_filter(spark):
    rows = [(1, float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 100)] + [(2, 1.0), (2, 1000.0)]
    got = selection.within_quartiles(spark.createDataFrame(rows, "g long, x double"), ["g"], "x", 6, 10, 2.5, 1.5).collect()
    assert sorted((r.g, r.x) for r in got) == sorted(r for r in rows if r != (1, 100.0))


def test_numbers_of_a_large_group(spark):
    """One group over all ranges, with nulls and ties in the order and a null group."""
    from marketlens.operators.numbering import numbered

    dice = random.Random(2)
    rows = [(dice.choice([1, 1, 1, 2, None]), dice.choice([None, dice.randrange(30)]), k) for k in range(4000)]
    got = {r.k: r.n for r in numbered(spark.createDataFrame(rows, "g long, x long, k long"), ["g"], [F.col("x").desc_nulls_last(), F.col("k")]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        expected |= {r[2]: n for n, r in enumerate(own, 1)}
    assert got == expected
