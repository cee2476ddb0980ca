"""Running state against the batch rules: any split into micro-batches, restarts from the checkpoint, silent keys."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import snapshots
from marketlens.streaming import jobs, state

T0 = pd.Timestamp("2024-03-01")


def minutes(k):
    return (T0 + pd.Timedelta(minutes=k)).to_pydatetime()


def attempts(seed):
    dice = random.Random(seed)
    return [(dice.randrange(6), k, minutes(dice.randrange(3000)), dice.choice(["snapshot", "start", "start", "end"])) for k in range(300)]


def changes(seed):
    dice = random.Random(seed)
    return [(k, dice.randrange(3), "", dice.choice(["A ", "b"]), minutes(dice.randrange(60 * 24 * 40)), *dice.sample([1, 2, 3], 2)) for k in range(250)]


ATTEMPT, CHANGE, WRITE = "key long, id long, ts timestamp, kind string", "id long, user long, site string, name string, ts timestamp, old long, new long", "key long, id long, ts timestamp"
#: A row long after all others, of a key of its own, so that the watermark passes them.
LAST = {ATTEMPT: (-1, -1, minutes(10**7), "end"), CHANGE: (-1, -1, "", "", minutes(10**7), 1, 2), WRITE: (-1, -1, minutes(10**7))}


def streamed(spark, tmp_path, rows, schema, job, parts, restarts):
    """The job's rows with the input landing in parts, in order of time; with restarts, each part is a run of its own from the checkpoint."""
    where, ts = tmp_path / uuid.uuid4().hex, [x.split()[0] for x in schema.split(", ")].index("ts")
    rows, out = [*sorted(rows, key=lambda r: r[ts]), LAST[schema]], None
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        if restarts or k + size >= len(rows):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
            out = state.ran(job(stream), f"{where}/job")
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("parts", "restarts"), [(1, False), (4, False), (3, True)])
def test_gate_in_a_stream_is_the_batch_gate(spark, tmp_path, parts, restarts):
    rows = attempts(1)
    expected = sorted((tuple(r) for r in snapshots.gated_runs(spark.createDataFrame(rows, ATTEMPT)).collect()), key=repr)
    assert streamed(spark, tmp_path, rows, ATTEMPT, lambda s: state.gated_runs(s, "1 minute"), parts, restarts) == expected


@pytest.mark.parametrize(("parts", "restarts"), [(1, False), (3, True)])
def test_changes_taken_back_in_a_stream(spark, tmp_path, parts, restarts):
    rows = changes(2)
    expected = sorted((tuple(r) for r in snapshots.taken_back(spark.createDataFrame(rows, CHANGE)).collect()), key=repr)
    assert len(expected) > 50 and {x[2] for x in expected} == {"inverse pair", "repetition"}
    assert streamed(spark, tmp_path, rows, CHANGE, lambda s: state.taken_back(s, "1 minute"), parts, restarts) == expected


def test_a_silent_key_expires(spark, tmp_path):
    days = 60 * 24
    rows = [(1, 1, minutes(0)), (1, 2, minutes(3 * days)), (1, 3, minutes(20 * days)), (2, 4, minutes(21 * days))]
    got = streamed(spark, tmp_path, rows, WRITE, lambda s: state.expiries(s, "1 minute"), 2, True)
    assert got == [(1, minutes(10 * days), 2), (1, minutes(27 * days), 1), (2, minutes(28 * days), 1)]


def test_nothing_is_left_of_silent_keys(spark, tmp_path):
    """The state store holds no row of a key whose lock or entry is over."""
    rows = [(1, 1, minutes(0)), (2, 2, minutes(9))]
    streamed(spark, tmp_path, rows, WRITE, lambda s: state.expiries(s, "1 minute"), 1, False)
    folder = next(tmp_path.glob("*/job/state"))
    with state.rocks_db(spark):
        left = spark.read.format("statestore").option("stateVarName", "entry").load(str(folder))
        assert left.where(F.col("key.key") > 0).count() == 0


@pytest.mark.parametrize(("parts", "restarts"), [(1, False), (3, True)])
def test_entries_as_sessions_are_those_of_the_state(spark, tmp_path, parts, restarts):
    """Sessions, which need no Python, give what the processor gives; a write when the days are just over begins a new entry."""
    week, dice = 7 * 24 * 60, random.Random(3)
    rows = [(1, 1, minutes(0)), (1, 2, minutes(week)), (2, 3, minutes(0)), (2, 4, minutes(week - 1)), *((3 + dice.randrange(9), k, minutes(dice.randrange(20 * week))) for k in range(10, 200))]
    got = streamed(spark, tmp_path, rows, WRITE, lambda s: jobs.expiries(s, "1 minute"), parts, restarts)
    assert {x for x in got if x[0] < 3} == {(1, minutes(week), 1), (1, minutes(2 * week), 1), (2, minutes(2 * week - 1), 2)}
    assert got == streamed(spark, tmp_path, rows, WRITE, lambda s: state.expiries(s, "1 minute"), parts, restarts)


def test_a_user_is_one_key_for_all_changes(spark, tmp_path):
    """Calls to the state store go by users and sites, not by products and values."""
    streamed(spark, tmp_path, changes(4), CHANGE, lambda s: state.taken_back(s, "1 minute"), 1, False)
    folder = next(tmp_path.glob("*/job/state"))
    with state.rocks_db(spark):
        left = spark.read.format("statestore").option("stateVarName", "doomed").load(str(folder))
        assert left.select("key").distinct().count() == 3


def test_a_user_is_one_key_for_all_changes(spark, tmp_path):
    """Calls to the state store go by users and sites, not by products and values."""
    streamed(spark, tmp_path, changes(4), CHANGE, lambda s: state.taken_back(s, "1 minute"), 1, False)
    folder = next(tmp_path.glob("*/job/state"))
    with state.rocks_db(spark):
        left = spark.read.format("statestore").option("stateVarName", "doomed").load(str(folder))
        assert left.select("key").distinct().count() == 3
