"""Rules with memory as running state: runs behind a lock, writes that expire, changes that are taken back. The batch forms are in ``operators/snapshots.py``.

A key's rows wait until the watermark has passed them and are then read once in order of time, so the result doesn't depend on how the input falls into
micro-batches. State is what the rule needs and no history: it goes by event-time timers when a key is silent, and lies in RocksDB, beside the stream's
checkpoint, from which a restarted query goes on. A row that is later than the delay is dropped, as any stream with a watermark does.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.snapshots import LOCK_MINUTES, TAKEN_BACK_DAYS

# Fixed value: days for which a write holds.
HOLDS_DAYS = 7
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EPOCH = pd.Timestamp(0)


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, which timers and several states for a key need."""
    was = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(ROCKS[0]) if was is None else spark.conf.set(ROCKS[0], was)


def ran(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream until its input is used up, and gives all rows that it has written to the folder so far; called again, it goes on from its checkpoint."""
    spark = stream.sparkSession
    with rocks_db(spark):
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class InOrder(StatefulProcessor):
    """Reads a key's rows in order of (ts, id), each when the watermark has passed it. ``row`` gives the outputs of one, ``passed`` those of time alone.

    Each call to the state store is a message to another process, so a key's state is loaded once, changed in memory by all its rows, and saved once.
    """

    columns, output = "id long, ts timestamp", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.columns)
        self.names = [x.split()[0] for x in self.columns.split(", ")]
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def load(self) -> None: ...

    def save(self) -> None: ...

    def row(self, key: tuple, row: dict) -> list[tuple]: ...

    def passed(self, key: tuple, now: pd.Timestamp) -> list[tuple]:
        return []

    def wakes(self) -> list[pd.Timestamp]:
        """When time alone has something to do."""
        return []

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in self.output.split(", ")])

    def timer(self, at: pd.Timestamp) -> None:
        self.handle.registerTimer(-(-(at - EPOCH) // pd.Timedelta(milliseconds=1)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.pending.appendList([tuple(x) for x in part[self.names].itertuples(index=False)])
            first = part["ts"].min() if first is None else min(first, part["ts"].min())
        self.timer(first)
        yield self.frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = EPOCH + pd.Timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        rows = sorted((dict(zip(self.names, x, strict=True)) | {"ts": pd.Timestamp(x[self.names.index("ts")])} for x in self.pending.get()), key=lambda r: (r["ts"], r["id"])) if self.pending.exists() else []
        later, out = [], []
        self.load()
        for r in rows:
            if r["ts"] <= now:
                out += self.row(key, r)
            else:
                later.append(r)
        out += self.passed(key, now)
        self.save()
        if len(later) < len(rows):
            self.pending.clear()
            if later:
                self.pending.put([tuple(r[n] if n != "ts" else r[n].to_pydatetime() for n in self.names) for r in later])
        for at in [*(r["ts"] for r in later[:1]), *self.wakes()]:
            if at > now:
                self.timer(at)
        yield self.frame(out)

    def close(self) -> None: ...


class RunGate(InOrder):
    """A start runs if a snapshot came since the last run and no other run holds the lock; an expired lock goes."""

    columns, output = "id long, ts timestamp, kind string", "key long, id long, outcome string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", "fresh boolean, locked timestamp")

    def load(self) -> None:
        self.fresh, locked = self.gate.get() if self.gate.exists() else (False, None)
        self.locked = None if locked is None or pd.isna(locked) else pd.Timestamp(locked)

    def save(self) -> None:
        if self.fresh or self.locked is not None:
            self.gate.update((self.fresh, None if self.locked is None else self.locked.to_pydatetime()))
        else:
            self.gate.clear()

    def row(self, key: tuple, row: dict) -> list[tuple]:
        if row["kind"] == "snapshot":
            self.fresh = True
            return []
        if row["kind"] == "end":
            self.locked = None
            return []
        held = self.locked is not None and row["ts"] - self.locked < pd.Timedelta(minutes=LOCK_MINUTES)
        outcome = "locked" if held else "run" if self.fresh else "nothing new"
        if outcome == "run":
            self.fresh, self.locked = False, row["ts"]
        return [(key[0], row["id"], outcome)]

    def passed(self, key: tuple, now: pd.Timestamp) -> list[tuple]:
        if self.locked is not None and now - self.locked >= pd.Timedelta(minutes=LOCK_MINUTES):
            self.locked = None
        return []

    def wakes(self) -> list[pd.Timestamp]:
        return [] if self.locked is None else [self.locked + pd.Timedelta(minutes=LOCK_MINUTES)]


class Expiry(InOrder):
    """A key's entry holds for some days after its last write; what expires is given with its number of writes, and its state goes."""

    output = "key long, expired timestamp, writes long"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "last timestamp, writes long")

    def load(self) -> None:
        last, self.writes = self.entry.get() if self.entry.exists() else (None, 0)
        self.last = None if last is None else pd.Timestamp(last)

    def save(self) -> None:
        if self.last is None:
            self.entry.clear()
        else:
            self.entry.update((self.last.to_pydatetime(), self.writes))

    def row(self, key: tuple, row: dict) -> list[tuple]:
        out = self.passed(key, row["ts"])
        self.last, self.writes = row["ts"], self.writes + 1
        return out

    def passed(self, key: tuple, now: pd.Timestamp) -> list[tuple]:
        end = next(iter(self.wakes()), None)
        if end is None or end > now:
            return []
        out = [(key[0], end, self.writes)]
        self.last, self.writes = None, 0
        return out

    def wakes(self) -> list[pd.Timestamp]:
        return [] if self.last is None else [self.last + pd.Timedelta(days=HOLDS_DAYS)]


class TakenBack(InOrder):
    """Changes between two values of a product: inverse pairs within some days, each change in one pair, and repetitions of such changes.

    A change is free for so many days; then it is a repetition if changes of its direction have been taken back, or waits (its id alone) until one is.
    A key is a user on a site; its changes between the same two values of a product are a group of their own, since most groups have few rows and a call costs more than a row.
    """

    group = "name string, low long, high long"
    columns, output = f"id long, ts timestamp, up boolean, {group}", "id long, pair long, reason string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.stores = {"free": handle.getListState("free", self.columns), "waiting": handle.getListState("waiting", f"id long, up boolean, {self.group}"), "doomed": handle.getListState("doomed", f"up boolean, {self.group}")}

    def load(self) -> None:
        self.before = {name: list(store.get()) if store.exists() else [] for name, store in self.stores.items()}
        self.free, self.waiting, self.doomed = defaultdict(list), defaultdict(list), {tuple(x) for x in self.before["doomed"]}
        for i, ts, up, *of in self.before["free"]:
            self.free[*of].append((i, pd.Timestamp(ts), up))
        for i, up, *of in self.before["waiting"]:
            self.waiting[*of].append((i, up))

    def save(self) -> None:
        free = [(i, ts.to_pydatetime(), up, *of) for of, own in self.free.items() for i, ts, up in own]
        waiting = [(*x, *of) for of, own in self.waiting.items() for x in own]
        for name, now in (("free", free), ("waiting", waiting), ("doomed", sorted(self.doomed))):
            if now:
                self.stores[name].put(now)
            elif self.before[name]:
                self.stores[name].clear()

    def settle(self, of: tuple, now: pd.Timestamp) -> list[tuple]:
        """Changes of a group that are no longer free are repetitions or wait."""
        kept, out = [], []
        for i, ts, up in self.free[of]:
            if now - ts <= pd.Timedelta(days=TAKEN_BACK_DAYS):
                kept.append((i, ts, up))
            elif (up, *of) in self.doomed:
                out.append((i, None, "repetition"))
            else:
                self.waiting[of].append((i, up))
        self.free[of] = kept
        return out

    def row(self, key: tuple, row: dict) -> list[tuple]:
        of = (row["name"], row["low"], row["high"])
        out, free = self.settle(of, row["ts"]), self.free[of]
        mate = next((x for x in free if row["low"] == row["high"] or x[2] != row["up"]), None)
        if mate is None:
            free.append((row["id"], row["ts"], row["up"]))
            return out
        free.remove(mate)
        gone = {mate[2], row["up"]}
        self.doomed |= {(up, *of) for up in gone}
        out += [(i, None, "repetition") for i, up in self.waiting[of] if up in gone]
        self.waiting[of] = [x for x in self.waiting[of] if x[1] not in gone]
        return [*out, (mate[0], row["id"], "inverse pair"), (row["id"], mate[0], "inverse pair")]

    def passed(self, key: tuple, now: pd.Timestamp) -> list[tuple]:
        return [x for of in list(self.free) for x in self.settle(of, now)]

    def wakes(self) -> list[pd.Timestamp]:
        first = min((ts for own in self.free.values() for _, ts, _ in own), default=None)
        return [] if first is None else [first + pd.Timedelta(days=TAKEN_BACK_DAYS, milliseconds=1)]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return super().frame(rows).astype({"pair": "Int64"})


def _with(stream: DataFrame, keys: list[str], processor: InOrder) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, processor.output, "Append", "EventTime")


def gated_runs(attempts: DataFrame, delay: str) -> DataFrame:
    """(key, id, outcome) of a stream of attempts (key, id, ts, kind) that is late by no more than the delay."""
    return _with(attempts.withWatermark("ts", delay).select("key", "id", "ts", "kind"), ["key"], RunGate())


def expiries(writes: DataFrame, delay: str) -> DataFrame:
    """(key, expired, writes) of a stream of writes (key, id, ts): a row for each entry whose days are over."""
    return _with(writes.withWatermark("ts", delay).select("key", "id", "ts"), ["key"], Expiry())


def taken_back(changes: DataFrame, delay: str) -> DataFrame:
    """(id, pair, reason) of a stream of changes (id, user, site, name, ts, old, new)."""
    own = changes.withWatermark("ts", delay).where("old is not null and new is not null")
    low, high = F.least("old", "new").alias("low"), F.greatest("old", "new").alias("high")
    return _with(own.select("id", "user", F.coalesce("site", F.lit("")).alias("site"), F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), "ts", low, high, (F.col("old") < F.col("new")).alias("up")), ["user", "site"], TakenBack())
