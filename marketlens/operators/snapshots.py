"""What a run does with a new snapshot or change, given what came before: partial snapshots, runs behind a lock, and changes that are taken back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A snapshot below this share of at least so many known products is partial; a lock's minutes; the days within which a change is taken back.
PARTIAL, KNOWN, LOCK_MINUTES, TAKEN_BACK_DAYS = 0.6, 10, 45, 7


def in_order(rows: DataFrame, keys: list[str], order: list[str], of_group: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """What a function gives of each group's rows in order: partitions hold whole groups, one after another, so that many small groups cost no more than their rows."""
    kinds = dict(x.split() for x in schema.split(", "))

    def framed(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*kinds]).astype({c: "Int64" for c, kind in kinds.items() if kind in ("long", "bigint")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = chain.from_iterable(b.itertuples(index=False, name="Row") for b in batches)
        out: list[tuple] = []
        for _, own in groupby(every, lambda r: r[: len(keys)]):
            out += of_group(list(own))
            if len(out) >= 10_000:
                yield framed(out)
                out = []
        yield framed(out)

    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def partial_gate(snapshots: DataFrame) -> DataFrame:
    """(site, t, n, status, known): snapshots (site, t, n products) in order of time. An empty one is an error, a partial one is refused once and accepted if it comes again; known is what the site then counts."""

    def one(rows: list) -> list[tuple]:
        known, status, out = 0, "", []
        for r in rows:
            partial = known >= KNOWN and r.n < known * PARTIAL and status != "partial"
            status = "error" if r.n == 0 else "partial" if partial else "success"
            known = r.n if status == "success" else known
            out.append((r.site, r.t, r.n, status, known))
        return out

    own = snapshots.select("site", F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"))
    return in_order(own, ["site"], ["t", "n"], one, f"site {dict(own.dtypes)['site']}, t long, n long, status string, known long")


def gated_runs(attempts: DataFrame) -> DataFrame:
    """(key, id, outcome) of attempts (key, id, ts, kind): a start runs if a snapshot came since the last run and no other run holds the lock, which ends with the run or after its time.

    kind is snapshot, start or end. What a key does follows from all it did before, so its attempts are one group, read once in order.
    """

    def one(rows: list) -> list[tuple]:
        fresh, lock, out = False, None, []
        for r in rows:
            if r.kind == "snapshot":
                fresh = True
            elif r.kind == "end":
                lock = None
            elif lock is not None and r.ts - lock < pd.Timedelta(minutes=LOCK_MINUTES):
                out.append((r.key, r.id, "locked"))
            elif not fresh:
                out.append((r.key, r.id, "nothing new"))
            else:
                fresh, lock = False, r.ts
                out.append((r.key, r.id, "run"))
        return out

    return in_order(attempts.select("key", "id", "ts", "kind"), ["key"], ["ts", "id"], one, "key long, id long, outcome string")


def taken_back(changes: DataFrame) -> DataFrame:
    """(id, pair, reason) of changes (id, user, site, name, ts, old, new) that go: inverse pairs within seven days, each change in one pair, and repetitions of such changes.

    In order of time a change pairs with the first later inverse that is still free. Only changes between the same two values can meet, so they are a group of their own.
    """

    def one(rows: list) -> list[tuple]:
        free: list = []
        pair: dict[int, int] = {}
        for r in rows:
            free = [x for x in free if r.ts - x.ts <= pd.Timedelta(days=TAKEN_BACK_DAYS)]
            mate = next((x for x in free if x.old == r.new and x.new == r.old), None)
            if mate is None:
                free.append(r)
            else:
                free.remove(mate)
                pair[mate.id], pair[r.id] = r.id, mate.id
        doomed = {(r.old, r.new) for r in rows if r.id in pair}
        return [(r.id, pair.get(r.id), "inverse pair" if r.id in pair else "repetition") for r in rows if r.id in pair or (r.old, r.new) in doomed]

    own = changes.select("user", F.coalesce("site", F.lit("")).alias("site"), F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), F.least("old", "new").alias("low"), F.greatest("old", "new").alias("high"), "id", "ts", "old", "new").where("old is not null and new is not null")
    return in_order(own, ["user", "site", "name", "low", "high"], ["ts", "id"], one, "id long, pair long, reason string")
