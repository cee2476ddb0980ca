"""Suffix-array dedup: bytes that an earlier 100-byte string already holds, by longest-previous-factor (LPF) arrays of what can match.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier in the corpus: in a smaller doc_id, or further left in the same document.
That is where the LPF array has LENGTH or more. One suffix array over all texts would not be distributed, so positions that can match are first
brought together by content, and each such group gets its own suffix order:

1. Every window of ``LENGTH`` bytes takes the least hash among its grams of ``GRAM`` bytes, its anchor (winnowing). Equal windows have equal anchors.
   A run of windows with one anchor is a stretch: one row with the anchor, the place, and a digest of the bytes that the windows cover. Equal
   stretches within a batch collapse to the first, the rest being copies: a passage in a third of all documents costs a row per batch.
2. Stretches meet by anchor. Equal ones (anchor, digest of 128 bits and number of windows) are copies of the first. Where stretches with one anchor differ, as at
   the edges of a copied passage, the first of each kind goes on. An anchor with more than ``HOT`` stretches, as a very common line has, is read
   as a stream, and its kinds are parted anew by ``MINIMA`` other least hashes of each window, which equal windows share too, and meet again.
3. Their bytes are fetched and laid end to end in order of place. Suffixes take their order by prefix doubling; in it, previous and next smaller places give
   each window's earlier matches, and where either shares LENGTH bytes (LPF >= LENGTH) the window is a copy.
4. The copied windows of a document merge to intervals, which are cut out of its text.

Texts travel by doc_id and a hash of the text, for steps 3 and 4; everything else is numbers. Texts are read whole.

Defined cases: null text is empty; texts of fewer than 100 bytes lose nothing; rows with equal doc_id count as one document that starts anew in each, so
that a repeated row is no earlier than its twin and both give the same result; a null doc_id comes first; an empty table gives an empty result; a very long text is one
task's work at a time, a hundred bytes a byte at most; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, mapped, raw, saved

#: Fixed by the contract.
LENGTH = 100
GRAM = 24
#: Bytes whose suffixes are put in order at once; a group of stretches with one anchor isn't parted.
SUFFIXES = 4 << 20
#: Stretches of an anchor beyond which its kinds are parted by so many more hashes.
HOT, MINIMA = 1024, 6
NULL_ID = -(1 << 63)

LOW = (1 << 32) - 1
#: Marks on a stretch's number of windows: its anchor stands there twice; it is a copy already.
TWICE, DONE = 1 << 30, 1 << 31


def words8(data: bytes, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on, as a number (zeros after the end)."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))).view(order)[:, 0].astype(np.uint64, copy=False)


def gram_hashes(data: bytes) -> np.ndarray:
    w, n = words8(data), len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    h += w[16 : n + 16] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        h, step = np.minimum(h[:-step], h[step:]), 2 * step
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def digests(text: bytes, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Two numbers for each stretch: 128 bits of a hash of its bytes."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(starts.tolist(), (starts + windows + LENGTH - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)


#: Columns of stretches: anchor, start, windows, two digests.
Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def stretches(text: bytes) -> Stretches:
    """(anchor, start, windows, digest of 128 bits) of each stretch of a text of LENGTH bytes or more; windows has TWICE added where the anchor stands there twice.

    Only such a stretch can hold equal windows. A gram is an anchor if it equals the largest minimum of the windows that it is in; two equal
    ones that a stretch has next to each other are at most a window apart, with no other anchor between.
    """
    grams, width = gram_hashes(text), LENGTH - GRAM + 1
    least = sliding_least(grams, width)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    windows = np.diff(np.r_[starts, len(least)])
    top = np.full(width - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    anchors = np.flatnonzero(grams == ~sliding_least(np.concatenate([top, ~least, top]), width))
    value = grams[anchors]
    twice = value[1:][(value[1:] == value[:-1]) & (np.diff(anchors) <= width)]
    found = digests(text, starts, windows)
    if len(twice):
        windows = windows + TWICE * np.isin(least[starts], twice)
    return least[starts].view(np.int64), starts, windows, found[:, 0], found[:, 1]


def parted(anchor: int, data: bytes, at: int) -> Stretches:
    """A stretch's parts: runs of windows that agree in MINIMA more least hashes of their grams; ``at`` is where it stands. A part that holds a gram twice has TWICE added."""
    grams, width = gram_hashes(data), LENGTH - GRAM + 1
    key = np.full(len(data) - LENGTH + 1, anchor, np.int64).view(np.uint64)
    for j in range(1, MINIMA + 1):
        other = (grams ^ np.uint64(0xD6E8FEB86659FD93 * j & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        key = (key ^ sliding_least(other ^ (other >> np.uint64(32)), width)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    windows = np.diff(np.r_[starts, len(key)])
    found = digests(data, starts, windows)
    twice = [n > 1 and len(np.unique(grams[a : a + n + width - 1])) < n + width - 1 for a, n in zip(starts.tolist(), windows.tolist(), strict=True)]
    return key[starts].view(np.int64), starts + at, windows + TWICE * np.array(twice), found[:, 0], found[:, 1]


def rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns.values()], names=list(columns))


def runs(d: np.ndarray, k: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals in order of (d, k, start), with adjacent ones joined."""
    if not len(d):
        return d, k, start, n
    begin = np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (start[1:] > start[:-1] + n[:-1])]
    at = np.flatnonzero(begin)
    last = np.r_[at[1:], len(d)] - 1
    return d[at], k[at], start[at], start[last] + n[last] - start[at]


#: A stretch on its way: anchor, digest, text key, y = start * 2^32 + windows with marks, d = doc_id.
STRETCH = "h long, x long, x2 long, k long, y long, d long"


def collapsed(d: np.ndarray, k: np.ndarray, found: Stretches) -> pa.RecordBatch:
    """A batch's stretches, first ones for comparing elsewhere, copies as merged intervals under an anchor of their own. (d, k) is each one's document."""
    h, start, n, *digest = found
    count = n & (TWICE - 1)
    order = np.lexsort((k, start, d, count, *digest[::-1], h))
    same = np.r_[False, np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (h, *digest, count)])]
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    copy = np.zeros(len(h), bool)
    copy[order] = (d[order] != d[first]) | (start[order] != start[first])
    at = np.flatnonzero(copy)
    at = at[np.lexsort((start[at], k[at], d[at]))]
    c_d, c_k, c_start, c_n = runs(d[at], k[at], start[at], count[at])
    own, none = ~copy, np.zeros(len(c_d), np.int64)
    return rows(h=np.r_[h[own], c_k * 0x9E3779B9 + c_start], x=np.r_[digest[0][own], none], x2=np.r_[digest[1][own], none], k=np.r_[k[own], c_k], y=(np.r_[start[own], c_start] << 32) | np.r_[n[own], c_n + DONE], d=np.r_[d[own], c_d])


def gathered(parts: list[tuple[int, int, Stretches]]) -> pa.RecordBatch | None:
    """(d, k, stretches) of several texts or stretches, collapsed."""
    if not parts:
        return None
    sizes = [len(x[0]) for _, _, x in parts]
    d, k = (np.repeat(np.array([p[j] for p in parts], np.int64), sizes) for j in (0, 1))
    return collapsed(d, k, tuple(np.concatenate([x[j] for _, _, x in parts]) for j in range(5)))


def anchor_batch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    return gathered([(d, k, stretches(text)) for d, k, text in zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), raw(batch), strict=True) if len(text) >= LENGTH])


def by_group(batches: Iterator[pa.RecordBatch], least: int, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups of equal h, from batches in its order, of at least so many bytes but for the last.

    A group of more than ``most`` rows comes by itself in several tables, marked True.
    """
    ready: list[pa.RecordBatch] = []  # whole groups
    open_: list[pa.RecordBatch] = []  # what has come of the last one
    hot: int | None = None  # the group that is being read as a stream

    def taken(of: list[pa.RecordBatch], streamed: bool = False) -> Iterator[tuple[pa.Table, bool]]:
        if of:
            yield pa.Table.from_batches(of), streamed
            of.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        ends = np.r_[starts[1:], len(h)]
        large = ends - starts > (len(h) if most is None else most)
        if not open_ or open_[-1].column("h")[-1].as_py() != h[0]:
            ready += open_
            open_.clear()
        # the first group, the last, and large ones between are looked at one by one
        at = 0
        for g in sorted({0, len(starts) - 1, *np.flatnonzero(large).tolist()}):
            a, b = int(starts[g]), int(ends[g])
            if a > at:
                ready.append(batch.slice(at, a - at))
            at = b
            part = batch.slice(a, b - a)
            if hot == h[a]:
                yield from taken([part], True)
                continue
            hot = None
            open_.append(part)
            if most is not None and sum(x.num_rows for x in open_) > most:
                hot = int(h[a])
                yield from taken(ready)
                yield from taken(open_, True)
            elif g < len(starts) - 1:
                ready += open_
                open_.clear()
        if sum(x.nbytes for x in ready) >= least:
            yield from taken(ready)
    yield from taken(ready + open_)


#: A found interval (kind 0), a stretch whose bytes are to be compared (kind 1), or to be parted before (kind 2).
FOUND = "kind long, h long, d long, k long, s long, n long"
#: The order in which ``meet`` takes stretches: equal ones together, the first place first.
MEETING = ("h", "x", "x2", "y & 1073741823", "d", "y", "k")


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order: copies of equal ones, and the first of each kind where an anchor has several. Of an anchor with many rows every kind is to be parted."""
    last: tuple = ()
    for table, hot in by_group(batches, 1 << 20, HOT):
        h, x, x2, k, y, d = (table.column(c).to_numpy() for c in ("h", "x", "x2", "k", "y", "d"))
        start, n = y >> 32, y & LOW
        done, twice, n = n >= DONE, n & TWICE > 0, n & (TWICE - 1)
        kind = (h, x, x2, n)
        same = np.r_[bool(last) and last[:4] == tuple(c[0] for c in kind), np.logical_and.reduce([c[1:] == c[:-1] for c in kind]) & ~done[:-1]] & ~done
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        first_d, first_start = d[first], start[first]
        if same[0]:
            first_d, first_start = np.where(first == 0, last[4], first_d), np.where(first == 0, last[5], first_start)
        copy = done | (d != first_d) | (start != first_start)
        # firsts of runs of one kind, and other texts of the same id that have it at the same place
        fresh = ~same | (k != np.r_[k[0] - 1, k[:-1]])
        if hot:
            several = np.ones(len(h), bool)
        else:
            group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
            several = np.bincount(group, ~same & ~done)[group] > 1
        ask = (several | twice) & ~copy & fresh
        out = copy | ask
        yield rows(kind=np.where(copy, 0, 1 + hot)[out], h=h[out], d=d[out], k=k[out], s=start[out], n=n[out])
        last = (h[-1], x[-1], x2[-1], n[-1], first_d[-1], first_start[-1]) if hot and not done[-1] else ()


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller number, or -1: candidates jump to those of their own until they are smaller."""
    p = np.arange(len(x)) - 1
    left = np.flatnonzero(p >= 0)
    while len(left := left[x[p[left]] >= x[left]]):
        p[left] = p[p[left]]
        left = left[p[left] >= 0]
    return p


def next_smaller(x: np.ndarray) -> np.ndarray:
    return len(x) - 1 - previous_smaller(x[::-1])[::-1]


def copied_windows(data: bytes, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the windows that start there have LPF >= LENGTH: an equal window at a smaller place.

    ``place`` orders the windows' places in the corpus, equal places being the same. Suffixes get their order from the order of their first 8, 16, 32
    and 64 bytes and of LENGTH bytes; a window's longest earlier match is with the previous or the next smaller place in that order.
    """
    rank, known = np.unique(words8(data, ">u8"), return_inverse=True)[1], 8
    while 2 * known <= LENGTH:
        follow = np.r_[rank[known:], np.zeros(min(known, len(rank)), rank.dtype)][: len(rank)]
        rank, known = np.unique(rank * (int(rank.max()) + 1) + follow, return_inverse=True)[1], 2 * known
    prefix = rank[starts] * (int(rank.max()) + 1) + rank[starts + LENGTH - known]
    order = np.argsort(prefix, kind="stable")  # suffix order, by the first LENGTH bytes
    place, prefix = place[order], prefix[order]
    # runs whose neighbours have a common prefix (LCP) of LENGTH; a match beyond a run's ends is shorter, so the search for it may stop there
    run, top = np.cumsum(np.r_[0, prefix[1:] != prefix[:-1]]), int(place.max(initial=0)) + 1
    before, after = previous_smaller(run * top + place), next_smaller((run[-1:] - run) * top + place)
    at = np.arange(len(order))
    lpf = np.zeros(len(order), bool)
    for match in (np.where(before < 0, at, before), np.where(after >= len(order), at, after)):
        lpf |= (run[match] == run) & (place[match] < place)
    out = np.zeros(len(order), bool)
    out[order] = lpf
    return out


def longest_previous_factors(data: bytes) -> np.ndarray:
    """LPF of a text, in full: at each position the longest common prefix with an earlier suffix. For texts that one task holds."""
    n = len(data)
    order = np.array(sorted(range(n), key=lambda i: data[i:]), int)

    def common(i: int, j: int) -> int:
        return next((k for k in range(n - max(i, j)) if data[i + k] != data[j + k]), n - max(i, j))

    lpf = np.zeros(n, int)
    for match in (previous_smaller(order), next_smaller(order)):
        for r in np.flatnonzero((match >= 0) & (match < n)).tolist():
            lpf[order[r]] = max(lpf[order[r]], common(int(order[r]), int(order[match[r]])))
    return lpf


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with their bytes, in order of anchor: intervals of windows that are copies of windows in other stretches or further left."""
    for table, _ in by_group(batches, SUFFIXES):
        d, k, s = (table.column(c).to_numpy() for c in ("d", "k", "s"))
        by_place = np.lexsort((s, k, d))
        d, k, s, table = d[by_place], k[by_place], s[by_place], table.take(pa.array(by_place))
        texts = [x.as_py() for x in table.column("bytes")]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        begin, windows = np.cumsum(n) - n, n - LENGTH + 1
        which = np.repeat(np.arange(len(texts)), windows)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        at, doc, key = s[which] + inside, d[which], k[which]
        # places in the corpus, numbered in order of (doc_id, start)
        order = np.lexsort((at, doc))
        step = np.r_[False, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])]
        place = np.zeros(len(which), np.int64)
        place[order] = np.cumsum(step)
        copied = np.flatnonzero(copied_windows(b"".join(texts), begin[which] + inside, place))
        f_d, f_k, start, length = runs(doc[copied], key[copied], at[copied], np.ones(len(copied), np.int64))
        yield rows(kind=np.zeros(len(f_d)), h=np.zeros(len(f_d)), d=f_d, k=f_k, s=start, n=length)


def cut(text: bytes, intervals: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text without the bytes of (start, windows) intervals, and the maximal runs removed."""
    spans: list[tuple[int, int]] = []
    for a, n in sorted(intervals):
        b = a + n + LENGTH - 1
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    edges = [0, *(e for x in spans for e in x), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans


def keyed(docs: DataFrame) -> DataFrame:
    """(d, k, text): the id with a number for null, and a hash of the text to tell apart rows with one id."""
    return id_text(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("k"), "text")


def with_intervals(texts: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    return texts.join(found.groupBy("d", "k").agg(F.collect_set(F.struct("h", "s", "n")).alias("asked")), ["d", "k"], how)


def met(stretched: DataFrame) -> DataFrame:
    return stretched.repartition("h").sortWithinPartitions(*map(F.expr, MEETING)).mapInArrow(meet, FOUND)


def asked_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[dict]]]:
    return zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), raw(batch), batch.column("asked").to_pylist(), strict=True)


def part_batch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    return gathered([(d, k, parted(x["h"], text[x["s"] : x["s"] + x["n"] + LENGTH - 1], x["s"])) for d, k, text, asked in asked_of(batch) for x in asked])


def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = [(x["h"], d, k, x["s"], text[x["s"] : x["s"] + x["n"] + LENGTH - 1]) for d, k, text, asked in asked_of(batch) for x in asked]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["h", "d", "k", "s", "bytes"])


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts dealt by id and hash, intervals of copied windows)."""
    texts = keyed(docs)
    first = saved(met(mapped(texts, anchor_batch, STRETCH)))
    dealt = texts.repartition("d", "k")
    found, asked = first.where("kind = 0"), first.where("kind = 1")
    if not first.where("kind = 2").isEmpty():
        # in one plan with what follows, so that the texts are dealt once
        second = met(mapped(with_intervals(dealt, first.where("kind = 2"), "inner"), part_batch, STRETCH))
        found, asked = found.unionByName(second.where("kind = 0")), asked.unionByName(second.where("kind > 0"))
    fetched = mapped(with_intervals(dealt, asked, "inner"), fetch, "h long, d long, k long, s long, bytes binary")
    return dealt, found.unionByName(fetched.repartition("h").sortWithinPartitions("h").mapInArrow(compare, FOUND))


def remove(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: sizes, the number of maximal removed runs, the digest of what is left; ``with_text`` adds that itself (as bytes) and the runs."""
    dealt, found = find(docs)

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for d, _, text, asked in asked_of(batch):
            left, spans = cut(text, [(x["s"], x["n"]) for x in asked or ()])
            out.append((None if d == NULL_ID else d, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest()) + ((left, [{"a": a, "b": b} for a, b in spans]) if with_text else ()))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))] * with_text
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<a:long,b:long>>" * with_text
    return mapped(with_intervals(dealt, found), of_batch, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir))
