"""SimHash near-dedup: 64-bit fingerprints linked at a small Hamming radius, components of links by star contraction.

Equal fingerprints collapse first, so a group of copies costs one row. Distinct fingerprints then meet in blocks by the pigeonhole rule:
radius 2 leaves one of three blocks of bits untouched, and the two changes that may fall into the rest leave one of its three parts
untouched too, so every linked pair shares one of nine keys of about 35 bits. Within a key, tiles of fingerprints in order of population
count are compared exactly by exclusive-or and bit counts; tile pairs whose population counts differ beyond the radius are skipped. A key
with more rows than ``TILE`` is dealt to several tasks as tile pairs. A unit gives a spanning forest of its links, not all pairs, which keeps
the components and no more rows than it has members.

Nodes are fingerprints, not ids: what ids a component's rows have matters only for its name. A fingerprint or a node with a great many rows or links is
joined apart (``common.joined``), so that no task takes it whole.

Defined cases: null text is empty; a text without words has fingerprint zero, linked like any other; documents with equal or null ``doc_id``
are rows of their own with one component id (null only if every id in the component is null); repeated rows are linked like copies; very long texts
are hashed whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, joined, mapped, raw, saved

RADIUS = 2
SHINGLE = 3
#: Rows of a comparison unit: a key with more is split into tiles of about this size.
TILE = 4096
#: Fingerprints in one tile of the matrix comparison.
SIDE = 1024
#: Fixed by the contract.
SEED = 42


def fingerprint(text: bytes) -> int:
    """Of UTF-8 text: bit set if over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)])
    n = len(words) - SHINGLE + 1
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    counts = sum(np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, n, 65536))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    fps = np.array([fingerprint(x) for x in raw(batch)], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits in a long."""
    return mapped(id_text(docs), fingerprint_batch, "doc_id long, fp long")


def bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1))


def block_keys(fp: Column) -> Column:
    """The nine keys that a fingerprint shares with at least one other within radius 2."""
    keys = []
    for i, (low, n) in enumerate(((0, 22), (22, 21), (43, 21))):
        rest = [(a, b) for a, b in ((0, 22), (22, 21), (43, 21)) if a != low]
        (a, an), (b, bn) = rest
        parts = [[(a, 14)], [(a + 14, an - 14), (b, 7)], [(b + 7, bn - 7)]]
        for j, part in enumerate(parts):
            key = F.lit(i * 3 + j).cast("long") * F.lit(1 << 22) + bits(fp, low, n)
            for at, m in part:
                key = key * F.lit(1 << m) + bits(fp, at, m)
            keys.append(key)
    return F.array(*keys)


def tile_links(fps: np.ndarray, radius: int = RADIUS, side: int = SIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) within the radius, tile by tile; fps must be in order of population count."""
    counts = np.bitwise_count(fps)
    starts = range(0, len(fps), side)
    for a in starts:
        for b in starts[a // side :]:
            if counts[b] > counts[min(a + side, len(fps)) - 1] + radius:
                break
            i, j = np.nonzero(np.bitwise_count(fps[a : a + side, None] ^ fps[None, b : b + side]) <= radius)
            own = i + a < j + b
            yield i[own] + a, j[own] + b


def forest(nodes: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """(node, smaller node of its part) for each node of a unit that isn't the smallest of its linked part."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    nodes, label = nodes[order], np.arange(len(order))
    for i, j in tile_links(fps[order]):
        while len(i):  # each round joins parts; the links whose ends are already together need no more work
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                low = np.arange(len(label))
                np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
                while (low != low[low]).any():
                    low = low[low]
                label = low[label]
    root = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(root, label, nodes)
    root = root[label]
    return [(int(n), int(r)) for n, r in zip(nodes[nodes != root], root[nodes != root], strict=True)]


def unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, node, fp) in order of unit; a unit's rows may go over several batches."""
    kept: list[tuple[np.ndarray, ...]] = []

    def close(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        unit, node, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        ends = np.r_[starts[1:], len(unit)]
        found: list[tuple[int, int]] = []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            found += forest(node[a:b], fp[a:b].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"]) if found else None

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in ("unit", "node", "fp"))
        last = columns[0][-1]
        cut = int(np.searchsorted(columns[0], last))
        if cut or kept and kept[-1][0][-1] != last:
            if (out := close([*kept, tuple(c[:cut] for c in columns)])) is not None:
                yield out
            kept = []
        kept.append(tuple(c[cut:] for c in columns))
    if kept and (out := close(kept)) is not None:
        yield out


def links(reps: DataFrame) -> DataFrame:
    """(u, v), u > v: forests over the nodes of ``reps`` (node, fp) whose parts are those of all links within the radius."""
    keyed = reps.select("node", "fp", F.explode(block_keys(F.col("fp"))).alias("key"), F.bit_count("fp").alias("pop"))
    per = keyed.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
    hot = per.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / TILE).cast("int").alias("t")))).alias("tiles")).where(F.col("n") > TILE).select("key", "tiles")
    own = F.struct(F.col("pop").alias("p"), F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("pop"))).cast("int").alias("s"))
    near = F.flatten(F.transform(F.sequence(F.lit(-RADIUS), F.lit(RADIUS)), lambda d: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("tiles", F.col("pop") + d), F.lit(0))), lambda s: F.struct((F.col("pop") + d).alias("p"), (s - 1).cast("int").alias("s")))))
    pairs = F.transform(F.filter(near, lambda x: x["s"] >= 0), lambda x: F.xxhash64("key", F.least(own, x), F.greatest(own, x)))
    dealt = keyed.join(hot, "key", "left").select(F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(pairs)).alias("unit"), "node", "fp")
    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(unit_links, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that isn't the smallest of its component, with the smallest one, by large-star and small-star rounds.

    A round ends in a reliable checkpoint; the driver sees a count and a checksum. The rounds grow with the logarithm of the longest path.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if not mark[0] or mark == was:
            return now
        was = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "low").alias("low"), "n")
        large = joined(both, low, "u", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
        small = joined(large, least, "u", mark[0]).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").union(least.select("u", F.col("low").alias("v")))
        now = saved(small.distinct())


def named(prints: DataFrame, of: list[str]) -> DataFrame:
    """(fp, n, first): each fingerprint's number of rows, and the least (``of``) of its component's rows that have an id."""
    reps = saved(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct(*of))).alias("first")))
    roots = components(links(reps.select(F.col("fp").alias("node"), "fp")))
    placed = reps.join(roots.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    return joined(placed.select("fp", "root", F.col("n").alias("rows")), least, "root", reps.count()).select("fp", F.col("rows").alias("n"), "first")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = saved(fingerprints(docs))
    own = saved(named(prints, ["doc_id"]).select("fp", "n", F.col("first.doc_id").alias("component_id")))
    return joined(prints, own, "fp", prints.count())


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, one for each component: that with its smallest doc_id (of rows that share it, the one with the least hash of its text).

    Components are those of fingerprints, whatever ids their rows have: unlike texts that share an id are in different ones. A row without an id
    stays. Texts move once, for the join by id and hash.
    """
    keyed = id_text(docs).select("doc_id", "text", text_hash())

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return fingerprint_batch(batch).append_column("h", batch.column("h"))

    prints = saved(mapped(keyed, of_batch, "doc_id long, fp long, h long"))
    # one row of each component: the least of its fingerprints' own
    least = named(prints, ["doc_id", "h"]).where("first is not null").select(F.col("first.doc_id").alias("named_id"), F.col("first.h").alias("named_h")).distinct()
    row = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_hash())
    own = row.join(least, (F.col("own_id") == F.col("named_id")) & (F.col("h") == F.col("named_h")), "left_semi")
    kept = own.groupBy("own_id", "h").agg(F.min_by("row", F.isnull("row.text")).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
