"""The prefix trie of conversations by Euler tour: enter and exit arcs per node, the tour ranked as a list, subtree sums as differences of prefix sums.

A node is a distinct sequence of first turns. Its key is its depth and two 64-bit sums by exclusive-or of its turns' hashes, each of
which covers the turn's place; such sums run in two steps (stretches of a conversation, and within one), so a very long conversation is many small
groups. A node's name is its smallest member and its depth.

The tour: a node's enter arc leads to its first child's or else to its own exit arc; an exit arc to the next sibling's enter arc or else to the parent's
exit arc. Nodes are numbered in the order of (smallest member, depth), in which much of the tour is local, and cut into blocks of about
``BLOCK``; a block joins the arcs that follow each other within it into one element by pointer jumping in numpy. The list of what is left is ranked by one
task if it has at most ``ONE`` elements; else rounds of random mating join a quarter of the elements to their predecessors until it has, and
the rounds are undone in reverse. Every arc so gets its place in the tour, and the sums of leaves and savings up to it.

Turns, siblings and the ends of a node are ordered by range partitions, never in one task: a hot conversation or a node with a great many children is
spread. Only the digest of a node's ends is made by one task, as SHA-256 reads its input in order; it gets them as chunks of text.

Defined cases: null role or text is empty; a null ``turn`` comes first; turns of one number are ordered by role and text, repeated rows stand side by side;
rows without a ``conv_id`` belong to no conversation; long texts are hashed where they are; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined, saved, table

#: Fixed by the contract: a conversation shares turns with the one at the start of its five, ``crc32 % 9`` of them.
FIVE, NINE = 5, 9
#: Turns in a stretch; nodes in a block; elements that one task ranks; ids in a chunk of a node's ends.
TURNS, BLOCK, ONE, IDS = 1024, 1 << 16, 1 << 17, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``at``: the row's number, from 1, in its group by the order. A group may be large: rows are cut into ranges, and numbered within them first."""
    own = saved(rows.repartitionByRange(*(F.col(x) for x in group), *order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range", *group)
    per = own.groupBy("range", *group).agg(F.count(F.lit(1)).alias("part"))
    per = per.withColumn("base", F.coalesce(F.sum("part").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part")
    return own.withColumn("within", F.row_number().over(within.orderBy(*order))).join(per, ["range", *group]).withColumn("at", F.col("base") + F.col("within")).drop("range", "within", "base")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, bytes, a, b) for each turn of the rebuilt conversations, and (conv_id, turns) for each conversation."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    turns = saved(numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).drop("turn"))
    own = turns.groupBy("conv_id").agg(F.max("at").alias("n")).withColumn("head", F.crc32(F.col("conv_id").cast("string")) % NINE).withColumn("base", F.col("conv_id") - F.col("conv_id") % FIVE)
    lender = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plans = saved(own.join(lender, "base", "left").withColumn("lent", F.least("head", F.coalesce("base_n", F.lit(0)))).drop("base_n"))
    lent = turns.where((F.col("at") < NINE) & (F.col("conv_id") % FIVE == 0)).withColumnRenamed("conv_id", "base").join(plans.select("base", "conv_id", "head"), "base").where("at <= head").select("conv_id", F.col("at").alias("depth"), "role", "text")
    kept = joined(turns, plans.select("conv_id", "head", "lent", "n"), "conv_id", turns.count()).where("at > head").select("conv_id", (F.col("lent") + F.col("at") - F.col("head")).alias("depth"), "role", "text")
    hashes = [F.xxhash64("depth", "role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "depth", "role").alias("b")]
    parts = lent.unionByName(kept).select("conv_id", "depth", F.octet_length("text").cast("long").alias("bytes"), *hashes)
    return saved(parts), plans.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("turns"))


def members(parts: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, a, b, up_a, up_b): each conversation's nodes below the root, with the keys of their parents."""
    cut = parts.withColumn("stretch", F.floor(F.col("depth") / TURNS))
    whole = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    per = per.select("conv_id", "stretch", *(F.coalesce(F.bit_xor(x).over(whole), F.lit(0)).alias(f"base_{x}") for x in "ab"))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut.select("conv_id", "stretch", "depth", "bytes", F.col("a").alias("own_a"), F.col("b").alias("own_b"), *(F.bit_xor(x).over(within).alias(f"sum_{x}") for x in "ab")).join(per, ["conv_id", "stretch"])
    sums = sums.select("conv_id", "depth", "bytes", "own_a", "own_b", *(F.col(f"sum_{x}").bitwiseXOR(F.col(f"base_{x}")).alias(x) for x in "ab"))
    return sums.select("conv_id", "depth", "bytes", "a", "b", *(F.col(x).bitwiseXOR(F.col(f"own_{x}")).alias(f"up_{x}") for x in "ab"))


def key(depth: str | Column, a: str, b: str) -> Column:
    return F.struct(F.col(depth).alias("depth") if isinstance(depth, str) else depth.alias("depth"), F.col(a).alias("a"), F.col(b).alias("b"))


def nodes(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(v, conv_id, depth, key, up, bytes, n_convs, n_children, parent): v numbers the nodes by blocks in order of (conv_id, depth), parent is the parent's v."""
    below = found.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("bytes"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"))
    every = saved(below.unionByName(root).select("conv_id", "depth", key("depth", "a", "b").alias("key"), F.when(F.col("depth") > 0, key(F.col("depth") - 1, "up_a", "up_b")).alias("up"), "bytes", "n_convs"))
    n = every.count()
    own = saved(every.repartitionByRange(n // BLOCK + 1, "conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("v", F.monotonically_increasing_id()))
    families = own.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    own = saved(own.join(families, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = own.where("n_children > 0").select(F.col("key").alias("up"), F.col("v").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    top = own.where("up is null").select("*", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("parent_conv_id"))
    return saved(joined(own.where("up is not null"), above, "up", n).unionByName(top))


def tour(tree: DataFrame) -> DataFrame:
    """(id, next, leaves, saved): the arcs, 2 v for enter and 2 v + 1 for exit, each with the arc that follows (-1 after the last) and what it adds to the sums."""
    lined = saved(numbered(tree.where("parent is not null").select("v", "parent", "conv_id"), ["parent"], [F.col("conv_id")]).select("v", "parent", "at"))
    first = lined.where("at = 1").select(F.col("parent").alias("v"), F.col("v").alias("first"))
    after = lined.select(F.col("v").alias("other"), "parent", (F.col("at") - 1).alias("at"))
    enter = tree.join(first, "v", "left").select((F.col("v") * 2).alias("id"), F.coalesce(F.col("first") * 2, F.col("v") * 2 + 1).alias("next"), F.when(F.col("first").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    none = [F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")]
    leave = lined.join(after, ["parent", "at"], "left").select((F.col("v") * 2 + 1).alias("id"), F.coalesce(F.col("other") * 2, F.col("parent") * 2 + 1).alias("next"), *none)
    last = tree.where("parent is null").select((F.col("v") * 2 + 1).alias("id"), F.lit(-1).cast("long").alias("next"), *none)
    return enter.unionByName(leave).unionByName(last)


SUMS = ["places", "leaves", "saved"]
ARC = "id long, head long, next long, places long, leaves long, saved long, own_places long, own_leaves long, own_saved long, last boolean"


def contracted(ids: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the elements of a block, in order of id: the first of each one's run within the block, the sums from that to it, and whether a run ends with it."""
    at = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
    inner = ids[at] == after
    before = np.full(len(ids), -1)
    before[at[inner]] = np.flatnonzero(inner)
    first, sums = np.arange(len(ids)), weights.copy()
    while (far := np.flatnonzero(before >= 0)).size:
        p = before[far]
        sums[far] += sums[p]
        first[far], before[far] = first[p], before[p]
    return ids[first], sums, ~inner


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block; a block is held whole."""
    kept: list[np.ndarray] = []

    def close(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.argsort(rows[1])]
        first, sums, last = contracted(rows[1], rows[2], rows[3:].T)
        columns = [rows[1], first, rows[2], *sums.T, *rows[3:], last]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=[x.split()[0] for x in ARC.split(", ")])

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "id", "next", *SUMS)])
        cuts = [0, *(1 + np.flatnonzero(rows[0, 1:] != rows[0, :-1])).tolist(), rows.shape[1]]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                if kept and kept[-1][0, -1] != rows[0, a]:
                    yield close(kept)
                    kept = []
                kept.append(rows[:, a:b])
    if kept:
        yield close(kept)


def in_blocks(elements: DataFrame) -> DataFrame:
    """Rows as ``ARC`` says, of rows (block, id, next, places, leaves, saved)."""
    return elements.select("block", "id", "next", *SUMS).repartition("block").sortWithinPartitions("block").mapInArrow(by_block, ARC)


def ranked(elements: DataFrame, one: int = ONE) -> DataFrame:
    """(id, places, leaves, saved): the sums over all that come before an element of the list (id, next, places, leaves, saved)."""
    undone = []
    while (n := elements.count()) > one:
        coin = F.xxhash64("id", F.lit(len(undone))).bitwiseAND(F.lit(1))
        sides = elements.withColumn("coin", coin)
        taken = sides.where("coin = 0").select(F.col("id").alias("next"), F.col("next").alias("then"), *(F.col(x).alias(f"more_{x}") for x in SUMS))
        met = saved(sides.where("coin = 1").join(taken, "next", "left"))
        gone = met.where("then is not null").select(F.col("next").alias("id"), F.col("id").alias("before"), *SUMS)
        undone.append(gone)
        grown = met.select("id", F.coalesce("then", "next").alias("next"), *((F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in SUMS))
        elements = saved(grown.unionByName(sides.where("coin = 0").drop("coin").join(gone.select("id"), "id", "left_anti").select("id", "next", *SUMS)))
    rows = in_blocks(elements.withColumn("block", F.lit(0).cast("long")))
    places = saved(rows.select("id", *((F.col(x) - F.col(f"own_{x}")).alias(x) for x in SUMS)))
    for gone in reversed(undone):
        base = places.select(F.col("id").alias("before"), *(F.col(x).alias(f"base_{x}") for x in SUMS))
        places = saved(places.unionByName(gone.join(base, "before").select("id", *((F.col(x) + F.col(f"base_{x}")).alias(x) for x in SUMS))))
    return places


def arc_sums(arcs: DataFrame, one: int = ONE) -> DataFrame:
    """(id, places, leaves, saved): each arc's place in the tour, from 1, and the sums up to and with it."""
    local = saved(in_blocks(arcs.withColumn("places", F.lit(1).cast("long")).withColumn("block", F.shiftright("id", 34))))
    runs = local.where("last").select(F.col("head").alias("id"), "next", *SUMS)
    base = ranked(saved(runs), one).select(F.col("id").alias("head"), *(F.col(x).alias(f"base_{x}") for x in SUMS))
    return local.join(base, "head").select("id", *((F.col(x) + F.col(f"base_{x}")).alias(x) for x in SUMS))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, first, ids) of rows (v, conv_id) in order: at most IDS ids in one text."""
    for batch in batches:
        v, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("v", "conv_id"))
        cuts = [0, *(1 + np.flatnonzero(v[1:] != v[:-1])).tolist(), len(v)]
        rows = [(int(v[x]), int(ids[x]), ",".join(map(str, ids[x : min(x + IDS, b)].tolist()))) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in range(a, b, IDS)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["v", "first", "ids"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, ends_sha256) of chunks in order; nothing but the running digest is kept."""
    last, running = None, None
    for batch in batches:
        done = []
        for v, ids in zip(batch.column("v").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if v == last:
                running.update(f",{ids}".encode())
                continue
            if running:
                done.append((last, running.hexdigest()))
            last, running = v, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["v", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([running.hexdigest()])], names=["v", "ends_sha256"])


def ends(tree: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(v, ends_sha256) for the nodes at which conversations end."""
    last = found.join(lengths.withColumnRenamed("turns", "depth"), ["conv_id", "depth"]).select("conv_id", key("depth", "a", "b").alias("key"))
    zero = F.lit(0).cast("long")
    last = last.unionByName(lengths.where("turns = 0").select("conv_id", F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b")).alias("key")))
    rows = joined(last, tree.select("key", "v", F.col("n_convs").alias("n")), "key", lengths.count()).select("v", "conv_id")
    cut = rows.repartitionByRange("v", "conv_id").sortWithinPartitions("v", "conv_id").mapInArrow(chunks, "v long, first long, ids string")
    return cut.repartition("v").sortWithinPartitions("v", "first").mapInArrow(digests, "v long, ends_sha256 string")


def trie(conversations: DataFrame, one: int = ONE) -> DataFrame:
    """One row per node of the rebuilt conversations' trie, with its subtree's sums, the digest of its ends and its arcs' places in the tour."""
    parts, lengths = rebuilt(conversations)
    lengths = saved(lengths)
    found = saved(members(parts))
    tree = nodes(found, lengths)
    sums = saved(arc_sums(tour(tree), one))
    side = F.col("id") % 2
    pairs = sums.groupBy(F.shiftright("id", 1).alias("v")).agg(*(F.max(F.when(side == 0, F.col(x))).alias(f"in_{x}") for x in SUMS), *(F.max(F.when(side == 1, F.col(x))).alias(f"out_{x}") for x in SUMS))
    rows = tree.join(pairs, "v").join(ends(tree, found, lengths), "v", "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("out_leaves") - F.col("in_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("out_saved") - F.col("in_saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), F.col("in_places").alias("enter"), F.col("out_places").alias("leave"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("enter", "leave")


#: The contract in DuckDB SQL. A node's ancestors are the nodes of its smallest member at lesser depths.
SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
  FROM conversations WHERE conv_id IS NOT NULL
), counts AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
      lambda crc, code: list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))), CAST(4294967295 AS BIGINT)) % 9 AS head
  FROM turns GROUP BY conv_id
), plans AS (
  SELECT c.conv_id, c.base, c.head, least(c.head, coalesce(b.n, 0)) AS lent FROM counts c LEFT JOIN counts b ON b.conv_id = c.base
), rebuilt AS (
  SELECT p.conv_id, t.at AS depth, role, text FROM plans p JOIN turns t ON t.conv_id = p.base AND t.at <= p.head
  UNION ALL SELECT p.conv_id, p.lent + t.at - p.head, role, text FROM plans p JOIN turns t ON t.conv_id = p.conv_id AND t.at > p.head
), members AS (
  SELECT conv_id, depth, md5(string_agg(md5(role || chr(31) || text), ',') OVER w) AS k, strlen(text) AS bytes, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM plans
), keyed AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM members
), nodes AS (
  SELECT k, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM keyed GROUP BY k
), families AS (
  SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), trees AS (
  SELECT m.k, sum(CASE WHEN f.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(v.own) AS saved_tokens
  FROM nodes v LEFT JOIN families f ON f.k = v.k JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.k
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(f.n_children, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN trees t ON t.k = v.k LEFT JOIN families f ON f.k = v.k LEFT JOIN nodes p ON p.k = v.up
"""
