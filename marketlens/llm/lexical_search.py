"""Ranked lexical search: every document is scored for each item, with MaxScore bounds made tighter by pairs of terms.

Documents are indexed in shards, the texts of a batch: posting lists (document, occurrences) of the items' terms, and each document's length. The index
is written once to the shared folder; corpus counts (documents, lengths, a term's documents) are summed from it. A shard then gets its impacts, and for pairs of an
item's terms the intersection of their lists with its joint maximum impact: a pair adds at most the largest of that and of each term's own
maximum, which is less than both terms' maxima together. An item's pairs are taken in order of their bounds: the first ones, whose bounds
together stay below the item's twentieth best score so far, can't bring a document in by themselves. The others' lists give the candidates; the rest
is added pair by pair, best bound first, for candidates that the pairs still to come could lift to that score. A task carries the scores of its shards
on to the next. Nothing is left out but by bounds, so the result is exact; equal scores at the end of the list are kept until ids decide.

Items are a stated query set: they go to all tasks, in blocks of about ``ITEM_BYTES`` of text with a pass over the documents for each. What a task returns
is at most ``TOP`` rows an item, and they are cut in two steps.

Defined cases: null texts have no terms, on either side; an item or a document without a term is in no row; rows with equal or null ``doc_id`` are ranked each,
null last of equal scores; repeated items are ranked each; very long texts are counted whole, one at a time; empty tables give an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_text, mapped, raw, saved, table

#: Fixed by the contract.
TOP = 20
#: Text of the items that go to all tasks at once, about.
ITEM_BYTES = 16 << 20
#: Groups in which the tasks' rows are cut before an item's meet.
SALTS = 64
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "doc_ids array<long>, lengths binary, terms binary, ends binary, docs binary, counts binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def shard(batch: pa.RecordBatch, number: dict[bytes, int]) -> pa.RecordBatch | None:
    """The index of one batch's documents that have a term: posting lists in order of term and document."""
    ids, lengths, terms, docs, counts = [], [], [], [], []
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
        found = words(text)
        if not found:
            continue
        of = Counter(found)
        known = of.keys() & number.keys()
        terms += [number[x] for x in known]
        counts += [of[x] for x in known]
        docs += [len(ids)] * len(known)
        ids.append(doc_id)
        lengths.append(len(found))
    if not ids:
        return None
    term, doc, n = np.array(terms, np.int32), np.array(docs, np.int32), np.array(counts, np.int64)
    order = np.lexsort((doc, term))
    own, sizes = np.unique(term, return_counts=True)
    columns = [np.array(lengths, np.int64), own, np.cumsum(sizes), doc[order], n[order]]
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[x.split()[0] for x in INDEX.split(", ")])


class Shard:
    """A row of the index, as arrays."""

    def __init__(self, row: dict) -> None:
        self.ids = np.array([np.iinfo(np.int64).max if x is None else x for x in row["doc_ids"]], np.int64)
        self.no_id = np.array([x is None for x in row["doc_ids"]])
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.int32)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.docs, self.counts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int64)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Shard(batch.slice(k, 1).to_pylist()[0])


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): a task's documents for each term; under -1 all its documents, under -2 their length."""
    sums: Counter[int] = Counter()
    for x in shards(batches):
        sums.update(dict(zip(x.terms.tolist(), np.diff(x.ends, prepend=0).tolist(), strict=True)))
        sums[-1] += len(x.ids)
        sums[-2] += int(x.lengths.sum())
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([*sums.values()], pa.int64())], names=["term", "n"])


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


#: An item's terms (term, weight times repeats) in pairs; the last one may stand alone.
Pairs = list[tuple[tuple[int, int], ...]]


def paired(terms: Counter, weights: dict[int, int]) -> Pairs:
    """Terms of like weight together, so that the light ones, which many documents have, bound each other."""
    line = sorted(((t, n * weights[t]) for t, n in terms.items() if weights.get(t)), key=lambda x: (x[1], x[0]))
    return [tuple(line[k : k + 2]) for k in range(0, len(line), 2)]


class Lists:
    """A shard's posting lists with impacts, and its pairs' joint maxima, each made once."""

    def __init__(self, x: Shard, n_docs: int, n_terms: int) -> None:
        impact = impacts(x.counts, x.lengths[x.docs], n_docs, n_terms)
        at = [0, *x.ends.tolist()]
        self.of = {t: (x.docs[a:b], impact[a:b]) for t, a, b in zip(x.terms.tolist(), at[:-1], at[1:], strict=True)}
        self.most = {t: int(i.max()) for t, (_, i) in self.of.items()}
        self.joint: dict[tuple, int] = {}
        self.dense = np.zeros(len(x.ids), np.int64)

    def bound(self, pair: tuple[tuple[int, int], ...]) -> int:
        """The most that the pair's terms can add to a document."""
        here = [(t, w) for t, w in pair if t in self.of]
        own = max((w * self.most[t] for t, w in here), default=0)
        if len(here) < 2:
            return own
        if pair not in self.joint:
            ((a, wa), (b, wb)) = here
            (docs_a, of_a), (docs_b, of_b) = self.of[a], self.of[b]
            self.dense[docs_a] = of_a
            other = self.dense[docs_b]
            self.dense[docs_a] = 0
            both = other > 0
            self.joint[pair] = int((wa * other[both] + wb * of_b[both]).max()) if both.any() else 0
        return max(own, self.joint[pair])


def scores(lists: Lists, pairs: Pairs, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all documents of the shard whose score is above 0 and at least ``least``."""
    bounds = sorted(((b, p) for p in pairs if (b := lists.bound(p)) > 0), key=lambda x: x[0])
    none = np.empty(0, np.int64)
    upto = np.cumsum([0, *(b for b, _ in bounds)])
    if not bounds or upto[-1] < least:
        return none, none
    first = int(np.searchsorted(upto, least, side="left")) - 1 if least > 0 else 0  # the pairs before it stay below least together
    first = max(first, 0)
    dense = np.zeros(len(lists.dense), np.int64)
    for _, pair in bounds[first:]:
        for t, w in pair:
            if t in lists.of:
                docs, impact = lists.of[t]
                dense[docs] += w * impact
    docs = np.flatnonzero(dense)
    total = dense[docs]
    for k in range(first - 1, -1, -1):
        can = total + upto[k + 1] >= least
        docs, total = docs[can], total[can]
        if not len(docs):
            return none, none
        for t, w in bounds[k][1]:
            if t in lists.of:
                of, impact = lists.of[t]
                at = np.minimum(np.searchsorted(of, docs), len(of) - 1)
                total = total + np.where(of[at] == docs, w * impact[at], 0)
    good = (total >= least) & (total > 0)
    return docs[good], total[good]


def searcher(items: list[Pairs], n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in items]
        for x in shards(batches):
            lists = Lists(x, n_docs, n_terms)
            for k, pairs in enumerate(items):
                ids, own, no_id = best[k]
                docs, found = scores(lists, pairs, int(own[TOP - 1]) if len(own) >= TOP else 0)
                if len(docs):
                    ids, own, no_id = np.r_[ids, x.ids[docs]], np.r_[own, found], np.r_[no_id, x.no_id[docs]]
                    order = np.lexsort((ids, no_id, -own))[:TOP]
                    best[k] = ids[order], own[order], no_id[order]
        for k, (ids, own, no_id) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, np.int32)), pa.array(ids, mask=no_id), pa.array(own)], names=["item", "doc_id", "score"])

    return search


def block(docs: DataFrame, items: list[tuple[int | None, bytes]], top: int = TOP) -> DataFrame:
    """(item, doc_id, score, rank) of one block of items; ``item`` is the place in the list."""
    of_item = [Counter(words(text)) for _, text in items]
    number = {x: k for k, x in enumerate(dict.fromkeys(x for own in of_item for x in own))}
    index = saved(mapped(docs, lambda batch: shard(batch, number), INDEX))
    sums = {r.term: r.n for r in index.mapInArrow(totals, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_terms = sums.pop(-1, 0), sums.pop(-2, 0)
    weights = {t: weight(n_docs, df) for t, df in sums.items()}
    pairs = [paired(Counter({number[x]: n for x, n in own.items()}), weights) for own in of_item]
    found = index.mapInArrow(searcher(pairs, n_docs, n_terms), "item int, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def search(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, best first."""
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = (texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // item_bytes + 1
    found = []
    for k in range(blocks):
        own = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = [(r.item_id, r.text.encode()) for r in own.collect()]
        names = spark.createDataFrame([(k, x[0]) for k, x in enumerate(rows)], "item int, item_id long")
        found.append(block(id_text(docs), rows).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: The contract in DuckDB SQL.
SQL = """
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), postings AS (
  SELECT term, doc_id, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY term, doc_id
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS repeats FROM item_terms GROUP BY item_id, term) JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
