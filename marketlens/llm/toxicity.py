"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents labelled toxic; every other text is unlabelled, some of it toxic. A linear classifier over the presence of words and
word beginnings is trained with the risk pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), where pi is the share of toxic
documents among the labelled ones. Training takes at most ``POSITIVES`` and ``UNLABELLED`` documents, chosen by hash of the id (the bound
of the fit, parameters of ``learn``; the class prior and the scores cover all rows), outside the held-out fold. Features are counted on executors; the driver gets two
numbers for each of at most ``SPACE`` features, and of each chosen document those of the at most ``FEATURES`` kept ones that it has. Scoring is a map
over documents.

Defined cases: a null or empty text scores as one without known words; without positives every score is the prior; a doc with labels 0 and 1
counts as toxic; of rows with one id the least text is learned from, and repeated rows give repeated rows; ties in the choice go to the smaller id, those among features
to the smaller number; a null ``doc_id`` counts as held out; very long texts are read whole; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, mapped, saved, table

#: Held-out rows: crc32 of the id's text mod FOLDS is 0. Fixed by the contract.
FOLDS = 5
POSITIVES, UNLABELLED = 3000, 6000
#: Hash space of features, and how many of them a model keeps.
SPACE, FEATURES = 1 << 20, 4096
#: What a feature needs: positives that have it, as a number and a share; standard errors between its shares; the part of those unlabelled documents with it that the prior lets be toxic.
LEAST_POSITIVES, LEAST_SHARE, LEAST_SURE, EXCLUSIVE = 5, 0.003, 2.0, 0.5
#: Lengths in bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: Words that a worker remembers.
MEMO = 150_000

#: Everything in ASCII but lower-case letters separates words.
FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(FOLD).split())


def word_features(word: bytes) -> list[int]:
    return [zlib.crc32(word) % SPACE, *(zlib.crc32(b"^" + word[:n]) % SPACE for n in BEGINNINGS if len(word) >= n)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Toxicity:
    """Hashed features kept by the model, their weights and the intercept."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(kept.tolist(), weights.tolist(), strict=True)), bias
        self.known: set[bytes] = set()
        self.telling: dict[bytes, frozenset[int]] = {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            words = words_of(text or "")
            if new := words - self.known:
                if len(self.known) > MEMO:
                    self.known, self.telling, new = set(), {}, words
                self.known |= new
                self.telling |= {w: own for w in new if (own := frozenset(f for f in word_features(w) if f in self.weights))}
            if found := [x for x in words if x in self.telling]:
                out[k] += sum(map(self.weights.__getitem__, sorted(frozenset().union(*map(self.telling.__getitem__, found)))))
        return sigmoid(out)


def telling(seen: list[np.ndarray], n_pos: int, n_un: int, prior: float) -> np.ndarray:
    """The features that a model keeps, in order; seen: of each feature how many positives and how many unlabelled documents have it."""
    in_pos, in_un = (seen[0] + 0.5) / (n_pos + 1), (seen[1] + 0.5) / (n_un + 1)
    # a feature must be clearly more common among positives, by its standard error, and in more than a few of them: copies share rare words by chance
    sure = (in_pos - in_un) / np.sqrt(in_pos / n_pos + in_un / n_un)
    gain = np.where((seen[0] >= max(LEAST_POSITIVES, LEAST_SHARE * n_pos)) & (sure >= LEAST_SURE) & (in_pos * prior >= EXCLUSIVE * in_un), sure, -np.inf)
    kept = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    return kept[gain[kept] > 0]


def constant(prior: float) -> Toxicity:
    return Toxicity(np.zeros(0, int), np.zeros(0), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))


def fit(rows: list[tuple[bool, np.ndarray]], kept: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Toxicity:
    """rows: (positive, distinct feature ids among ``kept``). A positive also stands among the unlabelled, as it would in a sample of all text."""
    n_pos, n_un = sum(p for p, _ in rows), sum(not p for p, _ in rows)
    place = np.full(SPACE, -1)
    place[kept] = np.arange(len(kept))
    positive = np.array([p for p, _ in rows])
    cols = [place[f][place[f] >= 0] for _, f in rows]
    col, row = np.concatenate(cols), np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    w = np.zeros(len(kept) + 1)  # the last is the intercept
    w[-1] = np.log((prior + 1e-6) / (1 - prior + 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(row, w[col], len(rows)) + w[-1])
        # sigmoid loss, bounded: p for calling a row clean, 1 - p for calling it toxic; either has this slope
        slope = p * (1 - p)
        down = np.where(positive, -prior * slope / n_pos, slope / n_un)
        negative = p[~positive].mean() - prior * p[positive].mean()
        slope = np.where(positive, -prior * slope / n_pos, 0) + down if negative >= 0 else -down
        g = np.r_[np.bincount(col, slope[row], len(kept)), slope.sum()] + decay * np.r_[w[:-1], 0]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Toxicity(kept, w[:-1], float(w[-1]))


def held_out(folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def features_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [np.array(sorted({f for w in words_of(x or "") for f in word_features(w)}), np.int32) for x in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "features"])


def lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of (toxic, features): toxic, and the row and number of each feature."""
    column = batch.column("features")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool), np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's numbers of positives and of unlabelled documents with each feature."""
    sums = np.zeros((2, SPACE), np.int64)
    for batch in batches:
        toxic, row, feature = lists(batch)
        for own, of in zip(sums, (toxic, ~toxic), strict=True):
            own += np.bincount(feature[of[row]], minlength=SPACE)
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["f", "pos", "un"])


def chosen(ids: DataFrame, salt: int, most: int) -> DataFrame:
    """At most so many of the distinct ids, those with the least hashes; where there are many more, a bound on the hash leaves about four times as many to order."""
    own = saved(ids.distinct())
    n, order = own.count(), F.xxhash64("doc_id", F.lit(salt))
    near = own.where(F.shiftrightunsigned(order.bitwiseXOR(F.lit(-1 << 63)), 1) <= int((1 << 63) * 4 * most / n)) if n > 8 * most else own
    return near.orderBy(order, "doc_id").limit(most)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Toxicity:
    """A model from labelled documents and unlabelled text outside the held-out fold; at most so many of either are learned from."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = own.agg(F.count(F.lit(1)), F.sum("toxic")).head()
    prior = min(0.9, max(1e-3, (toxic or 0) / n)) if n else 0.0
    known = chosen(own.where("toxic = 1").select("doc_id"), 1, positives).withColumn("toxic", F.lit(True))
    others = chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out()).where("doc_id is not null"), 2, unlabelled).withColumn("toxic", F.lit(False))
    # at most positives + unlabelled rows of two numbers: the broadcast is bounded by those parameters
    texts = id_text(docs).join(F.broadcast(known.unionByName(others)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = saved(mapped(texts.select("toxic", "text"), features_batch, "toxic boolean, features array<int>"))
    sizes = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return constant(prior)
    counts = found.mapInArrow(counted, "f long, pos long, un long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("un").alias("un")).toArrow()
    at, *numbers = (c.to_numpy() for c in counts.columns)
    seen = [np.zeros(SPACE, np.int64) for _ in range(2)]
    for of, own_numbers in zip(seen, numbers, strict=True):
        of[at] = own_numbers
    kept = telling(seen, sizes[True], sizes[False], prior)

    def restricted(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, row, feature = lists(batch)
        own = np.isin(feature, kept)
        ends = np.cumsum(np.bincount(row[own], minlength=len(toxic)))
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(feature[own].astype(np.int32)))], names=["toxic", "features"])

    few = found.mapInArrow(lambda batches: map(restricted, batches), "toxic boolean, features array<int>").toArrow()
    rows = list(zip(few.column("toxic").to_pylist(), (np.array(x, np.int64) for x in few.column("features").to_pylist()), strict=True))
    rows.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))  # sums don't depend on the order of arrival
    return fit(rows, kept, prior)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return mapped(id_text(docs), of_batch, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of docs, whole, that the model doesn't call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(docs, lambda batch: batch.filter(pa.array(shared.value.scores(batch.column("text").to_pylist()) < 0.5)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
