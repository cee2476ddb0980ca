"""Language identification with hyperdimensional profiles.

Every letter, case folded, has a random vector of +1 and -1 of its own, drawn from a hash of its code point. A letter trigram's vector binds (multiplies) its three letters' vectors, each permuted (rotated)
by its place; a text's vector bundles (adds) those of its trigrams, and a language's prototype bundles those of all its learning texts. A
text gets the language whose prototype, less the mean of all prototypes, has the largest cosine with the text's vector, less the same mean.

Since bundling is a sum, a text's vector is its trigram counts times the trigrams' vectors: counts are integers per batch, and one matrix
product gives a batch of texts. Learning reads all learning texts once and shuffles only sums of vectors; they pass through the driver in order of
language, one partition at a time, and go out in broadcasts of ``LANGUAGES`` prototypes each, which a text meets one after another, so that neither the
driver nor a task holds more than one at a time, however many languages there are. Texts are read whole, in pieces of about ``CHARS`` code points,
cut where no letter stands; a run of letters longer than a piece is cut within, which splits the one trigram over each cut.

Defined cases: a null text, or one without letters, is ``und`` with score 0; learning skips null ``lang``; without learning rows every
language is ``und``; of languages that fit a text equally the first in order is taken; repeated rows give repeated rows; a null ``doc_id`` is treated as held out; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, saved, slices

UNKNOWN = "und"
DIMENSIONS = 1024
#: Bits of a letter's code point; three letters are one number.
BITS = 21
#: Trigrams whose vectors are made at once.
VECTORS = 4096
#: Cells of a table of counts for each trigram in it, at most; beyond, the trigrams' vectors are added one by one.
SPARSE = 16
#: Learning rows: those whose crc32 of the id's text mod FOLDS isn't HELD. Fixed by the contract.
FOLDS, HELD = 3, 1
#: Code points that are counted at once, about.
CHARS = 1 << 19
#: Languages in one broadcast, 8 kB each.
LANGUAGES = 2048


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The letter of each code point, case folded; 0 for what isn't a letter and stands between words."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


@lru_cache(maxsize=1 << 14)
def letter_vector(letter: int) -> np.ndarray:
    bits = np.frombuffer(hashlib.shake_128(b"%d" % letter).digest(DIMENSIONS // 8), np.uint8)
    return np.unpackbits(bits).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Products of the letters' vectors, each rotated by its place."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for k in range(3):
        own, which = np.unique(codes >> BITS * (2 - k) & (1 << BITS) - 1, return_inverse=True)
        out *= np.roll(np.stack([letter_vector(x) for x in own.tolist()]), k, axis=1)[which] if len(own) else out
    return out.astype(np.float32)


def batch_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of the texts, the number among them and the text of each place, and which texts have letters. Runs of other characters count as one; trigrams hold a letter in the middle."""
    ends = np.cumsum([len(x) + 1 for x in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = letters()[points]
    keep = (own > 0) | np.r_[True, own[:-1] > 0]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[keep]
    own = np.r_[0, own[keep], 0]
    middle = own[1:-1] > 0
    # letters by their number in the batch, so that few letters need no sorting
    has = np.zeros(0x110000, bool)
    has[own] = True
    used = np.flatnonzero(has)
    number = np.zeros(0x110000, np.int64)
    number[used] = np.arange(len(used))
    place, n = number[own], len(used)
    local = ((place[:-2] * n + place[1:-1]) * n + place[2:])[middle]
    if n**3 <= 1 << 21:
        distinct = np.flatnonzero(np.bincount(local, minlength=n**3))
        rank = np.zeros(n**3, np.int64)
        rank[distinct] = np.arange(len(distinct))
        which = rank[local]
    else:
        distinct, which = np.unique(local, return_inverse=True)
    codes = (used[distinct // n**2] << 2 * BITS) | (used[distinct // n % n] << BITS) | used[distinct % n]
    return codes, which, owner[middle], np.bincount(owner, own[1:-1] > 0, len(texts)) > 0


def bundled(codes: np.ndarray, which: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners the sum of its trigrams' vectors; whole numbers, exact up to 2^24 trigrams of an owner."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    if len(codes) > VECTORS:
        order = np.argsort(which, kind="stable")
        which, owner = which[order], owner[order]
    for at in range(0, len(codes), VECTORS):
        a, b = np.searchsorted(which, (at, at + VECTORS)) if len(codes) > VECTORS else (0, len(which))
        width = min(VECTORS, len(codes) - at)
        vectors, pair = trigram_vectors(codes[at : at + width]), owner[a:b] * width + which[a:b] - at
        if n * width <= SPARSE * len(pair):
            out += np.bincount(pair, minlength=n * width).reshape(n, width).astype(np.float32) @ vectors
            continue
        pair.sort()  # scripts of many letters: few places for so many trigrams
        for k in range(0, len(pair), VECTORS):
            of, one = np.divmod(pair[k : k + VECTORS], width)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[first]] += np.add.reduceat(vectors[one], first, axis=0)
    return out


def composed(texts: list[str | None]) -> list[str]:
    return [x if x.isascii() else unicodedata.normalize("NFC", x) for x in (y or "" for y in texts)]


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of CHARS code points or fewer that end at the last character of theirs that isn't a letter."""
    at = 0
    while len(text) - at > CHARS:
        to = at + CHARS
        while to > at and text[to - 1].isalpha():
            to -= 1
        to = to if to > at else at + CHARS
        yield text[at:to]
        at = to
    yield text[at:]


def groups(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number of a text, piece of it), in groups of about CHARS code points together."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, x in enumerate(texts):
        for piece in pieces(x):
            if group and (size + len(piece) > CHARS or len(group) >= 1000):
                yield group
                group, size = [], 0
            group.append((i, piece))
            size += len(piece)
    if group:
        yield group


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Profiles:
    """Languages in order and their prototypes, in parts: lists of languages with their prototypes, or broadcasts of such."""

    def __init__(self, langs: list[str], sums: np.ndarray):
        self.several = len(langs) > 1
        sums = sums / np.maximum(1, np.linalg.norm(sums, axis=1, keepdims=True))
        self.mean = sums.mean(axis=0) if langs else np.zeros(DIMENSIONS)
        self.parts: list = [(langs, unit(sums - self.mean if self.several else sums))] if langs else []

    @classmethod
    def of(cls, frame: DataFrame) -> Profiles:
        """From rows (lang, sums) in order of language."""
        spark, own = frame.sparkSession, cls([], np.zeros((0, DIMENSIONS)))

        def parts() -> Iterator[tuple[list[str], np.ndarray]]:
            langs, sums = [], []
            for row in frame.toLocalIterator():
                langs.append(row.lang)
                sums.append(np.array(row.sums, np.float64))
                if len(langs) == LANGUAGES:
                    yield langs, np.stack(sums)
                    langs, sums = [], []
            if langs:
                yield langs, np.stack(sums)

        n, total = 0, np.zeros(DIMENSIONS)
        for langs, sums in parts():
            n, total = n + len(langs), total + (sums / np.maximum(1, np.linalg.norm(sums, axis=1, keepdims=True))).sum(axis=0)
        own.several, own.mean = n > 1, total / max(1, n)
        for langs, sums in parts():
            sums /= np.maximum(1, np.linalg.norm(sums, axis=1, keepdims=True))
            own.parts.append(spark.sparkContext.broadcast((langs, unit(sums - own.mean if own.several else sums))))
        return own

    @property
    def prototypes(self) -> np.ndarray:
        return np.concatenate([(part if isinstance(part, tuple) else part.value)[1] for part in self.parts])

    def nearest(self, vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Of each text's sum of trigram vectors the language with the largest cosine, the first in order of equals, and the cosine."""
        vectors = unit(vectors)
        if self.several:
            vectors = unit(vectors - self.mean)
        langs, best = [UNKNOWN] * len(vectors), np.full(len(vectors), -np.inf)
        for part in self.parts:
            names, prototypes = part if isinstance(part, tuple) else part.value
            cos = vectors @ prototypes.T
            at = cos.argmax(axis=1)
            top = cos[np.arange(len(at)), at]
            for k in np.flatnonzero(top > best).tolist():
                langs[k] = names[at[k]]
            best = np.maximum(best, top)
            if len(self.parts) > 1 and not isinstance(part, tuple):
                part.__dict__.pop("_value", None)  # read again for the next texts: one part at a time is held
        return langs, best

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.parts:
            return langs, scores
        open_, before = -1, np.zeros(DIMENSIONS)  # a text that goes on in the next group, and what its pieces have so far
        for group in groups(composed(texts)):
            numbers, own = np.unique([i for i, _ in group], return_inverse=True)
            codes, which, owner, _ = batch_codes([x for _, x in group])
            vectors = bundled(codes, which, own[owner], len(numbers)).astype(np.float64)
            if numbers[0] == open_:
                vectors[0] += before
            open_, before = int(numbers[-1]), vectors[-1].copy()
            names, cos = self.nearest(vectors)
            top = np.clip((1 + cos) / 2, 0, 1)
            for i, name, score, lettered in zip(numbers.tolist(), names, top.tolist(), vectors.any(axis=1).tolist(), strict=True):
                if lettered:
                    langs[i], scores[i] = name, score
        return langs, scores


def learning_sums(learn: DataFrame) -> DataFrame:
    """(lang, k, n): number k of the sum of the learning texts' vectors, summed within each task before they are shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (x for whole in batches for x in slices(iter([whole]))):
            texts, langs = composed(batch.column("text").to_pylist()), batch.column("lang").to_pylist()
            for group in groups(texts):
                own_langs = [langs[i] for i, _ in group]
                names = sorted(set(own_langs))
                codes, which, owner, _ = batch_codes([x for _, x in group])
                of = np.array([names.index(x) for x in own_langs])[owner]
                for name, own in zip(names, bundled(codes, which, of, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + own.astype(np.int64)
            if len(sums) > 64:  # many languages: hand the sums on
                yield from out(sums)
                sums = {}
        yield from out(sums)

    def out(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS)), pa.array(n)], names=["lang", "k", "n"])

    return learn.select("text", "lang").mapInArrow(add, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Profiles:
    """Prototypes from every row of docs with a language."""
    sums = learning_sums(docs.where("lang is not null"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias("sums"))
    return Profiles.of(saved(whole.orderBy("lang")))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = profiles.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), of_batch, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return identify(docs, learn(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
