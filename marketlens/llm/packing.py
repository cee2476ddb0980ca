"""Packing: best-fit decreasing over blocks of documents' token pieces.

A document's ids are cut into full windows and one rest. The pieces are dealt by a hash of their number into blocks of about ``BLOCK`` pieces, and each block
is packed by itself: pieces in falling length go to the tightest open window, found by a segment tree indexed by remaining capacity.
The number of blocks follows the number of pieces, so a task's work and memory stay the same at any size; a block wastes about one window.

Ids come from the public tokenizer. A word always has the same ids there, since it drops white space and never joins across it, so a
worker keeps the ids of words it has seen (at most ``MEMO``). Texts with characters whose folding or splitting would need the tokenizer's
own rules, or with its special tokens, go through it whole. Texts are read whole.

Defined cases: a null or empty text is one piece holding the closing id; repeated rows are packed once each, wherever they are dealt; pieces of one
length are packed in order of doc_id, start and checksum; a null ``doc_id`` stays null; a very long text is tokenised whole by one task; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, id_text, mapped, saved

WINDOW = 2048
#: Fixed by the contract: the tokenizer and the id that closes a document.
TOKENIZER, CLOSING = "word_bpe_49k.json", 1
#: Pieces that are packed together.
BLOCK = 4096
#: Words whose ids a worker keeps.
MEMO = 300_000

#: What the fast way leaves to the tokenizer: characters outside ASCII and the Latin-1 letters, the separators U+001C to U+001F, special tokens.
OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ÿ]|<\\|(?:start|end)oftext\\|>")
#: How the tokenizer splits those characters in lower case: kinds of bytes, and the contractions of its pattern (fixed values).
SPACE, DIGIT, LETTER, SIGN = range(4)
KIND = np.array([SPACE if c in b" \t\n\x0b\x0c\r" else DIGIT if 48 <= c <= 57 else LETTER if 97 <= c <= 122 or c >= 128 else SIGN for c in range(256)], np.uint8)
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def segments(data: np.ndarray) -> np.ndarray:
    """Where the words, and the runs of white space between them, begin in lower-case UTF-8 that OTHER finds nothing in.

    Runs of letters, single digits and runs of other signs, but a contraction that begins at an apostrophe after none of these signs is a word.
    """
    kind = KIND[data]
    begins = np.r_[True, kind[1:] != kind[:-1]] | (kind == DIGIT)
    for at in np.flatnonzero(data == ord("'")).tolist():
        if begins[at]:
            for tail in CONTRACTIONS:
                if data[at + 1 : at + 1 + len(tail)].tobytes() == tail:
                    begins[at + 1] = False
                    begins[at + 1 + len(tail) : at + 2 + len(tail)] = True
                    break
    return np.flatnonzero(begins)


class WordIds:
    """Ids of texts, with those of words kept."""

    def __init__(self, path: str):
        self.of = tokenizer(path)
        self.ends = np.zeros(self.of.get_vocab_size(), bool)
        self.ends[[k for x, k in self.of.get_vocab().items() if x.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.of.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one text that holds them all: every word ends in an id of its own kind."""
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            ids = self.encode(" ".join(words[at : at + 20_000]))
            cuts, data = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        if len(self.kept) > MEMO:
            self.kept.clear()
        missing = [x for x in words if x not in self.kept]
        blank = [x for x in missing if x.isspace()]
        missing = [x for x in missing if not x.isspace()]
        self.kept.update(zip(missing, self.encode_words(missing), strict=True))
        self.kept.update((x, b"") for x in blank)
        return list(map(self.kept.__getitem__, words))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        usual = [k for k, x in enumerate(texts) if not OTHER.search(x)]
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k in set(range(len(texts))) - set(usual):
            out[k] = self.encode(texts[k])
        parts = [texts[k].lower().encode() for k in usual]
        if not any(parts):
            return out
        data = b"\n".join([*parts, b""])
        begins = segments(np.frombuffer(data, np.uint8))
        found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, len(data)].astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        own = self.words(found.dictionary.to_pylist())
        which = found.indices.to_numpy()
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, starts = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.r_[0, np.cumsum(n)]
        ids = flat[np.arange(upto[-1]) + np.repeat(starts[which] - upto[:-1], n)]
        # a text ends before its line end, which may stand within a run of white space
        ends = upto[np.searchsorted(begins, np.cumsum([len(x) + 1 for x in parts]) - 1, side="right") - 1]
        for k, a, b in zip(usual, [0, *ends.tolist()], ends.tolist(), strict=False):
            out[k] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids cut into full windows and a rest."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        doc_ids = batch.column("doc_id").to_pylist()
        for doc, ids in zip(doc_ids, word_ids(path).texts(batch.column("text").to_pylist()), strict=True):
            ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
            for at in range(0, len(ids), window):
                part = ids[at : at + window]
                rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.astype(np.int32),) if with_ids else ()))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return mapped(id_text(docs), of_batch, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids, most=4 << 20)


class OpenWindows:
    """Windows by remaining capacity: a segment tree of counts over capacities 0 to ``window``."""

    def __init__(self, window: int):
        self.side = 1 << window.bit_length()
        self.count = [0] * (2 * self.side)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.at[room].append(which)
        node = room + self.side
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` that an open window has, or -1."""
        node, count = least + self.side, self.count
        while not count[node]:
            while node & 1:  # up to where a right sibling exists
                node >>= 1
            if not node:
                return -1
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of a level
                return -1
        while node < self.side:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.side

    def take(self, room: int) -> int:
        node = room + self.side
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.at[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of each piece; lengths in falling order, none above ``window``."""
    open_, placed, made = OpenWindows(window), [], 0
    for n in lengths:
        if (room := open_.tightest(n)) < 0:
            room, which, made = window, made, made + 1
        else:
            which = open_.take(room)
        placed.append((which, window - room))
        if room > n:
            open_.put(room - n, which)
    return placed


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset there; ``with_ids`` adds the ids themselves. The tokenizer's file must stand under ``path`` on every machine."""
    cut = saved(pieces(docs, path or public_tokenizers.path(TOKENIZER), window, with_ids))
    blocks = max(1, -(-cut.count() // BLOCK))
    # by the row's number, so that pieces alike in every column are dealt to all blocks; the numbers hold, as the pieces are saved
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    keep = [c for c in cut.columns]
    kinds = ", ".join(f"{name} {kind}" for name, kind in cut.dtypes)

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]))
        placed = np.array(best_fit(rows.column("length").to_pylist(), window), np.int64).reshape(-1, 2)
        return rows.select(keep).append_column("sequence_id", pa.array((rows.column("block").to_numpy() << 32) | placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    return dealt.groupBy("block").applyInArrow(of_block, f"{kinds}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
