"""Licence scans: ordered signature rules over normalised words.

Hundreds of hand-written patterns (``license_rules``) each wait behind a keyword; what they find is settled by priority, and a detection
that lies within one already kept goes. Everything is a map over documents: no shuffle, memory bounded by a batch of about 8 MB of text. Work
grows with a text's length times the logarithm of its detections: places are looked up among the text's spaces, spans in a tree of largest ends.

Defined cases: a null or empty text has no words and no labels (empty strings, null positions); of detections of one priority the longer goes first, then the
earlier, then the label; repeated rows give repeated rows; a null ``doc_id`` stays null; a very long text is scanned whole by one task; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import license_rules
from .common import documents, id_text, mapped, raw

#: Fixed values of the contract: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Lower case for A-Z; what is neither a letter, a digit nor part of a non-ASCII character becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, spans string"


@lru_cache(maxsize=1)
def compiled() -> list[tuple[str, int, float, tuple[bytes, ...], re.Pattern[bytes]]]:
    return [(label, priority, sure, tuple(x.encode() for x in keywords), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")) for label, priority, sure, keywords, pattern in license_rules.table()]


def normal(text: bytes) -> tuple[bytes, int]:
    """The words, lower-cased, each between single spaces; how many."""
    words = text.translate(FOLD).split()
    return b" " + b" ".join(words) + b" ", len(words)


def spaces(text: bytes) -> np.ndarray:
    """Places of the spaces of normalised text: number k stands before word k."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 32)


def base_places(text: bytes) -> list[tuple[int, str]]:
    """Word index and label of every place of a base phrase, overlapping ones too, in order."""
    found = []
    for phrase, label in BASE.items():
        sought, at = b" " + phrase.encode() + b" ", -1
        while (at := text.find(sought, at + 1)) >= 0:
            found.append((at, label))
    words = np.searchsorted(spaces(text), [at for at, _ in found]).tolist() if found else []
    return sorted((word, label) for word, (_, label) in zip(words, found, strict=True))


Detection = tuple[int, int, int, str, float]


def settled(found: list[Detection]) -> list[Detection]:
    """Detections (start, end, priority, label, confidence) by priority, longer first; one within the span of a kept detection of no lower priority goes."""
    starts = {x: k + 1 for k, x in enumerate(sorted({x[0] for x in found}))}
    reach = [-1] * (len(starts) + 1)  # node k: the largest end kept among starts k - (k & -k) + 1 to k
    kept: list[Detection] = []
    for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        k, furthest = starts[x[0]], -1
        while k:
            furthest = max(furthest, reach[k])
            k &= k - 1
        if furthest >= x[1]:
            continue
        kept.append(x)
        k = starts[x[0]]
        while k < len(reach):
            reach[k] = max(reach[k], x[1])
            k += k & -k
    return sorted(kept)


def without_refined(found: list[Detection]) -> list[Detection]:
    """A form that a later clause turns into a stricter one goes, if that clause stands before the form begins again."""
    for form, clause in license_rules.REFINED.items():
        begins, ends = (np.array(sorted(x[0] for x in found if x[2:4] == (license_rules.KINDS["text"][0], label))) for label in (form, clause))
        if len(begins) and len(ends):
            upto = np.r_[begins[1:], max(begins[-1], ends[-1]) + 1]
            gone = set(begins[np.searchsorted(ends, begins, "right") < np.searchsorted(ends, upto)].tolist())
            found = [x for x in found if x[0] not in gone or x[2:4] != (license_rules.KINDS["text"][0], form)]
    return found


def detections(text: bytes) -> list[Detection]:
    """Of normalised text: what the rules find, after suppression; positions count words."""
    if not any(a.encode() in text for a in license_rules.ANCHORS):
        return []
    has: dict[tuple[bytes, ...], bool] = {}
    found = []
    for label, priority, sure, keywords, pattern in compiled():
        if keywords not in has:
            has[keywords] = any(x in text for x in keywords)
        if has[keywords]:
            found += [(m.start(), m[0].count(b" ") + 1, priority, label, sure) for m in pattern.finditer(text)]
    words = (np.searchsorted(spaces(text), [x[0] for x in found]) - 1).tolist() if found else []
    return settled(without_refined([(word, word + x[1], *x[2:]) for word, x in zip(words, found, strict=True)]))


def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(9)]
    for text in raw(batch):
        words, n = normal(text)
        base = base_places(words)
        found = detections(words)
        labels = {x for _, x in base}
        missed = 1.0
        for sure in {x[3]: x[4] for x in found}.values():
            missed *= 1 - sure
        score = 1 - missed if found else 0.7 if base else 0.0
        row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x[3] for x in found})), score, len(found), ",".join(f"{x[3]}:{x[0]}:{x[1]}" for x in found))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string())
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[1:])]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base places, labels after suppression, a confidence, and the detections as ``label:first_word:end_word``."""
    return mapped(id_text(docs), scan_batch, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections", "spans")
