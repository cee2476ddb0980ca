"""The ten queries on odd and empty tables, and against brute force on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from marketlens.llm import queries

QUERIES = queries.queries()
COLUMNS = {
    "op1": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2": "doc_id fingerprint component_id",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9": "doc_id size source_size target taken",
    "op10": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


def run(spark, name, folder):
    found = next(f for k, f in QUERIES.items() if k.startswith(f"{name}_"))
    return [r.asDict() for r in found(spark, folder).collect()]


@pytest.mark.parametrize("name", COLUMNS)
def test_empty_table(spark, empty, name):
    found = next(f for k, f in QUERIES.items() if k.startswith(f"{name}_"))(spark, empty)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    assert found.collect() == []


@pytest.mark.parametrize("name", COLUMNS)
def test_odd_rows_each_have_a_result(spark, odd, name):
    from .conftest import odd_documents

    rows = run(spark, name, odd)
    ids = collections.Counter(r["doc_id"] for r in rows if name != "op3" or r["start"] == 0)
    assert ids == collections.Counter(r[0] for r in odd_documents())
    assert set(COLUMNS[name].split()) <= set(rows[0])
    if "score" in rows[0]:
        assert all(0 <= r["score"] <= 1 for r in rows)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_licences(spark, sf, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in run(spark, "op1", sf):
        w = words(lower(texts[r["doc_id"]]["text"]), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        places = sorted((k, label) for phrase, label in phrases.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        base = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels)
        assert r["score"] > 0 or not places


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """prints: id -> fingerprint; the smallest id reachable by links of two bits or fewer."""
    ids = sorted(prints)
    fps = np.array([prints[k] for k in ids], np.uint64)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = find(k), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_simhash(spark, sf, texts):
    prints = {k: fingerprint(r["text"]) for k, r in texts.items()}
    expected = components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op2", sf)}
    assert got == {k: (f"{prints[k]:016x}", expected[k]) for k in texts}


def test_packing(spark, sf, texts):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, by_doc, by_sequence = run(spark, "op3", sf), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, doc in texts.items():
        ids, at = [*own.encode(doc["text"] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used += at
    assert used / (2048 * len(by_sequence)) > 0.98


def removed(docs):
    """docs in order: per text the bytes that an earlier 100-byte string covers."""
    seen, out = set(), []
    for text in docs:
        flags = bytearray(len(text))
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                flags[p : p + 100] = b"\1" * 100
            seen.add(w)
        out.append(flags)
    return out


def check_removed(rows, docs):
    for (k, text), flags in zip(docs, removed([t for _, t in docs]), strict=True):
        left = bytes(c for c, f in zip(text, flags, strict=True) if not f)
        runs = len(re.findall(b"\1+", bytes(flags)))
        assert (rows[k]["n_bytes"], rows[k]["n_removed"], rows[k]["n_spans"], rows[k]["kept_sha256"]) == (len(text), sum(flags), runs, hashlib.sha256(left).hexdigest()), k


def test_suffix_dedup(spark, sf, texts):
    check_removed({r["doc_id"]: r for r in run(spark, "op4", sf)}, [(k, (r["text"] or "").encode()) for k, r in texts.items()])


def test_quality(spark, sf, texts):
    for r in run(spark, "op5", sf):
        text = texts[r["doc_id"]]["text"] or ""
        w = words(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(windows)
        repeated = len({k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)})
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts_agree_with_the_labels(spark):
    import pyarrow.parquet as pq

    labels = {x["doc_id"]: x["quality"] for x in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    judged = [(r["kept"], labels[r["doc_id"]]) for r in run(spark, "op5", "/root/testdata/sf0.01") if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(kept == bool(label) for kept, label in judged) / len(judged) > 0.97


def test_language(spark, sf, texts):
    rows = run(spark, "op7", sf)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_toxicity(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    labels = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = run(spark, "op6", sf)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and r["held_out"]]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.8
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.03


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    fits = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda m: 13 <= len(n(m)) <= 19 and luhn(n(m)), "phone": lambda m: 9 <= len(n(m)) <= 15}
    return [(kind, *m.span()) for kind, p in PII.items() for m in re.finditer(p, text) if fits[kind](m)]


HARD = ["a@b.co_c@d.com x@@y.z @k.l a.b@c-.d.e", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.256", "4111 1111 1111 1111 41111111111111110 4111-1111-1111-1111-", "+1 (555) 010-9999 +12 +1........ ++1 23456789 0"]


def test_personal_data(spark, sf, texts):
    from marketlens.llm import pii

    for text in HARD:
        assert sorted(pii.base_spans(text)) == sorted(personal(text)), text
    for r in run(spark, "op8", sf):
        found = personal(texts[r["doc_id"]]["text"] or "")
        assert [r[f"n_{k}"] for k in PII] == [sum(x[0] == k for x in found) for k in PII]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r["spans"].split(",")) or not found


def shares(sizes, weights=(3, 1, 2)):
    """sizes: source -> words. Targets by filling up."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full, level = 1.5 * sum(sizes.values()), set(), 0.0
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in rest)
        new = {s for s in rest if level * w[s] > 2 * sizes[s]}
        if not new:
            break
        full |= new
    return {s: 2 * sizes[s] if s in full or not sizes[s] else level * w[s] for s in names}


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_mixing(spark, which, request):
    import pyarrow.parquet as pq

    folder = request.getfixturevalue(which)
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    rows = run(spark, "op9", folder)
    sizes, source, taken = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for d in docs:
        sizes[d["source"]] += len(words(d["text"]))
        source[d["doc_id"], len(words(d["text"]))].add(d["source"])
    expected = shares(dict(sizes))
    for r in rows:
        s = next(s for s in source[r["doc_id"], r["size"]] if r["source_size"] == sizes[s])  # rows may share an id
        assert r["target"] == pytest.approx(expected[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in run(spark, "op9", folder))
    assert again == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows)


def paragraphs(text):
    lines = text.split("\n")
    first = [lines[0][k : k + 32] for k in range(0, min(256, len(lines[0])), 32)] + [lines[0][k : k + 256] for k in range(256, len(lines[0]), 256)]
    return {*first, *(x[k : k + 256] for x in lines[1:] for k in range(0, len(x), 256))}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, sf, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op10", sf)}
    ids = list(texts)
    for k, doc in texts.items():
        text, after = doc["text"] or "", texts[ids[(ids.index(k) + 1) % len(ids)]]["text"] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(text, edited)) and r["near_next"] == pytest.approx(alike(text, after))
    prints = {(doc["text"] or ""): rows[k]["fingerprint"] for k, doc in texts.items()}
    assert all(prints[doc["text"] or ""] == rows[k]["fingerprint"] for k, doc in texts.items())
