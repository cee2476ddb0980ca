"""What the operators do with hot keys, copies, rows without an id and very long texts: whole results, against brute force, and work in proportion."""

import collections
import random
import time

import numpy as np
import pytest

from marketlens.llm import licenses, mixing


def seconds(of, *arguments):
    began = time.process_time()
    of(*arguments)
    return time.process_time() - began


def doubling(of, of_size, size):
    """How much longer twice the size takes, at the best of three."""
    small, large = (min(seconds(of, of_size(n)) for _ in range(3)) for n in (size, 2 * size))
    return large / max(small, 1e-9)


def test_licence_scan_is_linear_in_a_text():
    def scan(text):
        words, _ = licenses.normal(text)
        licenses.base_places(words)
        licenses.detections(words)

    assert doubling(scan, lambda n: b"cc by 4.0 " * n, 20_000) < 3


def test_settling_keeps_what_no_kept_span_holds():
    dice = random.Random(5)
    for _ in range(200):
        found = [(a, a + dice.randint(1, 9), dice.choice([20, 40, 90]), dice.choice("xyz"), 0.5) for a in (dice.randint(0, 20) for _ in range(dice.randint(0, 25)))]
        kept = []
        for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
            if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
                kept.append(x)
        assert licenses.settled(found) == sorted(kept)


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
THREE = BSD + "so " * 1500 + "Neither the name of Foo may be used to endorse or promote products derived from this software. "


@pytest.mark.parametrize(("text", "labels"), [(BSD, ["bsd-2-clause"]), (THREE, ["bsd-3-clause"]), (BSD + THREE, ["bsd-2-clause", "bsd-3-clause"]), (THREE + BSD, ["bsd-3-clause", "bsd-2-clause"])])
def test_a_third_clause_far_away_still_counts(text, labels):
    assert [x[3] for x in licenses.detections(licenses.normal(text.encode())[0])] == labels


def mixed(docs):
    rows, texts = mixing.mix(docs).collect(), mixing.mixed_texts(docs).collect()
    taken, words = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r.doc_id, r.source] += r.taken
    for r in texts:
        words[r.doc_id, r.source] += len(r.text.split())
    return rows, texts, +taken, +words


def test_a_tiny_source_leaves_the_schedule_as_it_is(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 200, "ab"[k % 2]) for k in range(2000)] + [(5000, "three small words", "c")], "doc_id long, text string, source string")
    goals = mixing.targets(mixing.sized(docs))
    block = mixing.block_size(goals)
    assert mixing.schedule(goals, block).count() <= 600_000 / block + 6
    rows, _, taken, words = mixed(docs)
    assert taken == words and abs(sum(taken.values()) - 600_000) < 10


@pytest.mark.parametrize("copies", [mixing.COPIES, 7])
def test_repeated_rows_share_what_the_mix_takes(spark, monkeypatch, copies):
    """Copies with and without an id, also in two sources; the mix ends within a group of copies."""
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = [(9, "one two three four five six seven", "a")] * 40 + [(None, "x y z", "a")] * 30 + [(None, "x y z", None)] * 11 + [(3, "", "a"), (4, None, "b")] + [(k, f"w{k} " * 5, "b") for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found, _, taken, words = mixed(docs)
    assert taken == words
    assert collections.Counter((r.doc_id, r.source, r.size) for r in found) == collections.Counter((k, s, len((t or "").split())) for k, t, s in rows)
    goals = {r.source: r.target for r in mixing.targets(mixing.sized(docs)).collect()}
    for source, target in goals.items():
        assert abs(sum(r.taken for r in found if r.source == source) - target) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in found)


def test_many_sources_each_get_their_slots(spark):
    """Shares of every size; each slot goes to the source whose share holds its point."""
    dice = random.Random(2)
    sizes = [dice.choice([1, 2, 3, 50, 700]) for _ in range(300)]
    docs = spark.createDataFrame([(k, "w " * n, f"s{k:03d}") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    goals = mixing.targets(mixing.sized(docs))
    rows = sorted(goals.collect(), key=lambda r: r.s)
    edges = np.cumsum([r.target for r in rows])
    n = sum(int(np.ceil(r.target)) for r in rows)
    expected = collections.Counter(min(int(np.searchsorted(edges / edges[-1], (k + 1) * mixing.GOLDEN % 1.0, side="right")), len(rows) - 1) for k in range(n))
    got = mixing.schedule(goals, 1).collect()
    quota = {r.s: int(np.ceil(r.target)) for r in rows}
    assert collections.Counter(r.s for r in got) == quota
    assert collections.Counter(r.s for r in got if r.slot < n) == {s: min(quota[s], k) for s, k in expected.items()}


def fingerprints_of(spark, rows, parts=3):
    from marketlens.llm import fingerprints

    return fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()


def test_neighbours_of_heavy_ids_and_rows_without_one(spark, monkeypatch):
    """Ids that fill ranges, alike texts among them, and rows without an id: every row's next one is that of the whole order, around its end."""
    from marketlens.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE", 8)
    dice = random.Random(8)
    ids = [None] * 60 + [7] * 50 + list(range(1, 40))
    rows = [(k, dice.choice(["", "same text", f"text {dice.random()}"])) for k in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.neighbours(df).collect()
    placed = fingerprints.ranged(df).collect()
    assert len({(r.r, r.part) for r in placed}) > 12 and collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    order = sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.h % 2**64) >> 33, r.h, r.text))
    assert [(r.r, r.part) for r in order] == sorted((r.r, r.part) for r in placed)
    assert collections.Counter((r.doc_id, r.text, r.next_text) for r in got) == collections.Counter((x.doc_id, x.text, y.text) for x, y in zip(order, order[1:] + order[:1], strict=True))


def test_sketches_of_long_and_many_line_texts(spark):
    from .test_queries import alike, paragraphs

    dice = random.Random(9)
    line = lambda n: "".join(dice.choice("abc é\U0001f600") for _ in range(n))
    texts = [line(5000), "\n".join(line(dice.randint(0, 600)) for _ in range(400)), "\n" + line(300), line(256) + "\n" + line(256), line(255) + "\nx", "a\r\nb c\n\n\nd", ""]
    texts += [texts[1] + "\nmore", texts[1].replace("a", "b", 40)]
    rows = fingerprints_of(spark, list(enumerate(texts)))
    for r in rows:
        text, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, after))
        assert int(r.fingerprint.split(":")[0]) == len(paragraphs(text) - {""})


def test_what_never_peels_is_compared_as_sets(spark, monkeypatch):
    from marketlens.llm import fingerprints

    from .test_queries import alike

    monkeypatch.setattr(fingerprints, "ROUNDS", 1)
    texts = ["\n".join(f"line {k * j}" for k in range(60)) for j in (1, 2, 3, 4)]
    for r in fingerprints_of(spark, list(enumerate(texts))):
        assert r.near_next == pytest.approx(alike(texts[r.doc_id], texts[(r.doc_id + 1) % 4]))


def test_sketches_are_linear_in_a_text(spark):
    from marketlens.llm import fingerprints

    def run(text):
        spark.createDataFrame([(1, text)], "doc_id long, text string").select(*(fingerprints.F.expr(fingerprints.digests("text")).alias(x) for x in "a")).select(fingerprints.likeness("a", "array(1L)", fingerprints.sketch(fingerprints.hashed("a", 0)), fingerprints.sketch(fingerprints.hashed("array(1L)", 0)))).collect()

    def wall(n):
        text = "".join(random.Random(n).choices("abcdefgh ", k=n))
        began = time.time()
        run(text)
        return time.time() - began

    wall(1000)
    small, large = min(wall(1_000_000) for _ in range(2)), min(wall(2_000_000) for _ in range(2))
    assert large < 3 * small


def check_removal(spark, docs, parts=3):
    """docs: (doc_id, text), distinct ids but for None; brute force over all rows, ids in order."""
    import hashlib

    from marketlens.llm.suffix_dedup import LENGTH, remove

    first = {}  # window -> smallest (doc_id, start)
    for k, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - LENGTH + 1):
            w, place = data[p : p + LENGTH], (k is not None, k or 0, p)
            first[w] = min(first.get(w, place), place)
    expected = collections.Counter()
    for k, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - LENGTH + 1):
            if first[data[p : p + LENGTH]] < (k is not None, k or 0, p):
                gone[p : p + LENGTH] = b"\1" * LENGTH
        expected[k, sum(gone), hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()] += 1
    got = remove(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
    assert collections.Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == expected


@pytest.mark.parametrize("hot", [4096, 3])
def test_common_lines_in_ever_different_surroundings(spark, monkeypatch, hot):
    """One short and one long common line, copies and near copies, rows of one id and without one; anchors of more than a few rows are parted."""
    from marketlens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    dice = random.Random(hot)
    noise = lambda n: "".join(dice.choice("abcdefgh é") for _ in range(n))
    short, long, passage = "=" * 30 + " all rights reserved ", noise(170), noise(400)
    texts = [noise(dice.randint(0, 90)) + dice.choice([short, long, short + long, passage[dice.randint(0, 200) :], "ab" * dice.randint(40, 90), passage]) + noise(dice.randint(0, 90)) for _ in range(120)]
    docs = [(k if k % 9 else None if k % 2 else 4, t) for k, t in enumerate(texts)]
    check_removal(spark, docs + docs[:7] + [(200, texts[0]), (None, texts[5]), (None, None)])


def test_groups_come_whole_or_as_a_stream():
    import pyarrow as pa

    from marketlens.llm.suffix_dedup import by_group

    dice = random.Random(4)
    for _ in range(200):
        values = sorted(dice.choice(range(6)) for _ in range(dice.randint(0, 40)))
        batches, at = [], 0
        while at < len(values):
            to = at + dice.randint(1, 7)
            batches.append(pa.RecordBatch.from_arrays([pa.array(values[at:to], pa.int64())], names=["h"]))
            at = to
        found = [(t.column("h").to_pylist(), hot) for t, hot in by_group(iter(batches), dice.choice([0, 60, 1000]), 8)]
        assert [x for part, _ in found for x in part] == values
        n = collections.Counter(values)
        for part, hot in found:
            assert hot == (n[part[0]] > 8) and (len(set(part)) == 1 if hot else all(part.count(x) == n[x] for x in part))


def test_nearest_smaller_places():
    from marketlens.llm.suffix_dedup import next_smaller, previous_smaller

    dice = random.Random(6)
    for _ in range(100):
        x = [dice.randint(0, 9) for _ in range(dice.randint(0, 30))]
        a = np.array(x, int)
        assert previous_smaller(a).tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert next_smaller(a).tolist() == [min((j for j in range(i + 1, len(x)) if x[j] < x[i]), default=len(x)) for i in range(len(x))]


def test_keys_with_many_rows_are_joined_apart(spark, monkeypatch):
    from marketlens.llm import common, simhash

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    body = [" ".join(f"{w}{k}" for k in range(40)) for w in ("a", "b", "c")]
    rows = [(None, body[0])] * 30 + [(None, body[1])] * 5 + [(k, body[1]) for k in range(50, 60)] + [(9223372036854775807, body[2]), (9223372036854775806, body[2]), (None, ""), (-3, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == collections.Counter([(None, None)] * 30 + [(None, 50)] * 5 + [(k, 50) for k in range(50, 60)] + [(9223372036854775807, 9223372036854775806), (9223372036854775806, 9223372036854775806), (None, -3), (-3, -3)])
    star = spark.createDataFrame([(k, 0) for k in range(1, 80)] + [(k + 100, k) for k in range(1, 20)], "u long, v long")
    assert {r.u: r.v for r in simhash.components(star).collect()} == {k: 0 for k in [*range(1, 80), *range(101, 120)]}


def test_equal_pieces_are_dealt_to_all_blocks(spark, monkeypatch):
    from marketlens.llm import packing

    monkeypatch.setattr(packing, "BLOCK", 500)
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'the same few words' as text")
    rows = packing.pack(docs).groupBy((packing.F.col("sequence_id") / (1 << 32)).cast("long").alias("b")).count().collect()
    assert len(rows) == 40 and sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) < 800


def test_toxicity_scores_are_sums_of_weights(spark):
    from marketlens.llm import toxicity

    dice = random.Random(3)
    clean = [f"word{k}" for k in range(300)]
    texts = [" ".join(dice.choices(clean, k=20) + (["Vile", "vilest", "horrid"] if k % 5 == 0 else [])) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, "another text of an id"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k % 5 == 0)) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    for text, score in zip(texts[:40], model.scores(texts[:40]), strict=True):
        features = {f for w in toxicity.words_of(text) for f in toxicity.word_features(w)}
        assert score == pytest.approx(1 / (1 + np.exp(-model.bias - sum(model.weights.get(f, 0.0) for f in features))))
    assert [s >= 0.5 for s in model.scores(texts)] == [k % 5 == 0 for k in range(400)]
    few = toxicity.learn(docs, labels, positives=20, unlabelled=30)
    assert set(few.weights) <= {f for t in texts for w in toxicity.words_of(t) for f in toxicity.word_features(w)}


def test_ids_behind_the_bound_are_those_with_the_least_hashes(spark):
    from marketlens.llm import toxicity

    ids = spark.range(5000).selectExpr("if(id < 2000, 7, id) as doc_id")
    every = [r.doc_id for r in ids.distinct().selectExpr("doc_id", "xxhash64(doc_id, 2) as x").orderBy("x", "doc_id").limit(40).collect()]
    assert sorted(r.doc_id for r in toxicity.chosen(ids, 2, 40).collect()) == sorted(every)


@pytest.mark.parametrize("chars", [1 << 19, 50])
def test_languages_are_those_of_the_largest_cosine(monkeypatch, chars):
    """Against trigram vectors made one by one; also where texts go through in pieces."""
    from marketlens.llm import language_id

    monkeypatch.setattr(language_id, "CHARS", chars)
    dice = random.Random(2)
    texts = [" ".join("".join(dice.choices("abcdeäя漢", k=dice.randint(1, 9))) + dice.choice(["", ",", "--", "1"]) for _ in range(dice.randint(1, 60))) for _ in range(30)] + ["", None, "12 34", "a"]
    profiles = language_id.Profiles(["x", "y", "z"], np.random.default_rng(1).normal(size=(3, language_id.DIMENSIONS)))
    langs, scores = profiles.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        letters = [ord(c) if c.isalpha() else 0 for c in f" {text or ''} "]
        letters = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
        vector = np.zeros(language_id.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            if b:
                v = np.ones(language_id.DIMENSIONS)
                for k, x in enumerate((a, b, c)):
                    v *= np.roll(language_id.letter_vector(x), k)
                vector += v
        if not vector.any():
            assert (lang, score) == ("und", 0.0)
            continue
        apart = vector / np.linalg.norm(vector) - profiles.mean
        cosines = profiles.prototypes @ (apart / np.linalg.norm(apart))
        assert lang == "xyz"[int(cosines.argmax())] and score == pytest.approx((1 + cosines.max()) / 2, abs=1e-6)


def test_kept_is_the_share_of_content_in_the_best_labelling():
    """Every labelling of short texts is tried."""
    import itertools

    import pyarrow as pa

    from marketlens.llm import quality

    chain, dice = quality.model(), random.Random(7)
    lines = ["The road was long, and the house stood at its end under old trees.", "Home | About | Login", "BUY NOW!! CHEAP!! FREE!!", "Later.", "", "12 | 44 | 90"]
    texts = ["\n".join(dice.choice(lines) for _ in range(dice.randint(1, 7))) + "\n" + " ".join(f"word{k}" for k in range(60)) for _ in range(40)]
    out = quality.judge_batch(pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"]), chain).to_pylist()
    for text, row in zip(texts, out, strict=True):
        _, own, features, _ = quality.document(text.encode())
        at = chain.scores(features)
        value = lambda y: chain.start[y[0]] + sum(at[k, v] for k, v in enumerate(y)) + sum(chain.move[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=len(own)), key=value)
        share = sum(len(x) for x, y in zip(own, best, strict=True) if y == quality.CONTENT) / sum(map(len, own))
        assert row["content_share"] == pytest.approx(share) and row["kept"] == (not row["base_failed"] and share >= 0.5)


def test_overlapping_spans_are_found_in_time_linear_in_a_text():
    from marketlens.llm import pii

    assert doubling(lambda x: pii.spans([x], pii.model()), lambda n: "GB29NWBK60161331926819 a@b.co +1 555 010 9999 " * n, 2000) < 3


def test_the_pipelines_folders_go(spark, sf, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [x.name for x in next(tmp_path.iterdir()).iterdir()] == ["4-packing"]
