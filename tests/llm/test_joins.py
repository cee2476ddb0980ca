"""Operators 11 to 13 against brute force: n-gram joins, the conversations' trie, ranked search; odd and empty tables, hot groups, forced small parts."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import conversation_trie, lexical_search, ngram_join, queries


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            part[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        own = root(k)
        least[own] = min((x for x in (least.get(own), i) if x is not None), default=None)
    return collections.Counter((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def joined(spark, rows, tile=ngram_join.TILE):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.text_links(docs, tile).collect())


def edited(dice, words, n):
    words = list(words)
    for _ in range(n):
        k = dice.randrange(len(words))
        words[k : k + 1] = dice.choice([[], [f"new{dice.randrange(999)}"], [words[k], f"more{dice.randrange(99)}"]])
    return " ".join(words)


def near_texts(seed, n_groups=12, size=12):
    dice = random.Random(seed)
    passage = " ".join(f"common{k}" for k in range(60))
    rows = []
    for g in range(n_groups):
        words = [f"w{dice.randrange(400)}" for _ in range(dice.choice([3, 6, 30, 150]))]
        for _ in range(size):
            text = edited(dice, words, dice.randrange(4))
            rows.append(f"{text} {passage}" if g % 4 == 0 else text)
    rows += ["", None, " \t", "a a a a", "a a a a a", "A a a A a a", "one", "One", "x y"]
    dice.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)] + [(None, "a a a a"), (None, "alone here now"), (5, rows[5]), (5, "another text of row five")]


def test_prefixes_move_once(spark, monkeypatch):
    """What counts the n-grams and what meets the counts read one exchange of the prefixes."""
    monkeypatch.setattr(ngram_join, "saved", lambda df: df)
    rows = spark.createDataFrame([(k, list(range(k, k + 9))) for k in range(40)], "node long, prefix array<long>").repartition(3)
    went = ngram_join.routes(rows.groupBy("node").agg(F.first("prefix").alias("prefix")), rows.select("node", F.lit(9).cast("long").alias("n")))
    assert went.collect() and went._jdf.queryExecution().executedPlan().toString().count("ReusedExchange")


@pytest.mark.parametrize("tile", [ngram_join.TILE, 400])
def test_join_is_exact(spark, tile):
    rows = near_texts(3)
    assert joined(spark, rows, tile) == components(rows)


def test_join_of_one_hot_group_in_tiles(spark):
    """A chain of near copies, most of them far from the first one, over many tiles."""
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*(f"v{j}" for j in range(k)), *words[k:]])) for k in range(0, 80, 2)] + [(200 + k, " ".join([*words, f"end{k}"])) for k in range(60)]
    assert joined(spark, rows, 500) == components(rows)


def test_bitmaps_bound_the_difference():
    dice = np.random.default_rng(1)
    sets = [np.unique(dice.integers(0, 1 << 63, size=n).astype(np.uint64) * 2) for n in (1, 5, 90, 90, 400)]
    sets.append(np.unique(np.r_[sets[3][5:], sets[2][:7]]))
    bits = ngram_join.bitmaps(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        assert int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= len(np.setxor1d(sets[a], sets[b]))


def test_forest_has_the_parts_of_all_links():
    dice = random.Random(7)
    for _ in range(30):
        base = [dice.randrange(1 << 60) for _ in range(dice.choice([8, 40, 200]))]
        sets = {tuple(sorted({x if dice.random() > 0.04 else dice.randrange(1 << 60) for x in base})) for _ in range(dice.randint(2, 40))}
        arrays = [np.array(x, np.uint64) for x in sets]
        label = np.arange(len(arrays))
        ngram_join.forest(arrays, label)
        part = np.arange(len(arrays))
        for a, b in itertools.combinations(range(len(arrays)), 2):
            own = len(np.intersect1d(arrays[a], arrays[b]))
            if 100 * own >= 85 * (len(arrays[a]) + len(arrays[b]) - own):
                part[part == part[b]] = part[a]
        assert len(np.unique(np.stack([label, part]), axis=1).T) == len(set(label.tolist())) == len(set(part.tolist()))


def trie_of(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(path))
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def tried(spark, rows, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in conversation_trie.trie(table, **more).collect()), key=repr)


def talks(seed, n=60):
    dice = random.Random(seed)
    rows = []
    for c in dice.sample(range(3 * n), n):
        for t in range(dice.randint(1, 14)):
            rows.append((c, dice.choice([t, t, None]), dice.choice(["user", "assistant", None]), dice.choice(["hi", "hö", "", None, f"text {dice.randrange(4)}"])))
    return [*rows, rows[0], rows[0], (None, 1, "user", "nobody")]


@pytest.mark.parametrize(("block", "one", "turns"), [(1 << 16, 1 << 17, 1024), (16, 4, 3)])
def test_trie_by_tour(spark, monkeypatch, block, one, turns):
    """Also with blocks, stretches and lists so small that every step takes place."""
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "TURNS", turns)
    rows = talks(4)
    assert tried(spark, rows, one=one) == trie_of(rows)


def test_trie_of_a_hot_conversation_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "TURNS", 16)
    same = [(c, t, "user", f"same {t}") for c in range(100, 400) for t in range(3)]
    rows = [*same, *((7, t, "user", "again") for t in range(150))]
    got = {(r[0], r[1]): r for r in tried(spark, rows)}
    expected = {(r[0], r[1]): r for r in trie_of(rows)}
    assert got == expected


def test_arcs_are_a_tour(spark):
    rows = talks(9, 30)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    places = sorted(x for r in conversation_trie.trie(table).collect() for x in (r.enter, r.leave))
    assert places == list(range(1, len(places) + 1))


def ranked(docs, items, top=20):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [cut.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n_docs, n_terms = sum(bool(x) for x in terms), sum(map(len, terms))
    df = collections.Counter(w for x in terms for w in set(x))
    out = collections.Counter()
    for item, text in items:
        query, found = cut.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), []
        for (i, _), own in zip(docs, terms, strict=True):
            tf, score = collections.Counter(own), 0
            for w in query:
                if tf[w]:
                    m = 100 - 25 + (25 * len(own) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out.update((item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top]))
    return out


def found(spark, docs, items, **more):
    rows = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    return collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows)


@pytest.mark.parametrize("item_bytes", [1 << 20, 200])
def test_search_is_exact(spark, monkeypatch, item_bytes):
    """Equal scores, repeated rows, rows without an id; shards of a few documents, so that thresholds skip."""
    dice = random.Random(5)
    vocabulary = [f"t{k}" for k in range(40)] + ["Éa", "ß9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, dice.choice([" ", "-", "\n"]).join(dice.choices(vocabulary, weights, k=dice.choice([1, 5, 30, 200])))) for k in range(150)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (200, docs[8][1]), (201, ""), (202, None), (203, "...")]
    items = [(k, " ".join(dice.choices(vocabulary, k=dice.randint(1, 12)))) for k in range(25)] + [(3, "t1 T1 t2"), (None, "t5"), (90, None), (91, "unknown words")]
    slices = lexical_search.mapped
    monkeypatch.setattr(lexical_search, "mapped", lambda *a: slices(*a, most=600))
    assert found(spark, docs, items, item_bytes=item_bytes) == ranked(docs, items)


def test_pairs_bound_tighter_than_terms():
    row = {"doc_ids": [0, 1, 2], "lengths": np.array([4, 40, 40]), "terms": np.array([0, 1], np.int32), "ends": np.array([2, 4]), "docs": np.array([0, 1, 1, 2], np.int32), "counts": np.array([4, 1, 1, 30])}
    lists = lexical_search.Lists(lexical_search.Shard({k: v if k == "doc_ids" else v.tobytes() for k, v in row.items()}), 3, 84)
    pair = ((0, 500), (1, 700))
    own = sorted(w * lists.most[t] for t, w in pair)
    assert own[1] <= lists.bound(pair) < sum(own)
    docs, scores = lexical_search.scores(lists, [pair], 1)
    assert max(scores) == lists.bound(pair) and set(docs.tolist()) == {0, 1, 2}


NEW = {"op11": "doc_id n_shingles component_id", "op12": " ".join(COLUMNS), "op13": "item_id rank doc_id score"}


def run(spark, name, folder):
    return next(f for k, f in queries.queries().items() if k.startswith(f"{name}_"))(spark, str(folder))


@pytest.fixture
def tables(spark, tmp_path_factory):
    def write(rows):
        folder = tmp_path_factory.mktemp("tables")
        clash = "node string, prefix string, h string, key string, at string, token string, term string, score string"
        extra = ["z"] * 8
        for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string")):
            spark.createDataFrame([(*x, *extra) for x in rows.get(name, [])], f"{kind}, {clash}").write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, tables, name):
    got = run(spark, name, tables({}))
    assert set(NEW[name].split()) <= set(got.columns) and got.collect() == []


def test_odd_tables(spark, tables):
    from .conftest import odd_documents

    docs, items, chats = odd_documents(), [(1, "alpha1 the of word3"), (None, None), (2, "é Apache license")], talks(2, 20)
    folder = tables({"documents": docs, "benchmark": items, "conversations": chats})
    pairs = [(x[0], x[1]) for x in docs]
    assert collections.Counter(tuple(r) for r in run(spark, "op11", folder).select(*NEW["op11"].split()).collect()) == components(pairs)
    assert collections.Counter(tuple(r) for r in run(spark, "op13", folder).select(*NEW["op13"].split()).collect()) == ranked(pairs, items)
    assert sorted((tuple(r) for r in run(spark, "op12", folder).select(*COLUMNS).collect()), key=repr) == trie_of(chats)
