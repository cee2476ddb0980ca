"""The pipeline's stages on odd tables and against what each stage alone decides."""

import collections

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from marketlens.llm import packing

from .test_queries import components, fingerprint, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, folder, to):
    """Rows after each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
        out.append(docs)
    return out


@pytest.mark.parametrize("which", ["odd", "empty", "sf"])
def test_stages(spark, which, request, tmp_path):
    folder = request.getfixturevalue(which)
    first = spark.read.parquet(f"{folder}/documents.parquet")
    clean, kept, masked, mixed, packed = stages(spark, folder, tmp_path)
    for df in (clean, kept, masked, mixed):
        assert df.columns == first.columns
    before = [(r.doc_id, r.text) for r in clean.collect()]
    assert not collections.Counter(before) - collections.Counter((r.doc_id, r.text) for r in first.collect())
    # one document of each group of near copies; rows without an id stay
    prints = collections.defaultdict(set)
    for k, text in before:
        prints[fingerprint(text)].add(k)
    named = {fp: min(x for x in ids if x is not None) for fp, ids in prints.items() if any(x is not None for x in ids)}
    roots = components({k: fp for fp, k in named.items()}) if named else {}
    after = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(k for k, _ in after if k is not None) == sorted(set(roots.values()))
    assert collections.Counter(t for k, t in after if k is None) == collections.Counter(t for k, t in before if k is None)
    # masking keeps every row and its words without personal data
    assert masked.count() == len(after)
    # the mix gives each document its words once or twice, or part of them
    sizes = collections.defaultdict(list)
    for r in masked.collect():
        sizes[r.doc_id].append(words(r.text))
    for r in mixed.collect():
        w = words(r.text)
        assert any(len(w) <= 2 * len(x) and w == (x + x)[: len(w)] for x in sizes[r.doc_id])
        assert r.n_chars == len(r.text)
    total = sum(r.length for r in packed.collect())
    again = packing.pack(mixed).collect()
    assert total == sum(r.length for r in again)


def test_run_is_all_stages(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) == set("doc_id start length ids_crc32 doc_tokens sequence_id offset".split())


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id").collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    clean = [x["doc_id"] in left for x in labels if x["toxic"] == 0]
    toxic = [x["doc_id"] in left for x in labels if x["toxic"] == 1]
    assert sum(clean) / len(clean) > 0.97 and sum(toxic) / len(toxic) < 0.4
    assert docs.columns == COLUMNS
