"""The corpus pipeline: toxicity, SimHash near-dedup, personal data, source mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that its stage keeps, with the columns
of docs, but for the last, which returns the packed pieces. ``run`` writes each stage's rows as Parquet beside the checkpoints and
reads them again as the next one's documents; a stage's folder goes once the next one's rows are written, the last stays for the reader of the
result. ``ORACLE_SQL`` is None: training, Hamming links and tokens are beyond SQL, so the tests hold the pipeline against a brute-force version.

Defined cases, beside those of the operators: rows with null text, source, lang or n_chars pass like others (the mix leaves out texts without words);
rows without an id all stay in near_dedup; of equals in a component the least (doc_id, hash of the text) stays; repeated rows are scored and masked each, collapse in
near_dedup, and share what the mix takes; very long texts stay whole until packing cuts their ids; columns beyond those of documents, whatever their names, go
along with their rows up to packing; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import mixing, packing, pii, simhash, toxicity
from marketlens.llm.common import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier calls toxic go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id stays."""
    return simhash.first_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its personal data masked."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated, cut at the source's target, or left out."""
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        to = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if done:
            path = spark._jvm.org.apache.hadoop.fs.Path(done)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done = to
    return docs
