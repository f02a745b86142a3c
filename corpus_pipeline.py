"""A training corpus from the documents of a folder of tables, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it
as Parquet into the shared checkpoint folder and hands the reread table to the next stage. All but
the last return the columns of ``documents``. Stages take null and empty texts, rows without an id and
empty tables; what they do with them is said in each operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketframe.llm import bpe, jaccard, line_crf, mixing, secrets
from marketframe.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line CRF, fitted on the folder's labels, scores under one half (null and
    empty texts too)."""
    return line_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word shingle similarity of 0.8 or more, the values
    of near-duplicate stages. Rows without an id and texts without a word stay."""
    return jaccard.one_per_component(docs, words=5, percent=80)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the values of secrets; no document goes."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their target weights."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row a document of the mix."""
    return bpe.bpe_round_trip(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("secret scans", secret_values),
          ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode)]

#: SQL cannot express the classifier; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``. A stage's table is removed once the next one is
    written; the last one's stays, since the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
