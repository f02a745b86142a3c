"""Registered queries of the subpackage: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Near-copy component of every document."""
    from marketframe.llm.jaccard import ngram_jaccard
    return ngram_jaccard(_table(spark, sf, "documents"))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes from every document."""
    from marketframe.llm.mixing import mix_report
    return mix_report(_table(spark, sf, "documents"))


def op3_quality_crf(spark: SparkSession, sf: str) -> DataFrame:
    """Line-CRF quality score of every document."""
    from marketframe.llm.line_crf import line_quality
    return line_quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op4_block_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated 50-word passages removed from every document."""
    from marketframe.llm.block_dedup import remove_repeats
    return remove_repeats(_table(spark, sf, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated 50-byte strings removed from every document."""
    from marketframe.llm.suffix_dedup import remove_repeats
    return remove_repeats(_table(spark, sf, "documents"))


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Base and randomness-tested secret spans of every document."""
    from marketframe.llm.secrets import secret_scan
    return secret_scan(_table(spark, sf, "documents"))


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    from marketframe.llm.topk import exact_topk
    rows = _table(spark, sf, "embeddings")
    return exact_topk(rows, rows.where("vec_id % 20 = 0"), k=20)


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-gram toxicity score of every document."""
    from marketframe.llm.toxicity import toxicity
    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """BPE ids and round trip of every document."""
    from marketframe.llm.bpe import bpe_round_trip
    return bpe_round_trip(_table(spark, sf, "documents"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Line-first quality rules over every document."""
    from marketframe.llm.quality_rules import quality_rules
    return quality_rules(_table(spark, sf, "documents"))


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    from marketframe.llm.lexical import ranked_search
    return ranked_search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=50)


def op12_sequence_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in contexts of at most 2,048 tokens."""
    from marketframe.llm.sequence_packing import pack_documents
    return pack_documents(_table(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100."""
    from marketframe.llm.hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf, "embeddings").withColumn("label", label)
    return hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_mixing, op3_quality_crf, op4_block_dedup, op5_suffix_dedup, op6_secrets, op7_topk, op8_toxicity, op9_bpe, op10_quality_rules,
                                    op11_lexical_search, op12_sequence_packing, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from marketframe.llm.sql import ORACLES
    return dict(ORACLES)
