"""Labelled training rows, shared by the classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that a model is fitted on.
FIT_ROWS = 3000
#: Default of ``fit_bytes``: longer texts are scored whole, but a model is not fitted on them, which bounds
#: what the fit holds to ``FIT_ROWS`` times this.
FIT_BYTES = 200_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose label must not be learned from; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from; of several labels the largest counts."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))


def log_odds(labels: DataFrame, label: str) -> float:
    """Log odds of label 1 over all labels that may be learned from (add-one smoothed)."""
    r = _known(labels, label).agg(F.sum("y").alias("good"), F.count("*").alias("n")).head()
    return math.log(((r.good or 0) + 1) / (r.n - (r.good or 0) + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS,
                    fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most ``rows // 2`` documents of either label, none held out, spread
    evenly by a hash of the id. They are chosen among the labelled texts of 1 to ``fit_bytes`` bytes, so
    very long ones do not shrink the sample. Only ids are joined to the labels; the chosen ids are a
    broadcast of bounded size, and documents are not shuffled."""
    usable = docs.select("doc_id", "text").where(F.octet_length("text").between(1, fit_bytes))
    known = usable.select("doc_id").distinct().join(_known(labels, label), "doc_id")
    parts = [known.where(F.col("y") == v).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(rows // 2)
             for v in (0, 1)]
    return usable.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
