"""Evaluation and run summaries.

All are aggregates over the prediction/sample tables; the ROC-AUC is exact and distributed:
per-score counts, range-partitioned by score, a running sum inside each partition, and a prefix over
the partitions' totals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import safe_div


def class_balance(samples: DataFrame, split: str = "split", ticker: str = "ticker",
                  label: str = "label", date: str = "date") -> DataFrame:
    """A7 + A16: counts, Up count and share, first/last date per split and per (split, ticker);
    ``rollup`` also gives the split totals (ticker NULL) and the grand total."""
    return samples.rollup(split, ticker).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).cast("long").alias("n_up"),
        F.avg(F.col(label).cast("double")).alias("up_share"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def confusion(pred: DataFrame, prob: str = "probability", actual: str = "actual",
              threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """A10 (+A13): confusion counts and the derived rates; predicted Up when p > t (training
    rule) or p >= t (``inclusive``, app rule). Empty denominators give NULL."""
    p = F.col(prob)
    up = (p >= threshold) if inclusive else (p > threshold)
    a = F.col(actual) == 1
    c = pred.agg(
        F.count_if(up & a).alias("tp"), F.count_if(up & ~a).alias("fp"),
        F.count_if(~up & ~a).alias("tn"), F.count_if(~up & a).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    return c.select(
        "tp", "fp", "tn", "fn",
        safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        safe_div(tn, tn + fp).alias("specificity"),
        safe_div(2 * precision * recall, precision + recall).alias("f1"),
        safe_div(tp + fp, tp + fp + tn + fn).alias("predicted_up_share"))


def accuracy(pred: DataFrame, prob: str = "probability", actual: str = "actual",
             threshold: float = 0.5) -> DataFrame:
    """Share of thresholded predictions (p > t) equal to the label."""
    hit = ((F.col(prob) > threshold).cast("int") == F.col(actual)).cast("double")
    return pred.agg(F.avg(hit).alias("accuracy"))


def ticker_accuracy(pred: DataFrame, prob: str = "probability", actual: str = "actual",
                    ticker: str = "ticker", threshold: float = 0.5) -> DataFrame:
    """Accuracy per ticker."""
    hit = ((F.col(prob) > threshold).cast("int") == F.col(actual)).cast("double")
    return pred.groupBy(ticker).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def roc_auc(pred: DataFrame, score: str = "probability", actual: str = "actual",
            buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC with ties counted 1/2: sum_s P(s) * (N(below s) + N(s)/2) / (P * N).

    Per-score counts (partial aggregation) are range-partitioned by score (``buckets`` partitions, the
    session's number by default); a partition sums its own part and its totals, and the few totals are
    prefixed. Rows whose score is NULL or NaN cannot be ranked; they are left out and counted in
    ``unranked``."""
    pos = F.col(actual).cast("long")
    s = F.col(score).cast("double")
    g = pred.groupBy(F.when(~F.isnan(s), s).alias("s")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    dealt = g.repartitionByRange(buckets, "s") if buckets else g.repartitionByRange("s")
    parts = dealt.sortWithinPartitions("s").mapInArrow(_auc_part, "lo double, p long, n long, u double, lost long")
    before = F.sum("n").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))   # a row a partition
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    return parts.agg(
        safe_div(F.sum(F.col("u") + F.col("p").cast("double") * F.col("before")), F.sum("p").cast("double") * F.sum("n")).alias("roc_auc"),
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.coalesce(F.sum("lost"), F.lit(0)).alias("unranked"))


def _auc_part(batches):
    """One partition's scores in rising order: its lowest score, totals and own part of the sum."""
    import pyarrow as pa
    lo, p_all, n_all, u, lost, any_row = None, 0, 0, 0.0, 0, False
    for batch in batches:
        ranked = np.asarray(batch.column("s").is_valid())
        p, n = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "n"))
        lost += int((p + n)[~ranked].sum())
        any_row |= batch.num_rows > 0
        p, n = p[ranked], n[ranked]
        if not len(p):
            continue
        lo = float(batch.column("s").drop_null()[0].as_py()) if lo is None else lo
        below = n_all + np.cumsum(n) - n
        u += float((p * (below + n / 2.0)).sum())
        p_all, n_all = p_all + int(p.sum()), n_all + int(n.sum())
    if any_row:
        yield pa.RecordBatch.from_pydict({"lo": pa.array([lo], pa.float64()), "p": pa.array([p_all], pa.int64()),
                                          "n": pa.array([n_all], pa.int64()), "u": pa.array([u], pa.float64()),
                                          "lost": pa.array([lost], pa.int64())})


def sentiment_buckets(scored: DataFrame, polarity: str = "sentiment_score",
                      cut: float = 0.1) -> DataFrame:
    """Counts of polarity > cut, within [-cut, cut], < -cut, and the mean polarity."""
    p = F.col(polarity)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("avg_polarity"),
        F.count_if(p > cut).alias("n_positive"),
        F.count_if((p >= -cut) & (p <= cut)).alias("n_neutral"),
        F.count_if(p < -cut).alias("n_negative"))


def run_summary(df: DataFrame, kept: str, by: str | None = None) -> DataFrame:
    """Processed / kept / filtered / success rate (NULL rate for zero rows)."""
    k = F.col(kept)
    aggs = [F.count(F.lit(1)).alias("processed"), F.count_if(k).alias("kept"),
            F.count_if(~k).alias("filtered")]
    out = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("success_rate", safe_div(F.col("kept") * 100.0, F.col("processed")))
