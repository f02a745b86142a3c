"""Modality alignment.

Samples carry their payload in the row, so alignment is one equi-join on (date, ticker); there
are no positional index arrays to keep in sync.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_splits(*parts: DataFrame) -> DataFrame:
    """Train and test archives back into one frame (columns matched by name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def align(price: DataFrame, text: DataFrame, keys=("date", "ticker")) -> DataFrame:
    """Inner join of the two sample sets; labels and payloads keep a side suffix."""
    keys = list(keys)

    def side(df, sfx):
        return df.select(*keys, *[F.col(c).alias(f"{c}_{sfx}") for c in df.columns
                                  if c not in keys])
    return side(price, "price").join(side(text, "text"), keys)


def keep_agreeing(aligned: DataFrame) -> DataFrame:
    """Keep samples whose labels agree on both sides; ``label`` is the agreed label."""
    return (aligned.where(F.col("label_price") == F.col("label_text"))
            .withColumn("label", F.col("label_price")))


def agreement(aligned: DataFrame) -> DataFrame:
    """P7 report: aligned count, agreeing count and ratio (one row)."""
    ok = (F.col("label_price") == F.col("label_text")).cast("long")
    return aligned.agg(F.count(F.lit(1)).alias("aligned"), F.sum(ok).alias("agreeing"),
                       F.avg(ok.cast("double")).alias("agreement"))


def concat_or_zeros(a, b, n_b: int):
    """concatenate two feature arrays; a missing right side becomes ``n_b`` zeros."""
    b = F.col(b) if isinstance(b, str) else b
    a = F.col(a) if isinstance(a, str) else a
    zeros = F.array_repeat(F.lit(0.0), n_b)
    return F.concat(a, F.coalesce(b, zeros))
