"""Exponential moving average (W5, W8) as an overlapping block scan.

pandas ``ewm(span, adjust=False)``: e0 = x0, et = a*xt + (1-a)*e(t-1), a = 2/(span+1).
Spark has no recurrence primitive. With q = 1-a the recurrence is the running sum

    e_t = q^t * sum(w_i * x_i * q^-i, i <= t),   w = a, except w = 1 on row 0,

whose terms grow, so every sum keeps the precision of its last terms (relative error about 1e-16 / a)
as long as q^-i is a number. Rows of a key are numbered from 0 and cut into blocks that long. A block
also gets the last rows of the block before it (its lead-in), which bring the carry: what lies before
the lead-in has a weight under ``CARRY`` there, far below the precision of doubles. So

1. one window per key numbers the rows;
2. one window per (key, block) runs the sums; the block's own rows are kept.

There is no join and no pass over a key's blocks. Both windows share the key's partitioning, which is
bar-sized; ``spread`` deals the blocks of a key out over tasks by a shuffle of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight, at a block's first own row, of everything before its lead-in.
CARRY = 1e-40
#: Largest power of q that the sums hold.
REACH = 1e270


def block_rows(spans, carry: float = CARRY, reach: float = REACH) -> tuple[int, int]:
    """(own rows, lead-in rows) of a block: the slowest average sets the lead-in, the fastest the
    whole length."""
    rates = [-math.log(1.0 - 2.0 / (s + 1.0)) if s > 1 else math.inf for s in spans]
    slow, fast = min(rates), max(r for r in [0.0, *rates] if r < math.inf)
    if not fast:
        return 1 << 30, 0                                # spans of 1: the values themselves
    lead = math.ceil(-math.log(carry) / slow)
    own = math.floor(math.log(reach) / fast) - lead
    return (own, lead) if own >= lead else (0, 0)        # 0: spans too far apart for one pass


def ema_columns(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "ticker",
                order: str = "date", keep_numbering: bool = False, spread: bool = False,
                carry: float = CARRY, reach: float = REACH) -> DataFrame:
    """Add one EMA column per ``specs[name] = (value_column, span)``; values must be non-null
    (fill first, W15), a NULL raises. All specs share one numbering and one block window, unless
    their spans are so far apart that they need passes of their own. ``keep_numbering`` leaves
    ``_rn`` for a chained pass."""
    own, lead = block_rows([s for _, s in specs.values()], carry, reach)
    if not own and len(specs) > 1:
        names = sorted(specs, key=lambda n: specs[n][1])
        half = len(names) // 2
        d = ema_columns(df, {n: specs[n] for n in names[:half]}, key, order, True, spread, carry, reach)
        return ema_columns(d, {n: specs[n] for n in names[half:]}, key, order, keep_numbering, spread, carry, reach)
    if not own:
        raise ValueError("carry and reach leave no room for a block")
    d = df
    if "_rn" not in d.columns:
        d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    mine = F.floor(F.col("_rn") / own)
    leads = (F.col("_rn") % own >= own - lead)           # also lead-in of the next block
    d = d.withColumn("_blk", F.explode(F.when(leads, F.array(mine, mine + 1)).otherwise(F.array(mine))))
    if spread:
        d = d.repartition(key, "_blk")
    w = Window.partitionBy(key, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = F.col("_rn") - F.greatest(F.col("_blk") * own - lead, F.lit(0))          # place in the block
    out = {}
    for name, (src, span) in specs.items():
        a = 2.0 / (span + 1.0)
        x = F.coalesce(F.col(src), F.raise_error(F.lit(f"EMA over a NULL in {src}: fill the gaps first"))
                       .cast("double"))
        if a == 1.0:
            out[name] = x.cast("double")
            continue
        q = F.lit(1.0 - a)
        weight = F.when(F.col("_rn") == 0, F.lit(1.0)).otherwise(F.lit(a))
        out[name] = F.sum(weight * x * F.pow(q, -j)).over(w) * F.pow(q, j)
    d = d.withColumns(out).where(F.col("_blk") == mine).drop("_blk")
    return d if keep_numbering else d.drop("_rn")


def ema(df: DataFrame, value: str, span: float, out: str | None = None, key: str = "ticker",
        order: str = "date") -> DataFrame:
    """One EMA column."""
    return ema_columns(df, {out or f"EMA_{int(span)}": (value, span)}, key, order)
