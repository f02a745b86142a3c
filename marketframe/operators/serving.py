"""Serving queries.

Per-ticker windows here run on bar/sample-sized tables (bounded by the calendar). Top-N per
ticker is ``row_number() <= N``, which Spark plans as a partial ``WindowGroupLimit`` before the
shuffle and a final one after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import confidence, day_change_pct, safe_div, trend


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def asof_lookup(points: DataFrame, series: DataFrame, ticker: str = "ticker",
                point_date: str = "query_date", date: str = "date",
                payload=("close",), bucket_days: int = 64) -> DataFrame:
    """For every (ticker, query time) the series row at that time, else the closest earlier
    one (NULL when none); of series rows of one time the largest payload. Dates and timestamps of any
    resolution; rows without a time are no series rows and find nothing.

    Time is cut into buckets. A bucket holds its series rows in order, after the last row before it
    (carried over the buckets of the ticker), so a point meets one bucket by equality on (ticker,
    bucket) and picks among its rows. A gap costs one row a bucket, not one a day or hour; points
    after the last row meet it by ticker. Only series-sized tables go through a window, points are
    read once, and ``bucket_days`` bounds what a bucket holds."""
    payload = list(payload)
    size = bucket_days * 86_400_000_000
    bucket = lambda c: F.floor(_micros(c) / F.lit(size))
    hit = F.struct(_micros(date).alias("t"), F.col(date).alias("used_date"), *payload)
    rows = series.where(F.col(date).isNotNull()).groupBy(ticker, bucket(date).alias("_bucket")).agg(
        F.sort_array(F.collect_list(hit)).alias("_rows"))
    w = Window.partitionBy(ticker).orderBy("_bucket")
    rows = rows.withColumn("_end", F.try_element_at("_rows", F.lit(-1)))
    rows = rows.withColumns({"_carry": F.lag("_end").over(w), "_next": F.lead("_bucket").over(w)})
    own = F.when(F.col("_carry").isNull(), F.col("_rows")).otherwise(F.concat(F.array("_carry"), F.col("_rows")))
    covered = F.explode(F.sequence("_bucket", F.coalesce(F.col("_next") - 1, F.col("_bucket"))))
    held = rows.select(ticker, F.col("_bucket").alias("_own"), own.alias("_rows"), "_end", covered.alias("_bucket")).select(
        ticker, "_bucket", F.when(F.col("_bucket") == F.col("_own"), F.col("_rows")).otherwise(F.array("_end")).alias("_rows"))
    tail = rows.where(F.col("_next").isNull()).select(ticker, F.col("_bucket").alias("_last"), F.col("_end").alias("_last_hit"))
    found = (points.withColumn("_bucket", bucket(point_date)).join(held, [ticker, "_bucket"], "left")
             .join(tail, ticker, "left"))
    at = _micros(point_date)
    inside = F.try_element_at(F.filter("_rows", lambda r: r["t"] <= at), F.lit(-1))
    found = found.withColumn("_best", F.when(F.col("_bucket") > F.col("_last"), F.col("_last_hit")).otherwise(inside))
    return found.select(*[F.col(c) for c in points.columns],
                        *[F.col(f"_best.{c}").alias(c) for c in ["used_date"] + payload])


def last_n(df: DataFrame, n: int = 30, ticker: str = "ticker", date: str = "date",
           end_dates: DataFrame | None = None, end_col: str = "end_date") -> DataFrame:
    """L3: the last ``n`` rows per ticker up to each ticker's end date (all rows when no end
    dates are given), oldest first via the ``rank_from_end`` column."""
    d = df
    if end_dates is not None:
        d = d.join(end_dates.select(ticker, end_col), ticker).where(F.col(date) <= F.col(end_col))
        d = d.drop(end_col)
    w = Window.partitionBy(ticker).orderBy(F.col(date).desc())
    return d.withColumn("rank_from_end", F.row_number().over(w)).where(
        F.col("rank_from_end") <= n)


def preview(df: DataFrame, n: int = 5, order=("ticker", "date")) -> DataFrame:
    """The first ``n`` rows in ``order``, planned as a top-n per task and one merge."""
    return df.orderBy(*order).limit(n)


def first_k(df: DataFrame, k: int, ticker: str = "ticker", order: str = "post_id") -> DataFrame:
    """L4: the first ``k`` rows per ticker in ``order`` (deterministic sampling switch)."""
    w = Window.partitionBy(ticker).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_last(df: DataFrame, ts: str = "created_at", ticker: str = "ticker",
               value: str = "post_id") -> DataFrame:
    """A1 + A2 + L6: per ticker row count, first and last time and the row at each end."""
    return df.groupBy(ticker).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.min_by(value, F.struct(ts, value)).alias("first_id"),
        F.max_by(value, F.struct(ts, value)).alias("last_id"))


def price_join(pred: DataFrame, bars: DataFrame, ticker: str = "ticker",
               date: str = "date") -> DataFrame:
    """Predictions joined with the bar close of the same (ticker, date)."""
    return pred.join(bars.select(ticker, date, "close"), [ticker, date])


def projection_history(pred: DataFrame, bars: DataFrame, n: int = 30, least: int = 5,
                       ticker: str = "ticker", date: str = "date") -> DataFrame:
    """Input of W17: the last ``n`` aligned rows per ticker, then their closes. Tickers with fewer
    than ``least`` rows before or after the join have no projection."""
    whole = F.count(F.lit(1)).over(Window.partitionBy(ticker))
    rows = last_n(pred, n, ticker, date).drop("rank_from_end").withColumn("_n", whole)
    rows = price_join(rows.where(F.col("_n") >= least).drop("_n"), bars, ticker, date)
    return rows.withColumn("_n", whole).where(F.col("_n") >= least).drop("_n")


def project_prices(hist: DataFrame, ticker: str = "ticker", date: str = "date",
                   prob: str = "probability", close: str = "close",
                   fallback: float = 0.01) -> DataFrame:
    """A14 + W17: typical move = mean |daily return| over the ticker's rows (fallback when not
    positive); projected close: first row = actual close, then
    close[i-1] * (1 + move * |p[i-1] - 0.5| * 2 * (+1 if p[i-1] >= 0.5 else -1))."""
    w = Window.partitionBy(ticker).orderBy(date)
    prev_c = F.lag(close).over(w)
    prev_p = F.lag(prob).over(w)
    d = hist.withColumns({"_prev_c": prev_c, "_prev_p": prev_p,
                          "_ret": F.abs(safe_div(F.col(close), prev_c) - 1)})
    move = F.avg("_ret").over(Window.partitionBy(ticker))
    d = d.withColumn("avg_move", F.when(move > 0, move).otherwise(F.lit(fallback)))
    sign = F.when(F.col("_prev_p") >= 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
    step = F.col("avg_move") * F.abs(F.col("_prev_p") - 0.5) * 2.0 * sign
    d = d.withColumn("predicted_close", F.when(F.col("_prev_c").isNull(), F.col(close))
                     .otherwise(F.col("_prev_c") * (1.0 + step)))
    return d.drop("_prev_c", "_prev_p", "_ret")


def signal(pred: DataFrame, prob: str = "probability", threshold: float = 0.5) -> DataFrame:
    """trend label (p >= t -> Up) and confidence max(p, 1 - p)."""
    return pred.withColumns({"trend": trend(prob, threshold, inclusive=True),
                             "confidence": confidence(prob)})


def day_change(bars: DataFrame) -> DataFrame:
    """intraday change in percent."""
    return bars.withColumn("day_change_pct", day_change_pct("open", "close"))
