"""Hourly sentiment per ticker.

Scale notes: the post-sized input only meets one ``groupBy(ticker, hour)``. Every aggregate is
algebraic (sums, counts, min/max, variance), so Spark combines map-side before the shuffle and a
hot ticker or hot hour costs one partial row per task. The grid and the deltas run on the
(ticker, hour) table, whose size is bounded by the calendar, not by the number of posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.timefn import add_hours, floor_hour, hour_range, roll_weekend

SCORE_COLS = ["p_negative", "p_neutral", "p_positive"]


def hourly_weighted(posts: DataFrame, ticker: str = "ticker", ts: str = "created_at",
                    score: str = "sentiment_score", roll_weekends: bool = True) -> DataFrame:
    """A4 + A5: engagement-weighted hourly means and plain hourly statistics.

    weight = log1p(likes + retweets); when every weight of an hour is 0 the hour takes the plain
    mean. Weekend posts are first moved to Monday 08:00 (F14), then floored to the hour (F15).
    """
    t = roll_weekend(ts) if roll_weekends else F.col(ts)
    base = posts.select(F.col(ticker).alias("ticker"), floor_hour(t).alias("hour"),
                        *hourly_inputs(score))
    return base.groupBy("ticker", "hour").agg(*hourly_aggregates())


def hourly_inputs(score: str = "sentiment_score"):
    """Columns that :func:`hourly_aggregates` reads; shared with the stream."""
    eng = F.coalesce(F.col("likes_count"), F.lit(0)) + F.coalesce(F.col("retweet_count"), F.lit(0))
    return [eng.cast("double").alias("_eng"), F.log1p(eng).alias("_w"),
            *[F.col(c) for c in SCORE_COLS], F.col(score).alias("_s")]


def hourly_aggregates():
    """A4 + A5: the aggregates of one hour."""
    sw = F.sum("_w")
    n = F.count(F.lit(1))

    def wmean(x: str):
        return F.when(sw > 0, F.sum(F.col(x) * F.col("_w")) / sw).otherwise(F.sum(x) / n)

    return [
        wmean("p_negative").alias("p_negative"),
        wmean("p_neutral").alias("p_neutral"),
        wmean("p_positive").alias("p_positive"),
        wmean("_s").alias("mean_sentiment"),
        n.alias("tweet_count"),
        F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias("sentiment_std"),
        F.max("_s").alias("max_sentiment"),
        F.min("_s").alias("min_sentiment"),
        F.sum("_eng").alias("total_engagement"),
        F.avg("_eng").alias("avg_engagement"),
    ]


def ticker_bounds(df: DataFrame, ts: str = "hour", ticker: str = "ticker") -> DataFrame:
    """Per-ticker first and last timestamp (one row per ticker)."""
    return df.groupBy(ticker).agg(F.min(ts).alias("first_hour"), F.max(ts).alias("last_hour"))


def hour_grid(bounds: DataFrame, ticker: str = "ticker") -> DataFrame:
    """every hour between each ticker's bounds, inclusive."""
    return bounds.select(ticker, F.explode(hour_range("first_hour", "last_hour")).alias("hour"))


def _spread_hours(hourly: DataFrame, value_cols) -> DataFrame:
    after = F.lead("hour").over(Window.partitionBy("ticker").orderBy("hour"))
    rows = hourly.withColumn("_to", F.coalesce(add_hours(after, -1), F.col("hour")))
    rows = rows.withColumn("_at", F.explode(hour_range("hour", "_to")))
    own = F.col("_at") == F.col("hour")
    zero = {c: F.lit(0).cast(hourly.schema[c].dataType) for c in value_cols}
    return rows.select(F.col("_at").alias("hour"), "ticker", *[
        F.when(own, F.coalesce(F.col(c), zero[c])).otherwise(zero[c]).alias(c) for c in value_cols])


def fill_hour_grid(hourly: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Left-join the hourly rows onto the full hourly grid and fill the gaps with 0.

    ``bounds`` (ticker, first_hour, last_hour) defaults to each ticker's own first/last hour; then
    every row brings the empty hours up to the next row, and the posts are read once.
    """
    value_cols = [c for c in hourly.columns if c not in ("ticker", "hour")]
    if bounds is None:
        return _spread_hours(hourly, value_cols)
    grid = hour_grid(bounds)
    out = grid.join(hourly, ["ticker", "hour"], "left")
    fills = {c: F.coalesce(F.col(c), F.lit(0).cast(hourly.schema[c].dataType)).alias(c)
             for c in value_cols}
    return out.select("hour", "ticker", *[fills[c] for c in value_cols])


def hourly_deltas(grid: DataFrame) -> DataFrame:
    """Hour-to-hour change of mean_sentiment and tweet_count on the dense grid.

    The first hour of a ticker has no predecessor and gets 0.
    """
    w = Window.partitionBy("ticker").orderBy("hour")
    return grid.withColumns({
        "delta_mean_sentiment": F.coalesce(
            F.col("mean_sentiment") - F.lag("mean_sentiment").over(w), F.lit(0.0)),
        "delta_tweet_count": F.coalesce(
            (F.col("tweet_count") - F.lag("tweet_count").over(w)).cast("double"), F.lit(0.0)),
    })


def hourly_sentiment(posts: DataFrame, **kw) -> DataFrame:
    """The stored hourly table: A4/A5 then the gap-free grid."""
    return fill_hour_grid(hourly_weighted(posts, **kw))
