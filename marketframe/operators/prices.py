"""Price cleaning.

The date bounds are aggregates of the post table (partial aggregation, one row per ticker) and
are joined back onto the bars by ticker; the global bounds are a window over that per-ticker
table, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.schemas import BAR_VALUE_COLUMNS

#: Days fetched before and after a ticker's posts, days kept before the first post.
BEFORE_DAYS, AFTER_DAYS, BUFFER_DAYS = 100, 3, 90
DEFAULT_START = "2015-01-01"
DEFAULT_END = "2020-12-31"


def post_bounds(posts: DataFrame, ticker: str = "ticker", ts: str = "created_at") -> DataFrame:
    """A3: per ticker first/last post time, plus the global first/last over all tickers."""
    per = posts.groupBy(ticker).agg(F.min(ts).alias("first_post"), F.max(ts).alias("last_post"))
    allw = Window.partitionBy()  # over the per-ticker table: one row per ticker
    return per.withColumns({"global_first": F.min("first_post").over(allw),
                            "global_last": F.max("last_post").over(allw)})


def fetch_window(bounds: DataFrame, before_days: int = BEFORE_DAYS, after_days: int = AFTER_DAYS) -> DataFrame:
    """J8 (fetch): per ticker [first - before_days, last + after_days) as dates."""
    return bounds.select(
        "ticker",
        F.date_sub(F.to_date("first_post"), before_days).alias("fetch_start"),
        F.date_add(F.to_date("last_post"), after_days).alias("fetch_end"))


def clean_window(bounds: DataFrame, buffer_days: int = BUFFER_DAYS) -> DataFrame:
    """A3 (clean): [global first - buffer_days, global last], defaults when there are no posts."""
    start = F.col("global_first") - F.make_dt_interval(days=F.lit(buffer_days))
    return bounds.select(
        "ticker",
        F.coalesce(start, F.lit(DEFAULT_START).cast("timestamp_ntz")).alias("clean_start"),
        F.coalesce(F.col("global_last"), F.lit(DEFAULT_END).cast("timestamp_ntz"))
        .alias("clean_end"))


def restrict_bars(bars: DataFrame, posts: DataFrame, ticker: str = "ticker",
                  date: str = "date") -> DataFrame:
    """J8 + P3: keep the bars inside the ticker's fetch window and the global clean window.
    Tickers without posts are not fetched, as in the reference. Without any post there is nothing
    to fetch by, and the default range stands for all tickers.

    The global bounds are one row, aggregated from the per-ticker table (whose shuffle Spark
    reuses) and joined on a constant."""
    per = posts.groupBy(ticker).agg(F.min("created_at").alias("first_post"), F.max("created_at").alias("last_post"))
    whole = per.agg(F.min("first_post").alias("global_first"), F.max("last_post").alias("global_last"))
    one = F.lit(1).alias("_one")
    d = F.col(date).cast("timestamp_ntz")
    start = F.col("global_first") - F.make_dt_interval(days=F.lit(BUFFER_DAYS))
    fetched = ((F.col(date) >= F.date_sub(F.to_date("first_post"), BEFORE_DAYS))
               & (F.col(date) < F.date_add(F.to_date("last_post"), AFTER_DAYS))
               & d.between(start, F.col("global_last")))
    default = d.between(F.lit(DEFAULT_START).cast("timestamp_ntz"), F.lit(DEFAULT_END).cast("timestamp_ntz"))
    rows = bars.join(per, ticker, "left").select("*", one).join(F.broadcast(whole.select("*", one)), "_one")
    return rows.where(F.when(F.col("global_first").isNull(), default).otherwise(fetched)).select(bars.columns)


def fill_gaps(bars: DataFrame, cols=BAR_VALUE_COLUMNS, ticker: str = "ticker",
              date: str = "date", backward: bool = True) -> DataFrame:
    """Forward fill, then backward fill for leading NULLs (``backward=False`` keeps them)."""
    w = Window.partitionBy(ticker).orderBy(date)
    fw = w.rowsBetween(Window.unboundedPreceding, 0)
    bw = w.rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for c in cols:
        f = F.last(c, ignorenulls=True).over(fw)
        out[c] = F.coalesce(f, F.first(c, ignorenulls=True).over(bw)) if backward else f
    return bars.withColumns(out)


def null_count(df: DataFrame, cols=BAR_VALUE_COLUMNS) -> DataFrame:
    """Number of NULLs over a column set."""
    return df.agg(sum(F.sum(F.col(c).isNull().cast("long")) for c in cols).alias("nulls"))
