"""Technical indicators per ticker (W1-W9, P8, X6) with window functions.

All windows are ``partitionBy(ticker).orderBy(date)`` on the daily bar table, whose size per
ticker is bounded by the calendar (about 252 rows a year), so a hot ticker cannot grow a task.
pandas ``rolling(n)`` yields NULL until n non-null values are in the frame; every rolling
statistic is guarded with ``count(x) over frame = n`` to match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import finite_or_null, safe_div
from marketframe.operators.ema import ema_columns
from marketframe.schemas import PRICE_FEATURES


def _w(ticker: str, date: str):
    return Window.partitionBy(ticker).orderBy(date)


def rolling(fn, x: Column, n: int, w) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def returns(df: DataFrame, close: str = "close", ticker: str = "ticker", date: str = "date"):
    """W1 + W2: simple and log return; division by 0 and log of <= 0 give NULL."""
    w = _w(ticker, date)
    c = F.col(close)
    prev = F.lag(c).over(w)
    return df.withColumns({
        "return_1d": safe_div(c, prev) - 1,
        "log_return_1d": finite_or_null(F.ln(safe_div(c, prev))),
    })


def momentum(df, n: int = 10, close="close", ticker="ticker", date="date"):
    """Close - close n rows earlier."""
    c = F.col(close)
    return df.withColumn(f"momentum_{n}d", c - F.lag(c, n).over(_w(ticker, date)))


def sma(df, windows=(10, 20), close="close", ticker="ticker", date="date"):
    """Simple moving averages."""
    w = _w(ticker, date)
    return df.withColumns({f"SMA_{n}": rolling(F.avg, F.col(close), n, w) for n in windows})


def volatility(df, windows=(10, 20), ret="return_1d", ticker="ticker", date="date"):
    """Sample standard deviation of the daily return."""
    w = _w(ticker, date)
    return df.withColumns({f"volatility_{n}": rolling(F.stddev_samp, F.col(ret), n, w)
                           for n in windows})


def rsi(df, n: int = 14, close="close", ticker="ticker", date="date"):
    """RSI from simple means of gains and losses over n rows; the first change counts as 0.
    Edge order as in the reference: loss = 0 gives 100, then gain = 0 gives 0."""
    w = _w(ticker, date)
    c = F.col(close)
    delta = c - F.lag(c).over(w)
    d = df.withColumns({
        "_gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "_loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
    })
    g = rolling(F.avg, F.col("_gain"), n, w)
    lo = rolling(F.avg, F.col("_loss"), n, w)
    d = d.withColumns({"_ag": g, "_al": lo})
    val = (F.when(F.col("_ag") == 0, F.lit(0.0))
           .when(F.col("_al") == 0, F.lit(100.0))
           .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_div(F.col("_ag"),
                                                                          F.col("_al")))))
    return d.withColumn(f"RSI_{n}", val).drop("_gain", "_loss", "_ag", "_al")


def emas(df, spans=(10, 20), close="close", ticker="ticker", date="date"):
    """EMA columns ``EMA_<span>``."""
    return ema_columns(df, {f"EMA_{s}": (close, s) for s in spans}, ticker, date)


def macd(df, fast: int = 12, slow: int = 26, signal: int = 9, close="close", ticker="ticker",
         date="date", extra_spans=()):
    """MACD = EMA(fast) - EMA(slow); signal = EMA(signal) of MACD; hist = MACD - signal.
    ``extra_spans`` adds ``EMA_<span>`` columns in the same scan pass."""
    specs = {f"_ema_{fast}": (close, fast), f"_ema_{slow}": (close, slow)}
    specs.update({f"EMA_{s}": (close, s) for s in extra_spans})
    d = ema_columns(df, specs, ticker, date, keep_numbering=True)
    d = d.withColumn("MACD", F.col(f"_ema_{fast}") - F.col(f"_ema_{slow}"))
    d = ema_columns(d, {"MACD_signal": ("MACD", signal)}, ticker, date)
    return d.withColumn("MACD_hist", F.col("MACD") - F.col("MACD_signal")).drop(
        f"_ema_{fast}", f"_ema_{slow}")


def bollinger(df, n: int = 20, k: float = 2.0, close="close", ticker="ticker", date="date"):
    """Middle band = SMA(n); bands at +-k sample standard deviations."""
    w = _w(ticker, date)
    c = F.col(close)
    d = df.withColumns({"BB_mid": rolling(F.avg, c, n, w),
                        "_bb_std": rolling(F.stddev_samp, c, n, w)})
    return d.withColumns({
        "BB_upper": F.col("BB_mid") + F.lit(k) * F.col("_bb_std"),
        "BB_lower": F.col("BB_mid") - F.lit(k) * F.col("_bb_std"),
    }).withColumn("BB_width", F.col("BB_upper") - F.col("BB_lower")).drop("_bb_std")


def technical_indicators(bars: DataFrame, ticker: str = "ticker", date: str = "date",
                         extra: dict[str, Callable] | None = None) -> DataFrame:
    """All 23 price features per bar (X6: ``extra`` maps a name to ``f(window) -> Column``).

    Same formulas as the single-indicator functions above, fused into three projections by
    dependency level (window expressions with the same window spec share one Window operator
    and one sort), then the EMA/MACD scan."""
    w = _w(ticker, date)
    c = F.col("close")
    prev = F.lag(c).over(w)
    delta = c - prev
    lvl1 = {
        "log_volume": F.log1p("volume"),
        "return_1d": safe_div(c, prev) - 1,
        "log_return_1d": finite_or_null(F.ln(safe_div(c, prev))),
        "momentum_10d": c - F.lag(c, 10).over(w),
        "SMA_10": rolling(F.avg, c, 10, w),
        "SMA_20": rolling(F.avg, c, 20, w),
        "BB_mid": rolling(F.avg, c, 20, w),
        "_bb_std": rolling(F.stddev_samp, c, 20, w),
        "_gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "_loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
    }
    d = bars.withColumns(lvl1)
    r = F.col("return_1d")
    mid, sd = F.col("BB_mid"), F.col("_bb_std")
    d = d.withColumns({
        "volatility_10": rolling(F.stddev_samp, r, 10, w),
        "volatility_20": rolling(F.stddev_samp, r, 20, w),
        "_ag": rolling(F.avg, F.col("_gain"), 14, w),
        "_al": rolling(F.avg, F.col("_loss"), 14, w),
        "BB_upper": mid + F.lit(2.0) * sd,
        "BB_lower": mid - F.lit(2.0) * sd,
    })
    rsi_val = (F.when(F.col("_ag") == 0, F.lit(0.0))
               .when(F.col("_al") == 0, F.lit(100.0))
               .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_div(F.col("_ag"),
                                                                              F.col("_al")))))
    d = d.withColumns({"RSI_14": rsi_val,
                       "BB_width": F.col("BB_upper") - F.col("BB_lower")}).drop(
        "_bb_std", "_gain", "_loss", "_ag", "_al")
    d = macd(d, 12, 26, 9, extra_spans=(10, 20), ticker=ticker, date=date)
    if extra:
        d = d.withColumns({name: fn(w) for name, fn in extra.items()})
    return d


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a NULL, NaN or +-inf in any of ``cols`` (default: every numeric
    feature plus the key columns), after the indicator warm-up."""
    cols = cols or (["ticker", "date", "volume"] + PRICE_FEATURES)
    cond = F.lit(True)
    for c in cols:
        dt = df.schema[c].dataType.simpleString()
        if dt in ("double", "float"):
            cond = cond & finite_or_null(F.col(c)).isNotNull()
        else:
            cond = cond & F.col(c).isNotNull()
    return df.where(cond)
