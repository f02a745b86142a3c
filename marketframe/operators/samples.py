"""Leakage-free samples.

A sample is one row (ticker, date, label, X): the payload travels with its key, so alignment
is a plain equi-join and no positional index arrays exist.

Scale notes: every window here runs on bar-sized or grid-sized tables (bounded per ticker by
the calendar); the 72-hour text window is three joined 24-hour segments per sample, never a
range join. The chronological split never sorts samples globally: it numbers the distinct dates (a
calendar-sized table) and ranks only inside a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.timefn import add_hours, at_hour, hour_range
from marketframe.operators.indicators import drop_incomplete, technical_indicators
from marketframe.schemas import PRICE_FEATURES, TEXT_DELTA_FEATURES, TEXT_FEATURES


def direction_label(df: DataFrame, close: str = "close", ticker: str = "ticker",
                    date: str = "date", keep_last: bool = False) -> DataFrame:
    """label = 1 when the next row's close is strictly higher; the last row of each ticker
    has no next close and is dropped (unless ``keep_last``)."""
    w = Window.partitionBy(ticker).orderBy(date)
    d = df.withColumn("next_close", F.lead(close).over(w))
    d = d.withColumn("label", (F.col("next_close") > F.col(close)).cast("int"))
    return d if keep_last else d.where(F.col("next_close").isNotNull())


# ------------------------------------------------------------------------------- price side
def price_rows(bars: DataFrame, ticker: str = "ticker", date: str = "date",
               extra=None) -> DataFrame:
    """Indicators (W1-W9), warm-up/NaN rows dropped (P8), then the next-day label (W10) over the
    remaining rows, as the reference labels its post-drop frame."""
    rows = drop_incomplete(technical_indicators(bars, ticker, date, extra))
    return direction_label(rows, "close", ticker, date, keep_last=True)


def price_sequences(rows: DataFrame, length: int = 60, features=PRICE_FEATURES,
                    ticker: str = "ticker", date: str = "date") -> DataFrame:
    """W11 + P9: ``length``-row sequences of the feature rows, stamped with the last row's date;
    only full sequences whose next close exists are samples."""
    w = Window.partitionBy(ticker).orderBy(date).rowsBetween(-(length - 1), 0)
    d = rows.withColumn("X", F.collect_list(F.array(*[F.col(f).cast("double")
                                                       for f in features])).over(w))
    return d.where((F.size("X") == length) & F.col("next_close").isNotNull())


def price_sample_keys(rows: DataFrame, length: int = 60, ticker: str = "ticker",
                      date: str = "date") -> DataFrame:
    """The (ticker, date, label) of every price sample without building X."""
    w = Window.partitionBy(ticker).orderBy(date)
    d = rows.withColumn("_n", F.row_number().over(w))
    return d.where((F.col("_n") >= length) & F.col("next_close").isNotNull()).select(
        ticker, date, "label")


# ------------------------------------------------------------------------------- compact sequences
#: Rows of a segment; a window that ends in it starts at most ``length - 1`` rows before.
SEGMENT = 512


def _numbered(rows: DataFrame, ticker: str, date: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(ticker).orderBy(date)) - 1)


def sequence_segments(rows: DataFrame, length: int = 60, features=PRICE_FEATURES, segment: int = SEGMENT,
                      ticker: str = "ticker", date: str = "date") -> DataFrame:
    """W11 stored compactly: (ticker, segment, rows array<array<float>>). A row is stored once, and once
    more if it belongs to the ``length - 1`` rows before a segment, instead of ``length`` times."""
    if segment < length:
        raise ValueError("a segment holds at least one window")
    mine = F.floor(F.col("_rn") / segment)
    lead = F.col("_rn") % segment > segment - length               # also before the next segment
    row = F.struct("_rn", F.array(*[F.col(f).cast("float") for f in features]).alias("row"))
    d = _numbered(rows, ticker, date).select(
        ticker, row.alias("_row"), (F.col("_rn")).alias("_rn"),
        F.explode(F.when(lead, F.array(mine, mine + 1)).otherwise(F.array(mine))).alias("segment"))
    packed = d.groupBy(ticker, "segment").agg(F.sort_array(F.collect_list("_row")).alias("_rows"),
                                              F.max("_rn").alias("_last"))
    return packed.where(F.col("_last") >= F.col("segment") * segment).select(
        ticker, "segment", F.transform("_rows", lambda r: r["row"]).alias("rows"))


def sequence_places(rows: DataFrame, keys: DataFrame, length: int = 60, features=PRICE_FEATURES,
                    segment: int = SEGMENT, ticker: str = "ticker", date: str = "date") -> DataFrame:
    """The samples ``keys`` (ticker, date and more) with the place of their windows: segment, offset
    and length. Keys without a full window are left out."""
    first = F.greatest(F.col("segment") * segment - (length - 1), F.lit(0))       # row that a segment starts with
    at = _numbered(rows.select(ticker, date), ticker, date).where(F.col("_rn") >= length - 1)
    return (keys.join(at, [ticker, date]).withColumn("segment", F.floor(F.col("_rn") / segment))
            .withColumn("offset", (F.col("_rn") - (length - 1) - first).cast("int"))
            .withColumn("length", F.lit(length)).drop("_rn"))


def sequence_windows(places: DataFrame, segments: DataFrame, ticker: str = "ticker") -> DataFrame:
    """The samples with their windows ``X`` (array<array<float>>), cut out of the segments."""
    x = F.slice("rows", F.col("offset") + 1, F.col("length")).alias("X")
    keep = [c for c in places.columns if c not in ("segment", "offset", "length")]
    return places.join(segments, [ticker, "segment"]).select(*keep, x)


# ------------------------------------------------------------------------------- split
def chrono_split(samples: DataFrame, date: str = "date", tie: str = "ticker",
                 train_frac: float = 0.8) -> DataFrame:
    """The first ``int(n * train_frac)`` samples in (date, tie) order are 'train'.

    Per-date counts are prefix-summed on the distinct-date table, joined back, and the position
    inside a date comes from a window partitioned by date.
    """
    per_date = samples.groupBy(date).agg(F.count(F.lit(1)).alias("_nd"))
    wd = Window.orderBy(date)  # one row per distinct date: calendar-sized
    per_date = per_date.withColumns({
        "_before": F.coalesce(F.sum("_nd").over(
            wd.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_nd").over(
            wd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    d = samples.join(per_date, date)
    pos = F.col("_before") + F.row_number().over(Window.partitionBy(date).orderBy(tie))
    d = d.withColumn("pos", pos)
    n_train = F.floor(F.col("_total") * F.lit(float(train_frac)))
    return d.withColumn("split", F.when(F.col("pos") <= n_train, F.lit("train"))
                        .otherwise(F.lit("test"))).drop("_nd", "_before", "_total")


# ------------------------------------------------------------------------------- scaler
def train_row_weights(rows: DataFrame, split_samples: DataFrame, length: int = 60,
                      ticker: str = "ticker", date: str = "date") -> DataFrame:
    """For each feature row, how many train sequences contain it (the occurrence count of
    the row in the reshaped ``[n*L, f]`` train matrix), without exploding sequences."""
    ends = split_samples.select(ticker, date, (F.col("split") == "train").cast("int")
                                .alias("_is_train_end"))
    d = rows.join(ends, [ticker, date], "left").fillna(0, ["_is_train_end"])
    w = Window.partitionBy(ticker).orderBy(date).rowsBetween(0, length - 1)
    return d.withColumn("weight", F.sum("_is_train_end").over(w)).drop("_is_train_end")


def scaler_fit(weighted_rows: DataFrame, features=PRICE_FEATURES, ticker: str = "ticker",
               date: str = "date") -> DataFrame:
    """Per-feature mean and population std over every train row x timestep (weights from
    W12); zero variance -> scale 1. One scan: rows of equal weight (1 to the sequence length) share a
    mergeable (count, mean, squared deviations) a feature, and these few rows are merged exactly, by
    the deviations of their means."""
    w = F.col("weight")
    moments = []
    for f in features:
        moments += [F.avg(F.col(f).cast("double")).alias(f"_m_{f}"), F.var_pop(F.col(f).cast("double")).alias(f"_v_{f}")]
    parts = weighted_rows.where(w > 0).groupBy(w.alias("_w")).agg(F.count(F.lit(1)).alias("_n"), *moments)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_m_{f}").alias("m"),
                                        F.col(f"_v_{f}").alias("v")) for f in features]))
    per = parts.select((F.col("_w") * F.col("_n")).alias("c"), each.alias("e")).groupBy("e.feature").agg(
        F.sum("c").alias("n"), F.collect_list(F.struct("c", "e.m", "e.v")).alias("parts"))
    total = lambda fn: F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["c"] * fn(p)) / F.col("n")
    per = per.withColumn("mean", total(lambda p: p["m"]))
    std = F.sqrt(total(lambda p: p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    return per.select("feature", "mean", F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"),
                      F.col("n").cast("long").alias("n"))


def scale_long(rows: DataFrame, stats: DataFrame, features=PRICE_FEATURES,
               ticker: str = "ticker", date: str = "date") -> DataFrame:
    """F24 in long form: (ticker, date, feature, value) with (x - mean) / scale."""
    long = rows.select(ticker, date, *[F.col(f).cast("double").alias(f) for f in features]) \
        .unpivot([ticker, date], list(features), "feature", "x")
    return (long.join(F.broadcast(stats.select("feature", "mean", "scale")), "feature")
            .select(ticker, date, "feature",
                    ((F.col("x") - F.col("mean")) / F.col("scale")).alias("value")))


def apply_scaler(rows: DataFrame, stats: DataFrame, features=PRICE_FEATURES,
                 ticker: str = "ticker", date: str = "date") -> DataFrame:
    """scale the day rows with train parameters (before W11, which is equivalent to scaling
    the sequences element-wise) as one projection.

    The fitted parameters are one (mean, scale) pair per feature -- a table whose size is the
    feature count, not the data -- so, as Spark ML's ``StandardScalerModel`` does, they are
    brought to the driver (size checked) and applied as literals: no shuffle of the rows."""
    features = list(features)
    params = stats.select("feature", "mean", "scale").limit(len(features) + 1).collect()
    if len(params) != len(features) or {p.feature for p in params} != set(features):
        raise ValueError(f"scaler parameters do not match the features: {len(params)} rows")
    by = {p.feature: p for p in params}
    return rows.withColumns({
        f: (F.col(f).cast("double") - F.lit(float(by[f].mean))) / F.lit(float(by[f].scale))
        for f in features})


# ------------------------------------------------------------------------------- text side
def text_sample_keys(bars: DataFrame, first_hours: DataFrame, prediction_hour: int = 16,
                     coverage_hours: int = 72, ticker: str = "ticker", date: str = "date",
                     strict_coverage: bool = False, hours: int = 72,
                     lag_hours: int = 24) -> DataFrame:
    """W10 on the raw bars + P10: a (ticker, date) is a text sample when the next close exists and
    ``date prediction_hour:00 - coverage_hours`` is not before the ticker's first hour.

    The reference checks 72 h back although its window starts 95 h back, so early windows can
    be zero-padded; ``strict_coverage=True`` requires the whole window to start at or after the
    first hour instead."""
    lab = direction_label(bars.select(ticker, date, "close"), "close", ticker, date)
    t = at_hour(F.col(date), prediction_hour)
    back = (lag_hours + hours - 1) if strict_coverage else coverage_hours
    return (lab.join(first_hours, ticker)
            .where(add_hours(t, -back) >= F.col("first_hour"))
            .select(ticker, date, "label", t.alias("prediction_time")))


def text_window_rows(keys: DataFrame, grid_deltas: DataFrame, hours: int = 72,
                     lag_hours: int = 24, ticker: str = "ticker",
                     date: str = "date") -> DataFrame:
    """J5 + W14 in long form: one row per (sample, window hour) with the 10 features; absent
    hours are zeros and the deltas are forced to 0 at the window start (W13 on the grid)."""
    end = add_hours(F.col("prediction_time"), -lag_hours)
    start = add_hours(F.col("prediction_time"), -(lag_hours + hours - 1))
    ex = keys.select(ticker, date, "label",
                     F.posexplode(hour_range(start, end)).alias("pos", "hour"))
    feats = TEXT_FEATURES + TEXT_DELTA_FEATURES
    g = grid_deltas.select(ticker, "hour", F.lit(1).alias("_present"),
                           *[F.col(f).cast("double").alias(f) for f in feats])
    j = ex.join(g, [ticker, "hour"], "left")
    vals = {f: F.coalesce(F.col(f), F.lit(0.0)) for f in TEXT_FEATURES}
    vals.update({f: F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.col(f), F.lit(0.0))) for f in TEXT_DELTA_FEATURES})
    return j.select(ticker, date, "label", "pos",
                    F.coalesce("_present", F.lit(0)).alias("present"),
                    *[vals[f].alias(f) for f in feats])


def text_windows(keys: DataFrame, grid_deltas: DataFrame, hours: int = 72,
                 lag_hours: int = 24, ticker: str = "ticker", date: str = "date",
                 prediction_hour: int = 16) -> DataFrame:
    """J5 + W14: the ``hours`` hourly rows ending ``lag_hours`` before the prediction time as one
    ``X`` array per sample (time-ordered).

    Windows of whole days are built from 24-hour segments that end at the window's last hour of
    day: the grid is grouped once into segments (absent hours are zeros in their place) and each
    sample joins ``hours / 24`` of them. Other lengths are grouped hour by hour from
    :func:`text_window_rows`."""
    feats = TEXT_FEATURES + TEXT_DELTA_FEATURES
    if hours % 24:
        j = text_window_rows(keys, grid_deltas, hours, lag_hours, ticker, date)
        agg = j.groupBy(ticker, date, "label").agg(
            F.sort_array(F.collect_list(F.struct("pos", F.array(*feats).alias("row")))).alias("_rows"),
            F.sum("present").alias("present_hours"))
        return agg.select(ticker, date, "label", "present_hours",
                          F.transform("_rows", lambda r: r["row"]).alias("X"))
    shift = 23 - (prediction_hour - lag_hours) % 24            # moves a segment onto one calendar day
    moved = add_hours(F.col("hour"), shift)
    row = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats])
    zero = F.array(*[F.lit(0.0)] * len(feats))
    segments = (grid_deltas.groupBy(ticker, F.to_date(moved).alias("_day"))
                .agg(F.map_from_entries(F.collect_list(F.struct(F.hour(moved), row))).alias("_at"),
                     F.count(F.lit(1)).alias("_n")))
    whole = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(
        F.try_element_at("_at", i), zero))
    segments = segments.select(ticker, "_day", whole.alias("_rows"), "_n")
    days = hours // 24
    last = F.to_date(add_hours(F.col("prediction_time"), shift - lag_hours))
    wanted = keys.select(ticker, date, "label", last.alias("_last"),
                         F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_k"))
    wanted = wanted.select(ticker, date, "label", "_k",
                           F.date_sub("_last", F.lit(days - 1) - F.col("_k")).alias("_day"))
    j = wanted.join(segments, [ticker, "_day"], "left")
    empty = F.array_repeat(zero, 24)
    agg = j.groupBy(ticker, date, "label").agg(
        F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_rows", empty).alias("rows")))).alias("_parts"),
        F.sum(F.coalesce("_n", F.lit(0))).alias("present_hours"))
    x = F.flatten(F.transform("_parts", lambda r: r["rows"]))
    n = len(TEXT_FEATURES)
    first = F.concat(F.slice(F.get("_x", F.lit(0)), 1, n), F.array(*[F.lit(0.0)] * len(TEXT_DELTA_FEATURES)))
    return agg.withColumn("_x", x).select(
        ticker, date, "label", "present_hours",
        F.concat(F.array(first), F.slice("_x", 2, hours - 1)).alias("X"))


def text_first_hours(hourly: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Per-ticker first hour of the hourly table (the coverage bound of P10)."""
    return hourly.groupBy(ticker).agg(F.min("hour").alias("first_hour"))


def shape_violations(samples: DataFrame, x_col: str = "X", length: int = 60,
                     n_features: int = len(PRICE_FEATURES)) -> DataFrame:
    """samples whose window is not ``length`` x ``n_features`` or holds NaN/inf
    (the reference asserts on tensor shapes); one row with the violation counts."""
    x = F.col(x_col)
    bad_shape = (F.size(x) != length) | ~F.forall(x, lambda r: F.size(r) == n_features)
    bad_value = F.exists(x, lambda r: F.exists(r, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    return samples.agg(F.count(F.lit(1)).alias("samples"),
                       F.count_if(bad_shape).alias("bad_shape"),
                       F.count_if(bad_value).alias("bad_value"))
