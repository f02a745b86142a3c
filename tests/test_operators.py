"""Operator formulas against independent numpy/pandas computations on tiny frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions import text as TX
from marketframe.functions.timefn import floor_hour, roll_weekend
from marketframe.operators import hourly as H
from marketframe.operators import indicators as I
from marketframe.operators import metrics as M
from marketframe.operators import samples as S
from marketframe.operators import serving as SV
from marketframe.operators.ema import ema_columns
from marketframe.sources import ingest as IN


def _bars(spark, closes_by_ticker):
    rows = []
    for t, closes in closes_by_ticker.items():
        d0 = dt.date(2020, 1, 1)
        for i, c in enumerate(closes):
            rows.append((t, d0 + dt.timedelta(days=i), float(c), float(c), float(c), float(c),
                         1000.0 + i, float(c)))
    return spark.createDataFrame(
        rows, "ticker string, date date, open double, high double, low double, close double, "
              "volume double, adj_close double")


def test_ema_matches_pandas_ewm(spark):
    rng = np.random.default_rng(7)
    series = {f"T{k}": 100 + np.cumsum(rng.normal(0, 1, 300 + 37 * k)) for k in range(3)}
    df = _bars(spark, series)
    out = ema_columns(df, {"e9": ("close", 9), "e26": ("close", 26)}).toPandas()
    for t, closes in series.items():
        got = out[out.ticker == t].sort_values("date")
        for col, span in (("e9", 9), ("e26", 26)):
            exp = pd.Series(closes).ewm(span=span, adjust=False).mean().to_numpy()
            np.testing.assert_allclose(got[col].to_numpy(), exp, rtol=1e-12)


def test_rsi_edges(spark):
    df = _bars(spark, {"FLAT": [10.0] * 20, "UP": list(range(1, 21))})
    r = {(t, d): v for t, d, v in I.rsi(df).select("ticker", "date", "RSI_14").collect()}
    flat = [v for (t, _), v in sorted(r.items()) if t == "FLAT"]
    up = [v for (t, _), v in sorted(r.items()) if t == "UP"]
    assert all(v is None for v in flat[:13]) and all(v == 0.0 for v in flat[13:])
    assert all(v == 100.0 for v in up[13:])


def test_rolling_needs_full_window(spark):
    df = _bars(spark, {"A": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]})
    got = I.volatility(I.returns(df), (10,)).orderBy("date").select("volatility_10").collect()
    # return at row 0 is NULL, so the first full 10-return window ends at row 10
    assert [g[0] is None for g in got] == [True] * 10 + [False] * 2
    s = pd.Series(range(1, 13), dtype=float)
    exp = s.pct_change().rolling(10).std().to_numpy()
    assert math.isclose(got[10][0], exp[10], rel_tol=1e-12)


def test_weekend_roll_and_hour_floor(spark):
    df = spark.createDataFrame([
        (dt.datetime(2024, 1, 6, 15, 30),),   # Saturday
        (dt.datetime(2024, 1, 7, 23, 59),),   # Sunday
        (dt.datetime(2024, 1, 8, 9, 45),),    # Monday
    ], "ts timestamp_ntz")
    got = [r[0] for r in df.select(floor_hour(roll_weekend("ts"))).collect()]
    assert got == [dt.datetime(2024, 1, 8, 8), dt.datetime(2024, 1, 8, 8),
                   dt.datetime(2024, 1, 8, 9)]


def _posts(spark, rows):
    return spark.createDataFrame(rows, "ticker string, created_at timestamp_ntz, "
                                 "likes_count long, retweet_count long, p_negative double, "
                                 "p_neutral double, p_positive double, sentiment_score double")


def test_hourly_weighted_and_equal_weight_branch(spark):
    h = dt.datetime(2024, 1, 8, 10, 5)
    rows = [("A", h, 3, 0, 0.1, 0.6, 0.3, 0.2), ("A", h, 0, 1, 0.5, 0.4, 0.1, -0.4),
            ("B", h, 0, 0, 0.2, 0.5, 0.3, 0.1), ("B", h, 0, 0, 0.4, 0.4, 0.2, -0.2),
            ("C", h, 5, 5, 0.1, 0.1, 0.8, 0.7)]
    out = {r.ticker: r for r in H.hourly_weighted(_posts(spark, rows)).collect()}
    w = np.log1p([3, 1])
    assert math.isclose(out["A"].mean_sentiment, (0.2 * w[0] - 0.4 * w[1]) / w.sum())
    assert math.isclose(out["B"].mean_sentiment, (0.1 - 0.2) / 2)
    assert out["C"].sentiment_std == 0.0 and out["C"].tweet_count == 1
    assert math.isclose(out["A"].sentiment_std, np.std([0.2, -0.4], ddof=1))


def test_grid_is_dense_and_deltas(spark):
    rows = [("A", dt.datetime(2024, 1, 8, 10), 0, 0, 0.1, 0.8, 0.1, 0.5),
            ("A", dt.datetime(2024, 1, 8, 13), 0, 0, 0.1, 0.8, 0.1, 0.1)]
    g = H.hourly_deltas(H.fill_hour_grid(H.hourly_weighted(_posts(spark, rows))))
    got = g.orderBy("hour").select("tweet_count", "mean_sentiment", "delta_mean_sentiment").collect()
    assert [r[0] for r in got] == [1, 0, 0, 1]
    assert [r[2] for r in got] == [0.0, -0.5, 0.0, 0.1]


def test_grid_repartition_invariant(spark):
    rng = np.random.default_rng(3)
    base = dt.datetime(2024, 1, 1)
    rows = [("A" if i % 3 else "B", base + dt.timedelta(minutes=int(m)), int(k), 0,
             0.1, 0.8, 0.1, float(s))
            for i, (m, k, s) in enumerate(zip(rng.integers(0, 5000, 400),
                                              rng.integers(0, 3, 400), rng.normal(size=400)))]
    p = _posts(spark, rows)
    from marketframe.plans.catalog import rounded
    a = rounded(H.hourly_sentiment(p), 9)   # sums of doubles: compare beyond summation order
    b = rounded(H.hourly_sentiment(p.repartition(7)), 9)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_chrono_split_tie_inside_date(spark):
    rows = [(dt.date(2020, 1, 1), "B"), (dt.date(2020, 1, 1), "A"), (dt.date(2020, 1, 2), "C"),
            (dt.date(2020, 1, 2), "A"), (dt.date(2020, 1, 2), "B")]
    df = spark.createDataFrame(rows, "date date, ticker string")
    got = {(r.date.day, r.ticker): (r.pos, r.split) for r in S.chrono_split(df).collect()}
    # n = 5 -> int(4.0) = 4 train; order (date, ticker)
    assert got[(1, "A")] == (1, "train") and got[(2, "B")] == (4, "train")
    assert got[(2, "C")] == (5, "test")


def test_scaler_equals_exploded_sequences(spark):
    rng = np.random.default_rng(11)
    L = 5
    data = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x), float(y))
            for i, (x, y) in enumerate(zip(rng.normal(size=30), rng.normal(size=30)))]
    rows = spark.createDataFrame(data, "ticker string, date date, f1 double, f2 double")
    ends = [r for r in data[L - 1:]]
    split = spark.createDataFrame([(t, d, "train" if i < 15 else "test")
                                   for i, (t, d, _, _) in enumerate(ends)],
                                  "ticker string, date date, split string")
    wr = S.train_row_weights(rows, split, L)
    stats = {r.feature: r for r in S.scaler_fit(wr, ["f1", "f2"]).collect()}
    arr = np.array([[x, y] for _, _, x, y in data])
    seqs = np.concatenate([arr[i:i + L] for i in range(15)])
    np.testing.assert_allclose(stats["f1"].mean, seqs[:, 0].mean(), rtol=1e-12)
    np.testing.assert_allclose(stats["f2"].scale, seqs[:, 1].std(), rtol=1e-12)
    assert stats["f1"].n == 15 * L


def test_price_samples_need_full_history(spark):
    closes = list(np.linspace(10, 20, 61 + 20))
    rows = S.price_rows(_bars(spark, {"A": closes}))
    assert S.price_sample_keys(rows).count() == 1  # 81 bars - 20 warm-up = 61 rows, 1 sample


def test_text_window_no_leakage_and_zero_padding(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 0) + dt.timedelta(hours=h), 0, 0, 0.1, 0.8, 0.1, 0.2)
            for h in range(0, 200)]
    hourly = H.hourly_weighted(_posts(spark, rows), roll_weekends=False)
    gd = H.hourly_deltas(H.fill_hour_grid(hourly))
    keys = spark.createDataFrame([("A", dt.date(2024, 1, 5), 1,
                                   dt.datetime(2024, 1, 5, 16))],
                                 "ticker string, date date, label int, prediction_time timestamp_ntz")
    long = S.text_window_rows(keys, gd)
    assert long.count() == 72
    w = S.text_windows(keys, gd).collect()[0]
    assert len(w.X) == 72 and all(len(r) == 10 for r in w.X)
    # window = [D 16:00 - 95h, D-1 16:00]; data start 2024-01-01 00:00 = D 16:00 - 112h: all present
    assert w.present_hours == 72
    assert w.X[0][8] == 0.0 and w.X[0][9] == 0.0


def test_text_keys_coverage_rule(spark):
    bars = _bars(spark, {"A": [1, 2, 3, 4, 5, 6]})
    first = spark.createDataFrame([("A", dt.datetime(2020, 1, 2, 0))],
                                  "ticker string, first_hour timestamp_ntz")
    keys = S.text_sample_keys(bars, first).orderBy("date").collect()
    # D 16:00 - 72h >= 2020-01-02 00:00  <=>  D >= 2020-01-05; the last bar (01-06) has no label
    assert [k.date.day for k in keys] == [5]
    bars8 = _bars(spark, {"A": [1, 2, 3, 4, 5, 6, 7, 8]})
    strict = S.text_sample_keys(bars8, first, strict_coverage=True).orderBy("date").collect()
    # D 16:00 - 95h >= 2020-01-02 00:00  <=>  D >= 2020-01-06
    assert [k.date.day for k in strict] == [6, 7]


def test_dedup_keeps_first_and_mapping_last_wins(spark):
    posts = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 5)],
                                  "post_id long, text string, ord long")
    kept = {r.post_id: r.text for r in IN.dedup_first(posts, "post_id", ["ord"]).collect()}
    assert kept == {1: "y", 2: "z"}
    mapping = spark.createDataFrame([(1, "AAA", 0), (1, "BBB", 1), (2, "CCC", 0)],
                                    "post_id long, ticker string, map_order long")
    j = {r.post_id: r.ticker for r in IN.attach_ticker(posts.select("post_id").distinct(),
                                                        mapping).collect()}
    assert j == {1: "BBB", 2: "CCC"}
    j2 = IN.attach_ticker(posts.select("post_id").distinct(), mapping, tickers=["AAA"])
    assert {r.ticker for r in j2.collect()} == {"AAA"}
    both = IN.attach_ticker(posts.select("post_id").distinct(), mapping, multi="all")
    assert both.count() == 3


def test_asof_exact_or_previous(spark):
    series = spark.createDataFrame([("A", dt.date(2020, 1, 2), 1.0), ("A", dt.date(2020, 1, 6), 2.0)],
                                   "ticker string, date date, close double")
    pts = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("A", dt.date(2020, 1, 2)),
                                 ("A", dt.date(2020, 1, 5)), ("A", dt.date(2020, 1, 7))],
                                "ticker string, query_date date")
    got = {r.query_date.day: (r.used_date and r.used_date.day, r.close)
           for r in SV.asof_lookup(pts, series).collect()}
    assert got == {1: (None, None), 2: (2, 1.0), 5: (2, 1.0), 7: (6, 2.0)}


def test_roc_auc_matches_pairwise(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)],
                               "probability double, actual int")
    got = M.roc_auc(df, buckets=4).collect()[0].roc_auc
    assert math.isclose(M.roc_auc(df).collect()[0].roc_auc, got, rel_tol=1e-12)
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (
        len(pos) * len(neg))
    assert math.isclose(got, exp, rel_tol=1e-12)


def test_confusion_rates(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.2, 0), (0.4, 1), (0.5, 1)],
                               "probability double, actual int")
    r = M.confusion(df).collect()[0]
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 2)
    assert math.isclose(r.f1, 2 * 0.5 * (1 / 3) / (0.5 + 1 / 3))
    r2 = M.confusion(df, inclusive=True).collect()[0]
    assert r2.tp == 2


def test_projection_curve(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), c, p) for i, (c, p) in
                                enumerate([(10.0, 0.9), (11.0, 0.2), (10.0, 0.5)])],
                               "ticker string, date date, close double, probability double")
    got = SV.project_prices(df).orderBy("date").collect()
    move = np.mean([abs(11 / 10 - 1), abs(10 / 11 - 1)])
    assert got[0].predicted_close == 10.0
    assert math.isclose(got[1].predicted_close, 10.0 * (1 + move * 0.8))
    assert math.isclose(got[2].predicted_close, 11.0 * (1 - move * 0.6))


def test_last_n_plans_window_group_limit(spark):
    df = _bars(spark, {"A": list(range(1, 50)), "B": list(range(1, 40))})
    q = SV.last_n(df, 5)
    assert q.count() == 10
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2      # partial before the shuffle, final after


CLEAN_CASES = [
    ("RT @alice Great earnings!!! http://x.co/abc #AAPL \U0001F600 to the moon",
     "Great earnings ! ! ! to the moon"),
    ("株価 stock up 上昇 today", "stock up today"),
    ("Café prices rise, buy now", "Café prices rise , buy now"),
    ("send to 0x" + "a" * 40 + " now please ok", "send to now please ok"),
    ("addr 1" + "A" * 30 + " done here", "addr done here"),
    ("Hi there", None),
    ("Hello worldwide", None),
]


@pytest.mark.parametrize("raw,expected", CLEAN_CASES)
def test_clean_text_cases(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(TX.clean_or_null("t")).collect()[0][0]
    assert got == expected


ENGLISH_CASES = [
    ("The stock market is up today", True),
    ("Le marché est en hausse aujourd hui", False),
    ("up", False),
    ("buy!", True),
    ("café the", True),
    (None, False),
]


@pytest.mark.parametrize("raw,expected", ENGLISH_CASES)
def test_english_detector(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(TX.is_english("t")).collect()[0][0] is expected


def test_html_decode(spark):
    df = spark.createDataFrame([("AT&amp;T &lt;3",), ("plain",)], "t string")
    assert [r[0] for r in df.select(TX.html_decode("t")).collect()] == ["AT&T <3", "plain"]
    rows = {r.t: r.d for r in TX.html_decode_rows(df, "t", "d").collect()}
    assert rows == {"AT&amp;T &lt;3": "AT&T <3", "plain": "plain"}


def test_fill_gaps(spark):
    from marketframe.operators.prices import fill_gaps
    df = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), v) for i, v in
                                enumerate([None, None, 3.0, None, 5.0])],
                               "ticker string, date date, close double")
    got = [r.close for r in fill_gaps(df, ["close"]).orderBy("date").collect()]
    assert got == [3.0, 3.0, 3.0, 3.0, 5.0]
    got2 = [r.close for r in fill_gaps(df, ["close"], backward=False).orderBy("date").collect()]
    assert got2 == [None, None, 3.0, 3.0, 5.0]


def test_shape_violations(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([[1.0], [2.0, float("nan")]],)],
                               "X array<array<double>>")
    r = S.shape_violations(df, "X", 2, 2).collect()[0]
    assert (r.samples, r.bad_shape, r.bad_value) == (2, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ticker_filter_reaches_the_scan(spark):
    from conftest import SF_SMALL
    from marketframe.sources import fixtures as FX
    h = H.hourly_weighted(FX.posts(spark, SF_SMALL)).where(F.col("ticker") == "1-URGENT")
    plan = _plan(h)
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    # a filter above the per-ticker windows and the EMA scan is pushed below them too
    ind = I.technical_indicators(FX.bars(spark, SF_SMALL)).where(F.col("ticker") == "2-HIGH")
    assert "EqualTo(o_orderpriority,2-HIGH)" in _plan(ind)


def test_scan_reads_only_needed_columns(spark):
    from conftest import SF_SMALL
    from marketframe.sources import fixtures as FX
    plan = _plan(H.hourly_weighted(FX.posts(spark, SF_SMALL)))
    assert "l_comment" not in plan and "l_receiptdate" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan or \
        "o_totalprice" not in plan


def test_no_single_partition_exchange_on_sample_sized_data(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as E
    qs = E.queries()
    for name in ["price_sequences", "text_windows", "align", "hourly_grid", "dedup_posts",
                 "clean_text", "asof_lookup"]:
        plan = _plan(qs[name](spark, SF_SMALL))
        assert "SinglePartition" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_grid_on_given_bounds(spark):
    rows = [("A", dt.datetime(2024, 1, 8, 10), 0, 0, 0.1, 0.8, 0.1, 0.5)]
    hourly = H.hourly_weighted(_posts(spark, rows))
    bounds = spark.createDataFrame([("A", dt.datetime(2024, 1, 8, 8), dt.datetime(2024, 1, 8, 12))],
                                   "ticker string, first_hour timestamp_ntz, last_hour timestamp_ntz")
    g = H.fill_hour_grid(hourly, bounds).orderBy("hour").collect()      # J7
    assert [r.hour.hour for r in g] == [8, 9, 10, 11, 12]
    assert [r.tweet_count for r in g] == [0, 0, 1, 0, 0]


def test_extra_indicator_columns(spark):
    df = _bars(spark, {"A": list(range(1, 40))})
    out = I.technical_indicators(df, extra={
        "close_ma3": lambda w: F.avg("close").over(w.rowsBetween(-2, 0))})   # X6
    r = out.where(F.col("date") == dt.date(2020, 1, 5)).first()
    assert r.close_ma3 == 4.0 and "MACD_hist" in out.columns


def test_text_partitions_is_a_stated_setting(spark):
    from conftest import SF_SMALL
    from marketframe.session import TEXT_PARTITIONS, text_partitions
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert text_partitions(docs) is docs                              # unset: no shuffle
    spark.conf.set(TEXT_PARTITIONS, "5")
    try:
        assert text_partitions(docs).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(TEXT_PARTITIONS)


def test_hard_inputs_of_metrics_ema_and_text(spark):
    from marketframe.functions.text import not_blank
    from marketframe.operators import metrics as M
    from marketframe.operators.ema import ema

    def auc(rows):
        return M.roc_auc(spark.createDataFrame(rows, "probability double, actual int")).first()

    r = auc([(None, 1), (float("nan"), 0), (0.9, 1), (0.1, 0), (0.2, 0)])
    assert (r.roc_auc, r.positives, r.negatives, r.unranked) == (1.0, 1, 2, 2)
    rng = np.random.default_rng(3)
    for scale in (1e-9, 1.0, 50.0):                                    # concentrated scores, logits
        s, y = rng.normal(size=600) * scale, rng.integers(0, 2, 600)
        s[:50] = s[50:100]                                             # ties
        pos, neg = s[y == 1], s[y == 0]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert math.isclose(auc([(float(a), int(b)) for a, b in zip(s, y)]).roc_auc, want, rel_tol=1e-12)
    gap = _bars(spark, {"A": [1.0, 2.0, 3.0]}).withColumn("close", F.when(F.col("close") != 2, F.col("close")))
    with pytest.raises(Exception, match="fill the gaps first"):
        ema(gap, "close", 10).collect()
    t = spark.createDataFrame([("\n\t",), (" a ",), (None,), ("\u00a0",)], "t string")
    assert [x[0] for x in t.select(not_blank("t")).collect()] == [False, True, False, False]


def test_posts_are_scanned_once(spark):
    from conftest import SF_SMALL
    from marketframe.plans import catalog

    for name, most in (("hourly_grid", 1), ("hourly_delta", 1), ("asof_lookup", 1)):
        df = catalog.QUERIES[name](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("l_shipdate") and sum("FileScan" in x and "lineitem" in x for x in plan.split("\n")) == most, name


def test_bars_without_posts_take_the_default_range(spark):
    from marketframe.operators.prices import restrict_bars
    bars = spark.createDataFrame([("A", dt.date(2014, 1, 1)), ("A", dt.date(2016, 1, 4)), ("B", dt.date(2021, 1, 4))],
                                 "ticker string, date date")
    posts = spark.createDataFrame([], "ticker string, created_at timestamp_ntz")
    assert [r.date for r in restrict_bars(bars, posts).collect()] == [dt.date(2016, 1, 4)]


def test_projection_takes_the_last_aligned_rows_first(spark):
    from marketframe.operators.serving import projection_history
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    pred = spark.createDataFrame([(t, d, 0.6) for t, n in (("A", 40), ("B", 4)) for d in days[:n]],
                                 "ticker string, date date, probability double")
    bars = spark.createDataFrame([(t, d, 1.0) for t in "AB" for d in days if d != days[35]],
                                 "ticker string, date date, close double")
    rows = projection_history(pred, bars).collect()
    assert {r.ticker for r in rows} == {"A"} and len(rows) == 29          # one of the 30 has no price


def test_date_helpers_and_default_range(spark):
    from marketframe.functions.timefn import epoch_to_ts, format_date, parse_date
    from marketframe.operators.prices import clean_window, post_bounds
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")   # must not matter
    try:
        df = spark.createDataFrame([(1420070457, "2020-01-02"), (-1, "bad")],
                                   "e long, s string")
        r = df.select(epoch_to_ts("e").alias("ts"), parse_date("s").alias("d")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert r[0].ts == dt.datetime(2015, 1, 1, 0, 0, 57)
    assert r[1].ts == dt.datetime(1969, 12, 31, 23, 59, 59)
    assert r[0].d == dt.date(2020, 1, 2) and r[1].d is None
    f = spark.createDataFrame([(dt.date(2020, 1, 2),)], "d date").select(format_date("d")).first()
    assert f[0] == "2020-01-02"
    # A3: bounds from posts; the default range applies when a ticker's bounds are missing
    posts = spark.createDataFrame([("A", dt.datetime(2020, 5, 1, 10))],
                                  "ticker string, created_at timestamp_ntz")
    cw = clean_window(post_bounds(posts)).first()
    assert cw.clean_start == dt.datetime(2020, 2, 1, 10) and cw.clean_end == dt.datetime(2020, 5, 1, 10)
    empty = spark.createDataFrame([("A", None, None, None, None)],
                                  "ticker string, first_post timestamp_ntz, last_post timestamp_ntz, "
                                  "global_first timestamp_ntz, global_last timestamp_ntz")
    d = clean_window(empty).first()
    assert (d.clean_start, d.clean_end) == (dt.datetime(2015, 1, 1), dt.datetime(2020, 12, 31))


def test_apply_scaler_matches_long_form(spark):
    rows = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), float(i), float(i * i))
                                  for i in range(6)], "ticker string, date date, f1 double, f2 double")
    stats = spark.createDataFrame([("f1", 2.0, 4.0, 6), ("f2", 1.0, 0.5, 6)],
                                  "feature string, mean double, scale double, n long")
    wide = {r.date.day: r for r in S.apply_scaler(rows, stats, ["f1", "f2"]).collect()}
    for r in S.scale_long(rows, stats, ["f1", "f2"]).collect():
        assert math.isclose(getattr(wide[r.date.day], r.feature), r.value, abs_tol=1e-15)
    with pytest.raises(ValueError):
        S.apply_scaler(rows, stats.where(F.col("feature") == "f1"), ["f1", "f2"])
