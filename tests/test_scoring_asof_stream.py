"""X1 over one column, X3 on both sides, bucketed as-of lookup, one-pass moments, stream dedup."""

import datetime as dt
import os
import random
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketframe.operators import samples as S
from marketframe.operators import scoring as SC
from marketframe.operators.serving import asof_lookup
from marketframe.sources import fixtures as FX


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scorer_gets_the_text_column_only(spark):
    class Fake:                                   # defined here so that it is shipped by value
        labels = ["negative", "neutral", "positive"]

        def __call__(self, texts):
            return np.array([[.2, .3, .5] if "good" in t else [.6, .3, .1] for t in texts])

    df = spark.createDataFrame([(i, t, "x" * 9, 1.5) for i, t in enumerate(["good day", "bad day", " ", None] * 30)],
                               "post_id long, cleaned_text string, extra string, p_extra double")
    for kw in ({"make_scorer": Fake}, {"model": Fake()}):
        out = SC.score_text(df, batch_size=7, **kw)
        assert out.columns == df.columns + SC.SCORE_COLS
        lines = [x for x in _plan(out).split("\n") if "ArrowEvalPython" in x]
        assert len(lines) == 1 and lines[0].count("probabilities(") == 1      # one call, one argument
        got = {r.post_id: r for r in out.collect()}
        assert len(got) == 60
        for i, r in got.items():
            want = (.2, .3, .5) if i % 4 == 0 else (.6, .3, .1)
            assert (r.p_negative, r.p_neutral, r.p_positive) == want and r.extra == "x" * 9
            assert abs(r.sentiment_score - (want[2] - want[0])) < 1e-12
    assert SC.score_text(df.limit(0), make_scorer=Fake).count() == 0


def test_fused_scores_use_both_windows(spark):
    rng = np.random.default_rng(1)
    text = [(f"T{i % 3}", dt.date(2020, 1, 1 + i), i % 2, rng.normal(size=(4, 2)).tolist()) for i in range(9)]
    price = [(t, d, lab, rng.normal(size=(3, 5)).tolist()) for t, d, lab, _ in text[::2]]
    ddl = "ticker string, date date, label int, X array<array<double>>"
    a, b = [.5, -1, 2, 0, .25], [1, -.5]
    out = SC.score_fused(spark.createDataFrame(text, ddl), spark.createDataFrame(price, ddl),
                         SC.late_fusion(a, b, .1), 4, 2, 3, 5).collect()
    prices = {(t, d): np.array(x) for t, d, _, x in price}
    assert len(out) == 9
    for r in out:
        x = next(np.array(v[3]) for v in text if v[:2] == (r.ticker, r.date))
        p = prices.get((r.ticker, r.date), np.zeros((3, 5)))
        z = p.mean(axis=0) @ np.array(a) + x.mean(axis=0) @ np.array(b) + .1
        assert abs(r.probability - 1 / (1 + np.exp(-z))) < 1e-9 and r.has_price == ((r.ticker, r.date) in prices)


def test_scaler_fit_is_one_scan_and_exact(spark, tmp_path):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=500).date,
                        "a": 1e9 + rng.normal(size=500), "b": rng.normal(size=500), "c": 3.0,
                        "weight": rng.integers(0, 61, 500)})
    spark.createDataFrame(pdf).repartition(5).write.parquet(str(tmp_path / "rows"))
    fit = S.scaler_fit(spark.read.parquet(str(tmp_path / "rows")), features=["a", "b", "c"])
    assert _plan(fit).count("FileScan") == 1
    got = {r.feature: r for r in fit.collect()}
    for f in "abc":
        x = np.repeat(pdf[f].to_numpy(), pdf.weight)
        assert abs(got[f]["mean"] - x.mean()) < 1e-9 * abs(x.mean()) + 1e-12
        assert abs(got[f].scale - (x.std() or 1.0)) < 1e-6 and got[f].n == len(x)
    assert S.scaler_fit(spark.read.parquet(str(tmp_path / "rows")).where("weight < 0"), features=["a"]).count() == 0


def test_asof_over_hours_and_a_long_gap(spark):
    rng = random.Random(4)
    start = dt.datetime(2005, 3, 1)
    times = [start + dt.timedelta(hours=rng.randrange(2000)) for _ in range(150)]
    times += [dt.datetime(2016, 1, 1) + dt.timedelta(hours=rng.randrange(500)) for _ in range(40)]
    series = [(t, x, float(i)) for i, (t, x) in enumerate((rng.choice("AB"), x) for x in sorted(set(times)))]
    points = [(rng.choice("ABC"), x + dt.timedelta(hours=rng.randrange(-3000, 3000), seconds=rng.randrange(3600)))
              for x in times for _ in range(3)]
    points += [("A", dt.datetime(2010, 6, 6, 6)), ("A", dt.datetime(2031, 1, 1)), ("B", dt.datetime(1999, 1, 1)),
               ("A", None), (None, start), ("A", series[0][1])] * 2
    s = spark.createDataFrame(series + [("A", None, 9.0)], "ticker string, ts timestamp_ntz, close double")
    p = spark.createDataFrame(points, "ticker string, at timestamp_ntz")
    for days in (64, 3):
        out = asof_lookup(p, s, point_date="at", date="ts", bucket_days=days)
        got = sorted(((r.ticker, r.at, r.used_date, r.close) for r in out.collect()), key=repr)
        want = []
        for t, at in points:
            before = [x for x in series if at is not None and x[0] == t and x[1] <= at]
            want.append((t, at, before[-1][1], before[-1][2]) if before else (t, at, None, None))
        assert got == sorted(want, key=repr)


def test_asof_gap_costs_few_rows(spark):
    """Ten years between two hourly rows: a row a bucket, not one a day or hour."""
    s = spark.createDataFrame([("A", dt.datetime(2005, 1, 1), 1.0), ("A", dt.datetime(2015, 1, 1), 2.0)],
                              "ticker string, ts timestamp_ntz, close double")
    p = spark.createDataFrame([("A", dt.datetime(2009, 1, 1, 5))], "ticker string, at timestamp_ntz")
    out = asof_lookup(p, s, point_date="at", date="ts")
    assert out.first().close == 1.0
    made = out._jdf.queryExecution().executedPlan()
    rows = [int(x) for x in _metric(made, "GenerateExec", "numOutputRows")]
    assert not rows or max(rows) < 70


def _metric(node, kind, name):
    found = []
    if node.getClass().getSimpleName() == kind:
        m = node.metrics().get(name)
        if m.isDefined():
            found.append(m.get().value())
    children = node.children()
    for i in range(children.size()):
        found += _metric(children.apply(i), kind, name)
    return found


def test_post_sent_again_counts_once_across_runs(spark):
    from marketframe.operators import hourly as H
    from marketframe.plans.catalog import rounded
    from marketframe.streaming.hourly import run_hourly_stream
    src, sink, ck = (os.path.join(tempfile.mkdtemp(prefix="mf-test-"), x) for x in ("posts", "hourly", "ck"))
    schema = ("post_id long, ticker string, created_at timestamp_ntz, likes_count long, retweet_count long, "
              "p_negative double, p_neutral double, p_positive double, sentiment_score double")

    def batch(day, n, ids=0):
        base = dt.datetime(2024, 1, day, 9)
        return spark.createDataFrame([(ids + i, "A", base + dt.timedelta(minutes=7 * i), i % 3, 0, .1, .6, .3, .2)
                                      for i in range(n)], schema)

    first = batch(2, 40)
    first.write.mode("append").parquet(src)
    run_hourly_stream(spark, src, first.schema, sink, checkpoint=ck)
    first.where("post_id < 25").union(first.where("post_id > 30")).write.mode("append").parquet(src)   # sent again
    run_hourly_stream(spark, src, first.schema, sink, checkpoint=ck)
    batch(9, 10, 1000).write.mode("append").parquet(src)
    run_hourly_stream(spark, src, first.schema, sink, checkpoint=ck)
    got, want = spark.read.parquet(sink), H.hourly_weighted(first)
    assert got.count() == want.count()
    assert rounded(got.select(*want.columns), 9).exceptAll(rounded(want, 9)).count() == 0


def test_stream_without_ids_is_unchanged(spark):
    from marketframe.streaming.hourly import hourly_sentiment_stream
    posts = FX.posts(spark, SF_SMALL).select("ticker", "created_at", "likes_count", "retweet_count", "p_negative",
                                             "p_neutral", "p_positive", "sentiment_score")
    assert hourly_sentiment_stream(posts).where(F.col("tweet_count") > 0).count() > 0
