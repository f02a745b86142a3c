"""Sources/sinks (S1-S11), pluggable scorer (X1/X2), batch inference (X3), classifier (X4) and
the streaming hourly aggregation."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketframe.operators import hourly as H
from marketframe.operators import scoring as SC
from marketframe.sources import files as FS
from marketframe.sources import fixtures as FX


def _tmp():
    return tempfile.mkdtemp(prefix="mf-test-")


def test_posts_csv_ingest_skips_malformed_and_dedups(spark):
    d = _tmp()
    with open(os.path.join(d, "posts.csv"), "w") as f:
        f.write("tweet_id,writer,post_date,body,comment_num,retweet_num,like_num\n")
        f.write('550441509175443456,alice,1420070457,"Buy AAPL now, strong\nquarter",0,1,2\n')
        f.write("550441509175443457,bob,notanumber,bad row,0,0,0\n")
        f.write("550441509175443456,alice,1420070999,duplicate id,0,0,0\n")
        f.write("550441509175443458,carol,1420071000,unmapped,1,1,1\n")
    with open(os.path.join(d, "map.csv"), "w") as f:
        f.write("tweet_id,ticker_symbol\n550441509175443456,GOOG\n550441509175443456,AAPL\n")
        f.write("550441509175443457,MSFT\n")
    out = FS.ingest_posts(spark, os.path.join(d, "posts.csv"), os.path.join(d, "map.csv"))
    rows = out.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.post_id == "550441509175443456" and r.ticker == "AAPL"   # id kept as string
    assert r.text.startswith("Buy AAPL now") and "\n" in r.text       # multi-line body
    assert r.created_at == dt.datetime(2015, 1, 1, 0, 0, 57)           # UTC wall clock
    assert (r.likes_count, r.retweet_count) == (2, 1)


def test_read_bars_normalises_and_defaults_adj_close(spark):
    d = _tmp()
    p = os.path.join(d, "bars.csv")
    with open(p, "w") as f:
        f.write("Ticker,Date,Open,High,Low,Close,Volume\nAAPL,2020-01-02,1,2,0.5,1.5,100\n"
                "AAPL,bad-date,1,2,0.5,1.6,100\n")
    b = FS.read_bars(spark, p, fmt="csv").orderBy("close").collect()
    assert b[0].date == dt.date(2020, 1, 2) and b[0].adj_close == 1.5
    assert b[1].date is None


def test_partial_overwrite_keeps_other_tickers(spark):
    d = os.path.join(_tmp(), "bars")
    b = FX.bars(spark, SF_SMALL)
    FS.write_table(b, d, "ticker")
    n_before = spark.read.parquet(d).count()
    one = b.where(F.col("ticker") == "1-URGENT").limit(3)
    FS.replace_tickers(one, d)
    after = spark.read.parquet(d)
    assert after.where(F.col("ticker") == "1-URGENT").count() == 3
    others = b.where(F.col("ticker") != "1-URGENT").count()
    assert after.count() == others + 3 and n_before > after.count()
    FS.write_table(one, d, "ticker")              # S6: a full overwrite drops the other tickers
    assert spark.read.parquet(d).count() == 3


def test_sample_archive_roundtrip(spark):
    d = os.path.join(_tmp(), "samples")
    s = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1, "train", [[1.0, 2.0]]),
                               (dt.date(2020, 1, 2), "A", 0, "test", [[3.0, 4.0]])],
                              "date date, ticker string, label int, split string, "
                              "X array<array<double>>")
    FS.write_samples(s, d)
    assert FS.read_samples(spark, d, "test").count() == 1
    assert FS.read_samples(spark, d).count() == 2
    FS.write_predictions_csv(s.select("date", "ticker", "label"), os.path.join(d, "pred"))


def test_pluggable_scorer_and_label_check(spark):
    # defined inside the test so cloudpickle ships it by value to the Python workers
    class _FakeScorer:
        labels = ["negative", "neutral", "positive"]

        def __call__(self, texts):
            return np.array([[0.2, 0.3, 0.5] if "good" in t else [0.6, 0.3, 0.1]
                             for t in texts])

    df = spark.createDataFrame([(1, "good day"), (2, "bad day"), (3, "   ")],
                               "post_id long, cleaned_text string")
    out = {r.post_id: r for r in SC.score_text(df, make_scorer=_FakeScorer).collect()}
    assert set(out) == {1, 2}                       # blank text dropped (P5)
    assert abs(out[1].sentiment_score - 0.3) < 1e-12
    with pytest.raises(ValueError):
        SC.check_label_order(["positive", "neutral", "negative"])


def test_lexicon_scores_are_probabilities(spark):
    df = spark.createDataFrame([(1, "strong rally and profit"), (2, "crash and loss")],
                               "post_id long, cleaned_text string")
    rows = {r.post_id: r for r in SC.score_text(df).collect()}
    for r in rows.values():
        assert abs(r.p_negative + r.p_neutral + r.p_positive - 1) < 1e-12
    assert rows[1].sentiment_score > 0 > rows[2].sentiment_score


def test_batch_sequence_inference(spark):
    def _mean_last_row(length):
        def make():
            import numpy as np

            def predict(x):
                x = x.reshape(len(x), -1, length)
                return 1 / (1 + np.exp(-x[:, -1, :].mean(axis=1)))
            return predict
        return make

    df = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 1.0]]), (2, [[0.0, 0.0], [-1.0, -1.0]])],
                               "id long, X array<array<double>>")
    out = {r.id: r.probability for r in
           SC.score_sequences(df, _mean_last_row(2), ["X"], [[4]]).collect()}
    assert abs(out[1] - 1 / (1 + np.exp(-1))) < 1e-6 and out[2] < 0.5


def test_classifier_fits_and_predicts(spark):
    from marketframe.operators import classifier as C
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.1 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), "A", int(l),
                                 float(a), float(b)) for i, ((a, b), l) in enumerate(zip(x, y))],
                               "date date, ticker string, label int, f0 double, f1 double")
    model = C.fit_direction_model(df, ["f0", "f1"])
    pred = C.predict_direction(model, df)
    acc = pred.select(F.avg((F.col("predicted") == F.col("actual")).cast("double"))).first()[0]
    assert acc > 0.9


def test_streaming_hourly_matches_batch(spark):
    from marketframe.streaming.hourly import run_hourly_stream
    src, sink = os.path.join(_tmp(), "posts"), os.path.join(_tmp(), "hourly")
    posts = FX.posts(spark, SF_SMALL).select(
        "ticker", "created_at", "likes_count", "retweet_count", "p_negative", "p_neutral",
        "p_positive", "sentiment_score")
    posts.write.parquet(src)
    run_hourly_stream(spark, src, posts.schema, sink, checkpoint=os.path.join(_tmp(), "ck"))
    got = spark.read.parquet(sink)
    batch = H.hourly_weighted(posts)
    assert got.count() > 0
    # every emitted (final) hour equals the batch result
    from marketframe.plans.catalog import rounded
    diff = rounded(got.select(*batch.columns), 9).exceptAll(rounded(batch, 9))
    assert diff.count() == 0


def test_small_helpers(spark):
    from marketframe.operators import fusion as FU
    from marketframe.operators import metrics as M
    from marketframe.operators.prices import null_count
    from marketframe.sources.ingest import append_new
    stored = spark.createDataFrame([(1, "a")], "post_id long, text string")
    new = spark.createDataFrame([(1, "dup"), (2, "b"), (2, "b2")], "post_id long, text string")
    added = append_new(stored, new, "post_id", ["text"]).collect()
    assert [(r.post_id, r.text) for r in added] == [(2, "b")]          # S8 append
    tr = spark.createDataFrame([(1, "train")], "id long, split string")
    te = spark.createDataFrame([(2, "test", 0.5)], "id long, split string, extra double")
    assert FU.union_splits(tr, te).count() == 2                          # U2
    al = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "label_price int, label_text int")
    a = FU.agreement(al).collect()[0]
    assert (a.aligned, a.agreeing) == (3, 2)                             # P7 report
    arr = spark.createDataFrame([([1.0], None)], "a array<double>, b array<double>")
    assert arr.select(FU.concat_or_zeros("a", "b", 2)).first()[0] == [1.0, 0.0, 0.0]  # F25
    nn = spark.createDataFrame([(None, 1.0), (None, None)], "open double, close double")
    assert null_count(nn, ["open", "close"]).first().nulls == 3          # A8
    pr = spark.createDataFrame([(0.9, 1), (0.6, 0)], "probability double, actual int")
    assert M.accuracy(pr).first().accuracy == 0.5                        # A13


def test_scaler_sink_and_pruned_read(spark):
    d = _tmp()
    stats = spark.createDataFrame([("close", 1.0, 2.0, 10)], "feature string, mean double, "
                                  "scale double, n long")
    FS.write_scaler(stats, os.path.join(d, "scaler"))                    # S10
    back = FS.read_table(spark, os.path.join(d, "scaler"), ["feature", "scale"])   # S5
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<feature:string,scale:double>" in plan
    assert back.first().scale == 2.0


def test_mlp_classifier(spark):
    from marketframe.operators import classifier as C
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), "A", int(l),
                                 float(a), float(b)) for i, ((a, b), l) in enumerate(zip(x, y))],
                               "date date, ticker string, label int, f0 double, f1 double")
    model = C.fit_direction_model(df, ["f0", "f1"], kind="mlp", max_iter=50)
    pred = C.predict_direction(model, df)
    assert pred.count() == 120
    p = pred.select(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_streaming_is_incremental_across_runs(spark):
    from marketframe.streaming.hourly import run_hourly_stream
    src, sink, ck = (os.path.join(_tmp(), x) for x in ("posts", "hourly", "ck"))
    schema = ("ticker string, created_at timestamp_ntz, likes_count long, retweet_count long, "
              "p_negative double, p_neutral double, p_positive double, sentiment_score double")

    def batch(day, n):
        base = dt.datetime(2024, 1, day, 9)
        return spark.createDataFrame(
            [("A", base + dt.timedelta(minutes=7 * i), i % 3, 0, 0.1, 0.6, 0.3, 0.2)
             for i in range(n)], schema)

    b1 = batch(2, 40)                      # Tuesday 2024-01-02
    b1.write.mode("append").parquet(src)
    run_hourly_stream(spark, src, b1.schema, sink, checkpoint=ck)
    first = spark.read.parquet(sink).count() if os.path.exists(sink) else 0
    assert first == 0                      # watermark (3 days) has not passed these hours yet

    b2 = batch(9, 10)                      # a week later: earlier hours become final
    b2.write.mode("append").parquet(src)
    run_hourly_stream(spark, src, b1.schema, sink, checkpoint=ck)   # resumes from checkpoint
    got = spark.read.parquet(sink)
    exp = H.hourly_weighted(b1)            # every hour of batch 1, computed once, appended once
    from marketframe.plans.catalog import rounded
    assert got.count() == exp.count()
    assert rounded(got.select(*exp.columns), 9).exceptAll(rounded(exp, 9)).count() == 0


def test_partitioned_write_is_rebalanced(spark):
    b = FX.bars(spark, SF_SMALL)
    plan = FS._rebalanced(b, ["ticker"])._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


def test_model_selection_on_train_tail(spark):
    from marketframe.operators import classifier as C
    from marketframe.operators.samples import chrono_split
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 2))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), "A", int(l),
                                 float(a), float(b)) for i, ((a, b), l) in enumerate(zip(x, y))],
                               "date date, ticker string, label int, f0 double, f1 double")
    train = chrono_split(df).where(F.col("split") == "train")
    model, scores = C.select_direction_model(train, ["f0", "f1"],
                                             candidates=(("logistic", 0.0), ("logistic", 1.0)))
    assert set(scores) == {("logistic", 0.0), ("logistic", 1.0)}
    assert max(scores.values()) > 0.8
    assert C.predict_direction(model, df).count() == 160


def _csv(folder, name, head, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(head + "\n" + "\n".join(rows) + "\n")


def test_file_order_decides_even_if_the_first_file_is_small(spark):
    head = "tweet_id,writer,post_date,body,comment_num,retweet_num,like_num"
    d, m = _tmp(), _tmp()
    _csv(d, "a.csv", head, ["7,x,1420070457,first,0.0,1.0,3.0"])
    _csv(d, "b.csv", head, ["7,x,1420070458,second,0,1,4"] + [f"{i},x,1420070457,more text here,0,0,0" for i in range(100, 4000)])
    _csv(m, "a.csv", "tweet_id,ticker_symbol", ["7,OLD"])
    _csv(m, "b.csv", "tweet_id,ticker_symbol", ["7,NEW"] + [f"{i},ABC" for i in range(100, 4000)])
    out = FS.ingest_posts(spark, d, m)
    assert out.count() == 3901
    r = out.where("post_id = '7'").first()
    assert (r.text, r.likes_count, r.ticker) == ("first", 3, "NEW")    # 3.0 is kept; last mapping wins


def test_noisy_csv_rows_are_dealt_out_in_order(spark):
    """Nearly all rows share a line number: no task holds more than its share of them."""
    folder, n = _tmp(), 4000
    i = F.col("id")
    spark.range(n).select(
        (i * 7919 % n).alias("l_orderkey"), F.when(i < 40, 2).otherwise(1).alias("l_linenumber"), (i % 97).alias("l_partkey"),
        (i % 13).alias("l_suppkey"), F.lit("2020-01-02").cast("date").alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in (FX.noisy_posts(spark, folder), FX.noisy_mapping(spark, folder)):
            parts = rows.rdd.glom().map(lambda part: [int(r.tweet_id) for r in part]).collect()
            ids = [x for part in parts for x in part]
            late = {k * 7919 % n for k in range(40)}            # the ids of line 2
            assert max(map(len, parts)) < len(ids) / 3 and ids == sorted(ids, key=lambda x: (x in late, x))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_append_sink_ignores_stored_ids(spark):
    path = os.path.join(_tmp(), "posts")
    rows = lambda *r: spark.createDataFrame(r, "post_id long, text string, n int")
    FS.append_posts(rows((1, "a", 1), (1, "b", 0), (2, "c", 5)), path, order=["n"])
    FS.append_posts(rows((2, "again", 1), (3, "d", 1)), path, order=["n"])
    got = {r.post_id: r.text for r in spark.read.parquet(path).collect()}
    assert got == {1: "b", 2: "c", 3: "d"}


def test_bars_reader_keeps_rows_with_unreadable_values(spark):
    d = _tmp()
    _csv(d, "b.csv", "Ticker,Date,Open,High,Low,Close,Volume", ["A,2020-01-02,1,2,0.5,1.5,n/a"])
    r = FS.read_bars(spark, d, fmt="csv").first()
    assert r.volume is None and r.close == 1.5
    _csv(os.path.join(d, "x"), "b.csv", "Ticker,Date,Open", ["A,2020-01-02,1"])
    with pytest.raises(ValueError, match="missing required columns"):
        FS.read_bars(spark, os.path.join(d, "x"), fmt="csv")


def test_listed_ticker_without_new_rows_is_cleared(spark):
    d = os.path.join(_tmp(), "bars")
    b = FX.bars(spark, SF_SMALL)
    FS.write_table(b, d, "ticker")
    FS.replace_tickers(b.where("ticker = '1-URGENT'").limit(2), d, tickers=["1-URGENT", "2-HIGH"])
    left = {r[0]: r[1] for r in spark.read.parquet(d).groupBy("ticker").count().collect()}
    assert left["1-URGENT"] == 2 and "2-HIGH" not in left and len(left) == b.select("ticker").distinct().count() - 1


def test_two_streams_side_by_side(spark):
    from marketframe.streaming.hourly import run_hourly_stream
    posts = FX.posts(spark, SF_SMALL).select(
        "ticker", "created_at", "likes_count", "retweet_count", "p_negative", "p_neutral", "p_positive", "sentiment_score")
    for part in ("1-URGENT", "2-HIGH"):
        src, sink, ck = (os.path.join(_tmp(), x) for x in ("posts", "hourly", "ck"))
        posts.where(F.col("ticker") == part).write.parquet(src)
        run_hourly_stream(spark, src, posts.schema, sink, ck)
        assert {r[0] for r in spark.read.parquet(sink).select("ticker").distinct().collect()} == {part}
