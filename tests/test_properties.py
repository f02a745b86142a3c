"""Properties of the sample pipeline on the driver tables."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketframe.functions.timefn import floor_hour, roll_weekend
from marketframe.operators import hourly as H
from marketframe.operators import samples as S
from marketframe.schemas import PRICE_FEATURES
from marketframe.sources import fixtures as FX


def test_text_windows_never_see_the_prediction_day(spark):
    posts = FX.posts(spark, SF_SMALL)
    hourly = H.hourly_weighted(posts)
    gd = H.hourly_deltas(H.fill_hour_grid(hourly))
    keys = S.text_sample_keys(FX.bars(spark, SF_SMALL), S.text_first_hours(hourly))
    long = S.text_window_rows(keys, gd)
    # window hours end at D-1 16:00; recompute the hour from pos to check it
    hours = long.join(keys.select("ticker", "date", "prediction_time"), ["ticker", "date"])
    late = hours.where(F.col("prediction_time") - F.expr("INTERVAL 95 HOURS")
                       + F.make_dt_interval(hours=F.col("pos")) >= F.col("date").cast("timestamp_ntz"))
    assert late.count() == 0
    assert long.groupBy("ticker", "date").count().where(F.col("count") != 72).count() == 0


def test_train_dates_precede_test_dates(spark):
    rows = S.price_rows(FX.bars(spark, SF_SMALL))
    sp = S.chrono_split(S.price_sample_keys(rows))
    r = sp.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi"),
                                F.count(F.lit(1)).alias("n")).collect()
    d = {x.split: x for x in r}
    assert d["train"].hi <= d["test"].lo
    n = d["train"].n + d["test"].n
    assert d["train"].n == int(n * 0.8)


def test_scaled_train_rows_have_mean_0_std_1(spark):
    rows = S.price_rows(FX.bars(spark, SF_SMALL))
    split = S.chrono_split(S.price_sample_keys(rows))
    wr = S.train_row_weights(rows, split)
    stats = S.scaler_fit(wr)
    long = S.scale_long(wr, stats).join(wr.select("ticker", "date", "weight"), ["ticker", "date"])
    agg = long.where(F.col("weight") > 0).groupBy("feature").agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("m"),
        (F.sum(F.col("value") ** 2 * F.col("weight")) / F.sum("weight")).alias("m2")).collect()
    assert len(agg) == len(PRICE_FEATURES)
    for a in agg:
        assert abs(a.m) < 1e-9, a
        assert math.isclose(a.m2 - a.m ** 2, 1.0, rel_tol=1e-9) or a.m2 < 1e-9, a


def test_weekend_rolled_posts_land_on_monday_morning(spark):
    p = FX.posts(spark, SF_SMALL)
    h = p.select(floor_hour(roll_weekend("created_at")).alias("h"),
                 F.weekday("created_at").alias("dow"))
    wk = h.where(F.col("dow") >= 5)
    assert wk.count() > 0
    assert wk.where((F.weekday("h") != 0) | (F.hour("h") != 8)).count() == 0


def test_dedup_is_partial_aggregate_before_shuffle(spark):
    from marketframe.sources.ingest import dedup_first
    d = dedup_first(FX.posts(spark, SF_SMALL), "post_id", FX.POST_ORDER)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
