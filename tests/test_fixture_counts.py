"""The verified counts of FIXTURES.md §4 (computed independently in DuckDB) at sf0.001."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketframe.operators import fusion as FU
from marketframe.operators import hourly as H
from marketframe.operators import samples as S
from marketframe.sources import fixtures as FX
from marketframe.sources.ingest import dedup_first


def test_fixture_counts_sf0001(spark):
    posts = FX.posts(spark, SF_SMALL)
    assert posts.count() == 6000
    assert posts.count() - dedup_first(posts, "post_id", FX.POST_ORDER).count() == 1401
    bars = FX.bars(spark, SF_SMALL)
    assert bars.count() == 1007
    hourly = H.hourly_weighted(posts)
    assert hourly.where(F.col("ticker") == "1-URGENT").count() == 1024

    rows = S.price_rows(bars)
    pk = S.price_sample_keys(rows)
    tk = S.text_sample_keys(bars, S.text_first_hours(hourly)).select("ticker", "date", "label")
    assert pk.count() == 607
    assert tk.count() == 1000
    al = FU.align(pk, tk)
    assert al.count() == 607
    agreed = FU.keep_agreeing(al)
    assert agreed.count() == 607
    assert agreed.where(F.col("label") == 1).count() == 304

    sp = S.chrono_split(agreed)
    train = sp.where(F.col("split") == "train")
    assert train.count() == 485
    last_train = train.orderBy(F.col("pos").desc()).first()
    first_test = sp.where(F.col("split") == "test").orderBy("pos").first()
    assert (last_train.date, last_train.ticker) == (dt.date(2000, 10, 6), "2-HIGH")
    assert (first_test.date, first_test.ticker) == (dt.date(2000, 10, 10), "2-HIGH")
