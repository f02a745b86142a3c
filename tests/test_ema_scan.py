"""EMA block scan: long series against pandas, and the shape of the plan."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketframe.operators import ema as E
from marketframe.operators import indicators as I
from marketframe.sources import fixtures as FX


def _series(spark, n):
    rng = np.random.default_rng(3)
    x = 100 * np.exp(np.cumsum(rng.normal(0, .03, n)))
    x[n // 2] = 1e9                                     # a spike that decays over the next block
    pdf = pd.DataFrame({"ticker": "A", "date": np.arange(n), "close": x})
    short = pd.DataFrame({"ticker": "B", "date": np.arange(7), "close": x[:7]})
    return pd.concat([pdf, short]), spark.createDataFrame(pd.concat([pdf, short])).repartition(4)


@pytest.mark.parametrize("spread", [False, True])
def test_long_series_match_pandas(spark, spread):
    pdf, df = _series(spark, 9000)
    spans = (2, 9, 10, 26, 200)                          # 2 and 200 need passes of their own
    got = E.ema_columns(df, {f"e{s}": ("close", s) for s in spans}, spread=spread).toPandas()
    got = got.sort_values(["ticker", "date"]).reset_index(drop=True)
    assert list(got.columns) == ["ticker", "date", "close"] + [f"e{s}" for s in got.columns[3:].str[1:].astype(int)]
    for s in spans:
        want = pdf.groupby("ticker").close.transform(lambda v: v.ewm(span=s, adjust=False).mean())
        want = pdf.assign(w=want).sort_values(["ticker", "date"]).w.to_numpy()
        np.testing.assert_allclose(got[f"e{s}"], want, rtol=1e-11)


def test_small_blocks_and_span_one(spark):
    pdf, df = _series(spark, 300)
    got = E.ema_columns(df, {"e3": ("close", 3), "e1": ("close", 1)}, carry=1e-20, reach=1e45).toPandas()
    got = got.sort_values(["ticker", "date"])
    want = pdf.groupby("ticker").close.transform(lambda v: v.ewm(span=3, adjust=False).mean())
    np.testing.assert_allclose(got.e3, pdf.assign(w=want).sort_values(["ticker", "date"]).w, rtol=1e-11)
    assert (got.e1 == got.close).all()
    assert E.block_rows([3], 1e-20, 1e45)[0] < 300


def _nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<![A-Za-z])Window(?= \[)", plan)), len(re.findall(r"Join", plan))


def test_plans_have_no_join_and_few_windows(spark):
    bars = FX.bars(spark, SF_SMALL)
    windows, joins = _nodes(I.emas(bars, (10, 12, 20, 26)))
    assert joins == 0 and windows <= 2
    windows, joins = _nodes(I.macd(bars))
    assert joins == 0 and windows <= 4
    assert I.macd(bars).where(F.col("MACD").isNull()).count() == 0
