"""Classifiers trained in rounds: gradients, early stop, the saved best model."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import training as TR
from marketframe.operators.samples import chrono_split


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float)
    w = TR.initial(4, (5, 3), 7) + rng.normal(0, .1, 4 * 5 + 5 + 5 * 3 + 3 + 3 + 1)
    _, g = TR.loss_and_gradient(w, x, y, (5, 3))
    for i in range(len(w)):
        e = np.zeros_like(w)
        e[i] = 1e-6
        up, down = (TR.loss_and_gradient(w + s * e, x, y, (5, 3))[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4 * max(1, abs(g[i]))


def _samples(spark, n=900, noise=.2):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < noise / 4)).astype(int)      # no linear model finds this
    rows = [(dt.date(2015, 1, 1) + dt.timedelta(days=i), "A", int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "date date, ticker string, label int, a double, b double, c double")
    return chrono_split(df)


@pytest.mark.parametrize("fan", [64, 2])
def test_best_round_is_kept_and_saved(spark, fan):
    sp = _samples(spark).repartition(7)
    folder = tempfile.mkdtemp(prefix="mf-test-") + "/model"
    train, test = (sp.where(F.col("split") == s) for s in ("train", "test"))
    m = TR.fit_best(spark, train, ["a", "b", "c"], rounds=60, patience=15, rate=.03, folder=folder, fan=fan)
    accuracy = [h[3] for h in m.history]
    assert m.valid_accuracy == max(accuracy) == accuracy[m.best_round] > .85
    assert len(m.history) <= m.best_round + 16                      # stopped once nothing got better
    back = TR.load_best(spark, folder)
    assert back.best_round == m.best_round and np.array_equal(back.weights, m.weights)
    got = TR.predict(back, test).collect()
    assert len(got) == test.count() and np.mean([r.predicted == r.actual for r in got]) > .8
    assert all((r.probability > .5) == bool(r.predicted) for r in got)


def test_selection_prefers_the_side_that_knows(spark):
    sp = _samples(spark)
    rows, models = TR.compare_models(spark, sp, {"none": ["c"], "both": ["a", "b"]}, rounds=60, patience=15, rate=.03)
    got = {r.model: r for r in rows.collect()}
    assert got["both"].selected and not got["none"].selected
    assert got["both"].test_accuracy > .8 > got["none"].test_accuracy and set(models) == {"none", "both"}


def test_missing_values_and_empty_train(spark):
    sp = _samples(spark, 60)
    holes = sp.withColumn("a", F.when(F.dayofmonth("date") > 3, F.col("a"))).withColumn(
        "label", F.when(F.dayofmonth("date") != 9, F.col("label")))
    m = TR.fit_best(spark, holes, ["a", "b"], rounds=3)
    assert TR.predict(m, holes).where("probability is null or isnan(probability)").count() == 0
    assert TR.fit_best(spark, sp.limit(0), ["a"]) is None
    rows, models = TR.compare_models(spark, sp.limit(0), {"x": ["a"]})
    assert rows.count() == 0 and not models
