"""Keyed sinks with one commit step: failures between the steps, races, retries; the compact sequence store."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import samples as S
from marketframe.sources import commits as C
from marketframe.sources import files as FS


def _table():
    return os.path.join(tempfile.mkdtemp(prefix="mf-test-"), "table")


def _posts(spark, *rows):
    return spark.createDataFrame(rows, "post_id long, text string, n int")


def _held(spark, path):
    d = C.read_committed(spark, path)
    return None if d is None else sorted((r.post_id, r.text) for r in d.collect())


def test_append_survives_failures_and_retries(spark, monkeypatch):
    path = _table()
    assert C.read_committed(spark, path) is None
    assert C.append_committed(_posts(spark, (1, "a", 1), (1, "b", 0), (2, "c", 5)), path, order=["n"]) == 1
    want = [(1, "b"), (2, "c")]
    assert _held(spark, path) == want
    more = _posts(spark, (2, "again", 1), (3, "d", 1))
    broken = more.withColumn("text", F.when(F.col("post_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):                  # fails while the part is written
        C.append_committed(broken, path, order=["n"])
    assert _held(spark, path) == want

    def dies(*a):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:                              # fails between the part and the manifest
        m.setattr(C, "_commit", dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            C.append_committed(more, path, order=["n"])
    assert _held(spark, path) == want
    assert C.append_committed(more, path, order=["n"]) == 2
    assert C.append_committed(more, path, order=["n"]) == 2       # a retry after success adds nothing
    assert _held(spark, path) == want + [(3, "d")]


def test_writers_side_by_side_add_nothing_twice(spark, monkeypatch):
    path = _table()
    C.append_committed(_posts(spark, (1, "a", 1)), path)
    commit, raced = C._commit, []

    def race(*a):
        if not raced:                                             # another writer commits just before
            raced.append(1)
            assert C.append_committed(_posts(spark, (2, "other", 0), (3, "other", 0)), path) == 2
        return commit(*a)
    monkeypatch.setattr(C, "_commit", race)
    assert C.append_committed(_posts(spark, (3, "mine", 0), (4, "mine", 0)), path) == 3
    assert [i for i, _ in _held(spark, path)] == [1, 2, 3, 4]
    assert dict(_held(spark, path))[3] == "other"


def test_replace_is_one_step(spark, monkeypatch):
    path, ddl = _table(), "ticker string, date date, close double"
    day = dt.date(2020, 1, 1)
    C.replace_committed(spark.createDataFrame([(t, day, float(i)) for i, t in enumerate(["A", "A", "B", "C", None, "7"])], ddl), path)
    held = lambda: sorted(((r.ticker, r.close) for r in C.read_committed(spark, path).collect()), key=repr)
    before = held()
    assert before == sorted([("A", 0.0), ("A", 1.0), ("B", 2.0), ("C", 3.0), (None, 4.0), ("7", 5.0)], key=repr)
    new = spark.createDataFrame([("A", day, 9.0), (None, day, 8.0)], ddl)
    with monkeypatch.context() as m:
        m.setattr(C, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            C.replace_committed(new, path, tickers=["B"])
    assert held() == before
    assert C.replace_committed(new, path, tickers=["B"]) == 2
    after = sorted([("A", 9.0), ("C", 3.0), (None, 8.0), ("7", 5.0)], key=repr)
    assert held() == after
    assert C.compact(spark, path) == 3 and held() == after
    assert len(C.manifest(spark, path)[1]["parts"]) == 1
    C.replace_committed(spark.createDataFrame([("B", day, 1.0)], ddl), path)
    assert held() == sorted([*after, ("B", 1.0)], key=repr)


def _rows(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(t, dt.date(2010, 1, 1) + dt.timedelta(days=i), int(rng.integers(0, 2)), *map(float, rng.normal(size=2)))
            for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, label int, a double, b double").repartition(3)


@pytest.mark.parametrize("segment", [10, 13, 64])
def test_sequence_store_gives_the_windows_back(spark, segment):
    rows = _rows(spark, {"A": 95, "B": 10, "C": 9, "D": 64, "E": 130})
    keys = rows.select("ticker", "date", "label", F.when(F.dayofmonth("date") % 3 == 0, "test").otherwise("train").alias("split"))
    path = _table()
    FS.write_sequence_store(rows, keys, path, length=10, features=["a", "b"], segment=segment)
    want = {}
    table = rows.toPandas().sort_values(["ticker", "date"])
    for t, g in table.groupby("ticker"):
        v = g[["a", "b"]].to_numpy(np.float32)
        want |= {(t, d): v[i - 9:i + 1] for i, d in enumerate(g.date) if i >= 9}
    got = FS.read_sequence_store(spark, path).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.array_equal(np.array(r.X, np.float32), want[r.ticker, r.date])
    train = FS.read_sequence_store(spark, path, "train").collect()
    assert len(train) == sum(d.day % 3 != 0 for _, d in want) and all(r.split == "train" for r in train)


def test_sequence_store_is_small(spark):
    rows = _rows(spark, {f"T{i}": 700 for i in range(4)})
    keys = rows.select("ticker", "date", "label", F.lit("train").alias("split"))
    path, plain = _table(), _table()
    FS.write_sequence_store(rows, keys, path, length=60, features=["a", "b"])
    FS.write_samples(FS.read_sequence_store(spark, path), plain)
    numbers = spark.read.parquet(f"{path}/segments").agg(F.sum(F.size("rows"))).first()[0]
    assert numbers < 1.25 * rows.count()                       # 60 times in the plain archive
    stored = spark.read.parquet(plain).agg(F.sum(F.size("X"))).first()[0]
    assert stored == 60 * 4 * (700 - 59)
    assert S.shape_violations(FS.read_sequence_store(spark, path), length=60, n_features=2).first().bad_shape == 0


def test_sequence_store_of_nothing(spark):
    rows = _rows(spark, {"A": 5})
    path = _table()
    FS.write_sequence_store(rows, rows.select("ticker", "date", "label", F.lit("train").alias("split")), path, length=10,
                            features=["a", "b"])
    assert FS.read_sequence_store(spark, path).count() == 0
