"""Splittable quoted CSV against Spark's whole-file reader."""

import os
import random
import tempfile

import pytest
from pyspark.sql import types as T

from marketframe.sources import quoted_csv as Q

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "body", "n")])


def _plain(spark, path, header=True):
    d = spark.read.schema(SCHEMA).option("header", header).option("multiLine", True).option("escape", '"').csv(path)
    return sorted(map(tuple, d.collect()), key=repr)


def _file(folder, name, rows, end="\n", head="id,body,n"):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(end.join([head, *rows]) + end)


def _rows(rng, n):
    out = []
    for i in range(n):
        body = "".join(rng.choice(["word ", 'say ""hi""', "\n", "\r\n", ",", "é漢", "\n\n", "x", '"",""\n""'])
                       for _ in range(rng.randint(0, 25)))
        out.append(rng.choice([f'{i},"{body}",{i % 7}', f"{i},plain text,3.0", f'"{i}",5" pipe,', f"{i},,", "", f"{i}",
                               f'{i},"{body}",{i},surplus']))
    return out


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("block", [50, 400, 5000])
def test_same_rows_as_whole_file_reader(spark, small_blocks, block):
    rng = random.Random(block)
    folder = tempfile.mkdtemp(prefix="mf-test-")
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        _file(folder, f"{k}.csv", _rows(rng, [60, 25, 0][k] * (1 if block == 50 else 4)), end)
    with open(os.path.join(folder, "9.csv"), "w") as f:
        f.write('id,body,n\n1,"' + "long\n" * 300 + '",2\n7,last,"no newline at the end"')
    want = _plain(spark, folder)
    small_blocks(block)
    got = Q.read_quoted_csv(spark, folder, SCHEMA)
    assert Q._lines(spark, folder).rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.drop("file_order").collect()), key=repr) == want
    again = Q.read_quoted_csv(spark, folder, SCHEMA, broadcast_blocks=0)        # the shuffled way
    assert sorted(map(tuple, again.drop("file_order").collect()), key=repr) == want


def test_order_and_header(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="mf-test-")
    _file(folder, "a.csv", [f'{i},"line\n{i}",x' for i in range(200)], head='"id\nnumber",body,n')
    small_blocks(128)
    rows = Q.read_quoted_csv(spark, folder, SCHEMA).orderBy("file_order").collect()
    assert [int(r.id) for r in rows] == list(range(200))
    assert len(Q.read_quoted_csv(spark, folder, SCHEMA, header=False).collect()) == 201


def test_one_large_file_is_many_tasks(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="mf-test-")
    _file(folder, "a.csv", [f'{i},"some\nlong text of row {i}",{i}' for i in range(60_000)])
    small_blocks(128 << 10)
    d = Q.read_quoted_csv(spark, os.path.join(folder, "a.csv"), SCHEMA)
    assert Q._lines(spark, folder).rdd.getNumPartitions() >= 15
    assert d.count() == 60_000
    r = d.where("id = '59999'").first()
    assert (r.body, r.n) == ("some\nlong text of row 59999", "59999")


def test_ends_inside():
    for line, inside, want in [("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True),
                               ('a,"b"', False, False), ('b"', True, False), ('b"",', True, True), ('b",c,"d', True, True),
                               ('5" pipe,x', False, False), ('"', False, True), ('""', False, False), ("", True, True)]:
        assert Q.ends_inside(line, inside) is want, line
