"""The pipeline's stages, one after another, and the registered queries' SQL."""

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from brute import base_spans, jaccard_components
from check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, steps[-1], SF)
        assert sorted(out.columns) == sorted(columns)
        steps.append(spark.createDataFrame(out.select(columns).collect(), docs.schema))
    start, good, single, masked, mixed = [[(r.doc_id, r.text) for r in s.collect()] for s in steps]
    known = [d for d, _ in start if d in labels]
    kept = {d for d, _ in good}
    assert sum((d in kept) == bool(labels[d]) for d in known) >= 0.95 * len(known)
    component = jaccard_components(good, 5, 80)
    assert sorted(d for d, _ in single) == sorted(d for d, (_, c) in component.items() if d == c)
    before = dict(single)
    assert sorted(d for d, _ in masked) == sorted(before)
    for d, t in masked:
        values = [before[d][a:e] for a, _, e in base_spans(before[d])]
        assert (t == before[d]) == (not values) or "[SECRET]" in t
    assert {d for d, _ in mixed} <= set(before) and len(mixed) > len(set(mixed)) > 0
    last = P.STAGES[-1][1](spark, steps[-1], SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(d for d, _ in mixed)


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if k.startswith("op")))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["cols_ok"] and r["ok"], r


def _folder(spark, docs, labels):
    import tempfile
    folder = tempfile.mkdtemp(prefix="mf-test-")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_on_empty_tables_and_odd_rows(spark):
    import os

    from marketframe.session import checkpoint_dir
    assert P.run(spark, _folder(spark, [], [])).count() == 0
    good = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(8))
    odd = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3), (None, good, "en", "a", 9),
           (5, good, None, "b", 9), (5, good, None, "b", 9), (6, good, "en", None, 9), (7, "x" * 70_000, "en", "b", 9)]
    out = P.run(spark, _folder(spark, odd, [(5, 1, 0), (1, 0, 0)])).collect()
    assert {r.doc_id for r in out} <= {None, 5, 6, 7} and out
    assert sum(r.doc_id in (5, 6) for r in out) <= 2 * 2            # copies: one stays, used twice at most
    left = [d for d in os.listdir(checkpoint_dir(spark)) if d.startswith("pipeline-")]
    assert left and all(os.listdir(os.path.join(checkpoint_dir(spark), d)) == ["4"] for d in left)
