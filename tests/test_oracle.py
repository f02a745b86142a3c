"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

from check_oracle import compare, duck
from conftest import SF_SMALL

import __spark_entry__ as E
from marketframe.plans import catalog

# queries of this package; those of an optional subpackage have tests of their own
QUERIES = {k: v for k, v in E.queries().items() if k in catalog.QUERIES}
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only <= {"fusion_predictions", "price_classifier", "text_classifier", "classifier_selection"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert r["cols_ok"], r
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "mean_sentiment" in df.columns
