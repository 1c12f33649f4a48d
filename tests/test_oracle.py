"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

from acadia.plans import ORACLE, QUERIES
from acadia.plans.check import compare, duck

from .conftest import SF_SMALL

# Fast enough for every run; the full sf0.01 comparison is `python -m acadia.plans.check`.
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res
    assert res["spark_rows"] > 0, "an empty result would make the oracle check vacuous"
    if name in ORACLE:
        assert res["spark_rows"] == res["duck_rows"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    out = entry.entry(spark)
    assert out.count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
