"""Every registered query against its DuckDB oracle (rows-only where no oracle exists)."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import compare_one, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    status, detail = compare_one(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert status in ("OK", "ROWS"), detail


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["platform", "tag", "n_posts", "total_engagement"]
    assert df.count() >= 0
