"""Every registered query against its SQL; those without SQL must give rows with a stable schema."""

import oracle
import pytest

import __spark_entry__ as entry

# The training-data queries have their own tests.
NAMES = sorted(set(entry.queries()) - set(entry.MORE))


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        difference = oracle.compare(df, con, sql)
        assert difference is None, difference


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "url", "article"]
