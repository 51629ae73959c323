"""Every registered query against its SQL, or for rows, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

CHECKED = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_matches_sql(spark, sf, con, name):
    assert difference(entry.queries()[name](spark, sf), con, CHECKED[name], tol=1e-7) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(CHECKED)))
def test_gives_rows(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_every_check_has_a_query():
    assert set(CHECKED) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
