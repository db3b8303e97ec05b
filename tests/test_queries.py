"""Every query with SQL gives DuckDB's rows; the others give some."""

import pytest

from lodestrand.queries import ORACLES, QUERIES
from tests.conftest import DATA


def rows(names, found):
    return sorted(tuple(str(r[c]) for c in names) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(names, got.astype(str).to_dict("records")) == rows(names, want.astype(str).to_dict("records"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
