"""Every registered query against its SQL, on the smallest tables."""

import pytest

from creditloom.catalog import entries
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
ALL = entries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_matches_sql(spark, con, name):
    fn, sql = ALL[name]
    got, want = compare(spark, con, fn, sql, SF)
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", ["importance_select", "report_rows"])
def test_runs(spark, name):
    assert ALL[name][0](spark, SF).count() > 0
