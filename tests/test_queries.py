import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
REFERENCE = sorted(entry.QUERIES)


@pytest.fixture(scope="module")
def database():
    return compare.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", REFERENCE)
def test_query_equals_sql(spark, database, name):
    got, want = compare.check(
        spark, database, FOLDER, name, entry.queries(), entry.oracle_sql()
    )
    assert got == want


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
