"""Every query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from hedgemark.plans.catalog import QUERIES
from oracle.answers import ANSWERS
from tests.compare import database, difference


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, con, name):
    state, rows, diff = difference(spark, con, sf, name, QUERIES[name], ANSWERS.get(name))
    assert state in ("ok", "rows-only"), (state, diff)
    assert rows > 0


def test_every_answer_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ANSWERS) == {"idna_udf"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 50
    assert df.columns == ["page_id", "normalized_url", "domain", "status", "blacklisted", "categories", "verdict"]
