"""Every registered query against its SQL on the smallest driver tables."""

import duckdb
import pytest

from tests.conftest import TESTDATA
from voicegrid.plans.catalog import QUERIES
from voicegrid.plans.oracle import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
WITHOUT_SQL = {
    "sentiment_scored", "sentiment_training", "topic_assignments", "topic_quality_report",
    "full_analysis",
}
pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in places) for row in rows), key=lambda row: [(v is None, str(v)) for v in row])


def test_names():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, str(TESTDATA))
    wanted = duck.execute(ORACLES[name])
    columns = [item[0] for item in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert ordered(map(tuple, found.collect()), found.columns) == ordered(wanted.fetchall(), columns)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
