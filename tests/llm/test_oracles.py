"""Registered queries against their SQL."""

import duckdb
import pytest

from voicegrid.llm.oracles import ORACLES
from voicegrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    wanted = connection.execute(ORACLES[name])
    columns = [item[0] for item in wanted.description]
    found = QUERIES[name](spark, FOLDER).select(columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted.fetchall()))


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
