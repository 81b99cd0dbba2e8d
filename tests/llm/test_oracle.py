"""Queries that SQL can express equal DuckDB on the smallest driver tables."""
import re

import duckdb
import pytest

import __spark_entry__ as E
from postcast.llm.oracle import ORACLE_SQL
from postcast.sources.tables import TABLES
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = E.queries()[key](spark, SF).toPandas(), con.execute(E.oracle_sql()[key]).df()
    assert len(got) == len(want) > 0 and digest(got)[::2] == digest(want)[::2]


def test_every_operator_has_a_query():
    names = {k.split("_")[0] for k in E.queries() if re.match(r"op\d+_", k)}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in E.queries()
