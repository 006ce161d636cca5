"""Registered queries of this subpackage against their SQL."""

import duckdb
import pytest

from tallyflow.llm.queries import QUERIES, SQL
from tests.test_parity import TABLES, _rows


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    ours = QUERIES[name](spark, data).toPandas()
    theirs = con.execute(SQL[name]).df()
    # Integers with nulls come as floats from one side.
    theirs = theirs.astype({c: "float64" for c in theirs.columns if str(theirs[c].dtype) == "Int64"})
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert _rows(ours[columns]) == _rows(theirs[columns])
