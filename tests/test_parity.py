"""Every registered query against its SQL, on the small tables."""

import math

import duckdb
import pytest

from tallyflow.plans.catalog import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _rows(pdf):
    def clean(v):
        return None if v is None or v is not v or (isinstance(v, float) and math.isnan(v)) else v

    rows = [tuple(clean(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, "" if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    ours = QUERIES[name](spark, data).toPandas()
    theirs = duck.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in columns}
    assert all(a == b for a, b in kinds.values()), kinds
    assert _rows(ours[columns]) == _rows(theirs[columns])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_accuracy_sweep_stays_below_its_bound(spark, data):
    rows = QUERIES["accuracy_sweep"](spark, data).collect()
    assert len(rows) == 15 * 3 * 3 and {r["trials"] for r in rows} == {100}
    for row in rows:
        # The rate of 100 trials may exceed the probability by its own sampling error.
        error = math.sqrt(row["bound"] * (1 - row["bound"]) / row["trials"])
        assert row["failure_rate"] <= row["bound"] + 3 * error
