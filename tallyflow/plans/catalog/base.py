"""Registry of queries and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyflow.functions.mixing import MASK31, MIX_A, MIX_B, MIX_HI, seed31
from tallyflow.operators.sketch import FAMILIES, Projection

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PROJ = Projection(depth=5, width=97, seed=7)
DAY = 86400

EV = """ev AS (
  SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                              WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS sid,
         CAST(user_id % 8 AS INTEGER) AS hid,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS key,
         CAST(1 AS BIGINT) AS upd,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         event_id AS seq
  FROM events)"""

LI = """li AS (
  SELECT CAST(l_linenumber % 2 AS INTEGER) AS sid,
         CAST(l_suppkey % 8 AS INTEGER) AS hid,
         l_partkey AS key,
         CAST(1 AS BIGINT) AS upd,
         CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS ts
  FROM lineitem)"""


def with_(*parts: str) -> str:
    """CTEs and a final SELECT."""
    *ctes, body = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def seeds_cte(proj: Projection = PROJ, name: str = "seeds") -> str:
    rows = ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" for v in r) + ")" for r in proj.seeds())
    return f"{name} AS (SELECT CAST(d AS INTEGER) AS d, f0, f1, f2, f3, f4, f5 FROM (VALUES {rows}) t(d, f0, f1, f2, f3, f4, f5))"


def hashed_cte(source: str, out: str, proj: Projection = PROJ, seeds: str = "seeds") -> str:
    """CTE ``out``: rows of ``source`` times sketch rows, with bucket b and sign sg of key."""

    def fold(r: str) -> str:
        mixed = f"xor({r} >> 31, {r})" if proj.family == "xor" else f"(({r} >> 31) + {r})"
        return f"({mixed} & 2147483647)"

    return f"""{out}_0 AS (SELECT s.*, t.*, ((s.key % 2147483647) + 2147483647) % 2147483647 AS x
              FROM {source} s CROSS JOIN {seeds} t),
{out}_1 AS (SELECT *, f0 * x + f1 AS ra, x * f3 + f2 AS rb FROM {out}_0),
{out}_2 AS (SELECT *, {fold('rb')} * f4 + x AS rc FROM {out}_1),
{out}_3 AS (SELECT *, {fold('rc')} * f5 + x AS rd FROM {out}_2),
{out} AS (SELECT * EXCLUDE (x, ra, rb, rc, rd, f0, f1, f2, f3, f4, f5),
                 CAST({fold('ra')} % {proj.width} AS INTEGER) AS b,
                 2 * (({fold('rd')} >> {FAMILIES[proj.family]}) & 1) - 1 AS sg
          FROM {out}_3)"""


def sketch_cte(source: str, out: str, by: str = "sid", proj: Projection = PROJ, seeds: str = "seeds") -> str:
    """CTE ``out``: sketch of ``source`` per ``by``, straight from the records."""
    group = f"{by}, " if by else ""
    return (
        hashed_cte(source, f"{out}_h", proj, seeds)
        + f""",
{out} AS (SELECT {group}d, b, CAST(sum(sg * upd) AS BIGINT) AS c FROM {out}_h GROUP BY {group}d, b)"""
    )


def _u31(row_id: str, *labels) -> str:
    """SQL twin of the generator's hash, as nested expressions."""
    x = f"((({row_id} & {MASK31}) + (({row_id} >> 31) & {MASK31}) * {MIX_HI} + {seed31(*labels)}) & {MASK31})"
    x = f"((xor({x}, {x} >> 15) * {MIX_A}) & {MASK31})"
    x = f"((xor({x}, {x} >> 14) * {MIX_B}) & {MASK31})"
    return f"xor({x}, {x} >> 15)"


def uniform_int_sql(row_id: str, high: int, *labels) -> str:
    return f"((({_u31(row_id, *labels)}) * {high}) >> 31) + 1"


def uniform_unit_sql(row_id: str, *labels) -> str:
    return f"((({_u31(row_id, *labels)})::DOUBLE + 0.5) / 2147483648.0)"
