"""Named queries over the fixtures, each paired with its DuckDB oracle SQL.

A query is ``(spark, sf_dir) -> DataFrame``: it builds the fixture inputs for ``sf_dir``
and calls one operator with fixed parameters.  The oracle text is the same computation
written as plain SQL over the fixture views (prefixed with their definitions).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.fixtures import FIXTURE_SQL, Fixtures, duckdb_text, sources_of

# One clock for every fixture query.
AS_OF = dt.datetime(2001, 8, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2001-08-01 00:00:00'"

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_fixtures(sql)
        return fn
    return deco


_VIEW = re.compile(r"\bf_\w+\b")


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it uses (and their inputs), in order."""
    needed: set[str] = set()
    todo = [v for v in _VIEW.findall(sql) if v in FIXTURE_SQL]
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo.extend(s for s in sources_of(v) if s.startswith("f_"))
    ctes = [f"{v} AS (\n{duckdb_text(v)}\n)" for v in FIXTURE_SQL if v in needed]
    body = sql.strip().rstrip(";")
    if not ctes:
        return body
    m = re.match(r"(?i)^with(\s+recursive)?\s", body)
    if m:  # merge with the query's own CTE list
        head = "WITH RECURSIVE " if m.group(1) else "WITH "
        return head + ",\n".join(ctes) + ",\n" + body[m.end():].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
