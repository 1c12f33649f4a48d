"""Paging by the last row seen.

A page after a given row is a predicate on the sort key and a bounded top-k: nothing before it
is gathered, no job runs while the plan is made, and a deep page costs what the first one does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = Sequence[tuple[str | Column, bool]]  # (column, ascending); the last one unique
NEWEST = (("created_at", False), ("id", False))


def _columns(key: Key) -> list[tuple[Column, bool]]:
    return [(F.col(c) if isinstance(c, str) else c, up) for c, up in key]


def order_by(key: Key) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in _columns(key)]


def after(key: Key, row: Sequence) -> Column:
    """Rows that come after the one with the key values ``row``.  Nulls come first in ascending and
    last in descending order."""
    def beyond(c: Column, up: bool, value) -> Column:
        if up:
            return c.isNotNull() if value is None else c > F.lit(value)
        return F.lit(False) if value is None else c.isNull() | (c < F.lit(value))

    key = _columns(key)
    steps, same = [], []
    for (c, up), value in zip(key, row):
        steps.append(reduce(lambda a, b: a & b, [*same, beyond(c, up, value)]))
        same.append(c.eqNullSafe(F.lit(value)))
    rest = F.coalesce(reduce(lambda a, b: a | b, steps), F.lit(False))
    # Implied by the rest; as a plain comparison it reaches the scan.
    (c, up), value = key[0], row[0]
    if value is not None:
        rest = (c.isNull() | (c <= F.lit(value)) if not up else c >= F.lit(value)) & rest
    return rest


def page_after(rows: DataFrame, key: Key, row: Sequence | None = None, limit: int = 20) -> DataFrame:
    """The first ``limit`` rows after ``row`` (from the start without one), in order of ``key``."""
    if row is not None:
        rows = rows.where(after(key, row))
    return rows.orderBy(*order_by(key)).limit(int(limit or 20))
