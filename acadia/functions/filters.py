"""Predicate builders shared by the reports: optional filters, search, time ranges, paging."""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ts_lit(value) -> Column:
    """A timestamp literal from a datetime, date or ISO string."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        return F.lit(value).cast("timestamp")
    if isinstance(value, _dt.date):
        return F.lit(value).cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def all_of(conds: Iterable[Column | None]) -> Column | None:
    """AND of the supplied predicates; ``None`` when none is supplied."""
    present = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, present) if present else None


def where(df: DataFrame, *conds: Column | None) -> DataFrame:
    cond = all_of(conds)
    return df if cond is None else df.filter(cond)


def eq_if(col: str | Column, value) -> Column | None:
    """``col = value`` when a value is given (empty string counts as not given)."""
    if value is None or value == "":
        return None
    return F.col(col) == F.lit(value) if isinstance(col, str) else col == F.lit(value)


def search(term: str | None, *cols: str | Column) -> Column | None:
    """Case-insensitive substring search over several columns.

    The term goes into ``ILIKE '%term%'`` unescaped, so ``%`` and ``_`` in it act as
    wildcards, as in the original queries.  NULL columns never match.
    """
    if not term:
        return None
    pattern = f"%{term}%"
    return reduce(lambda a, b: a | b,
                  [(F.col(c) if isinstance(c, str) else c).ilike(pattern) for c in cols])


def day_range(col: str | Column, start=None, end=None) -> Column | None:
    """``start::date <= col < end::date + 1 day``; either bound may be missing."""
    c = F.col(col) if isinstance(col, str) else col
    conds = []
    if start:
        conds.append(c >= F.to_date(F.lit(str(start))).cast("timestamp"))
    if end:
        conds.append(c < F.date_add(F.to_date(F.lit(str(end))), 1).cast("timestamp"))
    return all_of(conds)


def since(col: str | Column, as_of, days: int, strict: bool = False) -> Column:
    """Rolling window ``col >= as_of - days`` (``>`` when ``strict``), open at the end."""
    c = F.col(col) if isinstance(col, str) else col
    lower = ts_lit(as_of) - F.make_dt_interval(days=F.lit(int(days)))
    return c > lower if strict else c >= lower


def page(df: DataFrame, order: list[Column], page_no: int = 1, limit: int = 20) -> DataFrame:
    """One page of an ordered list.

    ``orderBy(...).offset(k).limit(n)`` plans as a bounded top-k
    (TakeOrderedAndProject), not a full sort; callers put a unique key last so page
    membership is stable on ties.
    """
    page_no = max(int(page_no or 1), 1)
    limit = int(limit or 20)
    ordered = df.orderBy(*order)
    offset = (page_no - 1) * limit
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_joined(left: DataFrame, joiner, order: list[Column], page_no: int = 1,
                limit: int = 20) -> DataFrame:
    """One page of ``joiner(left)``, cutting the page from ``left`` first when exact.

    ``joiner`` applies inner joins on unique keys (and filters) that can drop rows of
    ``left`` but never add any, and ``order`` uses columns of ``left`` only.  The top
    ``offset + limit`` rows of ``left`` are taken first (a bounded top-k, no full
    shuffle) and joined; when none of them was dropped, or ``left`` has fewer rows
    than that, the page comes from those rows alone.  Otherwise (orphan keys, a search
    on joined columns) the full join is paged.  Both ways give the same rows.  The
    bounded top rows are checkpointed so the check and the page read the same rows.
    """
    from ..session import checkpoint_dir
    page_no = max(int(page_no or 1), 1)
    limit = int(limit or 20)
    need = (page_no - 1) * limit + limit
    checkpoint_dir(left.sparkSession)
    top = left.orderBy(*order).limit(need).checkpoint(eager=True)
    kept = joiner(top)
    n_top = top.count()
    if n_top < need or kept.count() == n_top:
        return page(kept, order, page_no, limit)
    return page(joiner(left), order, page_no, limit)


# The most rows a side is broadcast with; a caller passes slim key tables, of tens of bytes a row.
BROADCAST_KEYS = 2_000_000


def sized(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if a count finds them few enough; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
