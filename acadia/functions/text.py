"""Text rules of the request handlers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends as the original's trim knows them (fixed values).
_SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trimmed(c) -> Column:
    """``c`` without leading and trailing white space of any kind (SQL ``trim`` only knows
    the space)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, rf"\A{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def leading_int(c) -> Column:
    """The whole number a text starts with (``' 12px'`` gives 12), NULL if there is none or
    it does not fit an int."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(trimmed(c.cast("string")), r"\A([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def truthy(c: Column, kind: str) -> Column:
    """``c`` as a flag: a missing value, false, 0, NaN and the empty text are false, all else true.

    ``kind`` is the type of ``c`` as in ``DataFrame.dtypes``.
    """
    if kind == "boolean":
        hit = c
    elif kind == "string":
        hit = c != ""
    elif kind in ("float", "double"):
        hit = (c != 0) & ~F.isnan(c)
    else:
        hit = c != 0
    return F.coalesce(hit, F.lit(False))
