"""Money and rounding helpers, all in decimal arithmetic (never double division)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(18,2)"


def money_sum(col: Column) -> Column:
    """``SUM`` of a decimal(12,2) column, typed decimal(18,2) (NULL over no rows)."""
    return F.sum(col).cast(MONEY_SUM)


def money(col: Column) -> Column:
    """Round half-up to cents and type as decimal(12,2)."""
    return F.round(col.cast("decimal(20,6)"), 2).cast(MONEY)


def js_round(col: Column) -> Column:
    """``Math.round``: floor(x + 0.5), as an integer."""
    return F.floor(col + F.lit(0.5)).cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    """Whole-number percentage, ``Math.round(part / whole * 100)``; 0 when whole is 0.

    Computed as floor((200*part + whole) / (2*whole)) = floor(part*100/whole + 1/2) from
    integer operands; the one division is exact enough that the floor is never off
    (distance to the next integer >= 1/(2*whole), far above double precision).
    """
    p, w = part.cast("long"), whole.cast("long")
    return F.when(w > 0, F.floor((p * 200 + w) / (w * 2)).cast("int")).otherwise(F.lit(0))
