"""Rounding helpers against exact references on many random values."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from acadia.functions.money import money, percent_of


def test_percent_of_is_exact_half_up(spark):
    rnd = random.Random(11)
    rows = [(p, w) for w in [rnd.randint(1, 10**6) for _ in range(3000)] for p in [rnd.randint(0, w)]]
    rows += [(1, 8), (7, 8), (1, 40), (3, 40), (0, 0), (5, 0)]
    df = spark.createDataFrame(rows, "p long, w long")
    got = {(r.p, r.w): r.pct for r in df.select("p", "w", percent_of(F.col("p"), F.col("w")).alias("pct")).collect()}
    for p, w in rows:
        want = 0 if w == 0 else int((Fraction(p * 100, w) + Fraction(1, 2)) // 1)
        assert got[(p, w)] == want, (p, w)


def test_money_rounds_half_up_to_cents(spark):
    rnd = random.Random(5)
    amounts = [Decimal(rnd.randint(0, 10**8)) / 100 for _ in range(2000)] + [Decimal("0.25"), Decimal("10.05")]
    rates = [Decimal("0.02"), Decimal("0.01"), Decimal("0.20"), Decimal("0.0125")]
    rows = [(a, r) for a in amounts for r in rates[:1]] + [(a, rates[i % 4]) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, "a decimal(12,2), r decimal(5,4)")
    out = df.select("a", "r", money(F.col("a") * F.col("r")).alias("m")).collect()
    for row in out:
        want = (row.a * row.r).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert row.m == want, (row.a, row.r)
