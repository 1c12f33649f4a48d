"""Admission against a falling balance equals a loop over the rows, however they are spread."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acadia.functions import budget
from acadia.functions.budget import admit, joined, summary, through, walk


def _fold(amounts, balance):
    out = []
    for a in amounts:
        fits = a <= balance
        balance -= a if fits else 0
        out.append(balance if fits else -1)
    return out, balance


def _amounts(rnd, n):
    kind = rnd.randrange(4)
    top = rnd.choice([3, 50, 2000, 10**6])
    return [rnd.randint(1, top) if kind < 2 else rnd.choice([1, 2, top // 2 + 1, top]) if kind == 2 else 1 + int(top ** rnd.random())
            for _ in range(n)]


def test_walk_and_summaries_equal_the_loop():
    rnd = random.Random(4)
    quiet = 0
    for _ in range(3000):
        a = _amounts(rnd, rnd.choice([0, 1, 5, 40, 200]))
        b = rnd.choice([-3, 0, 1, 2, rnd.randint(1, 10**4), rnd.randint(1, 10**8)])
        want, end = _fold(a, b)
        got, left = walk(np.array(a, np.int64), b)
        assert got.tolist() == want and left == end
        cut = rnd.randint(0, len(a))
        parts = joined(summary(np.array(a[:cut], np.int64)), summary(np.array(a[cut:], np.int64)))
        whole = summary(np.array(a, np.int64))
        assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()
        out = through(whole[0].tolist(), whole[1].tolist(), b)
        assert out in (None, end)
        quiet += out is not None
        if out is None:  # a run that has to be read at least halves the power of two
            assert end <= 1 << max(0, (b - 1).bit_length() - 1)
    assert 500 < quiet < 2800


def _counted(monkeypatch):
    rounds = []
    real = budget._exits
    monkeypatch.setattr(budget, "_exits", lambda asked: rounds.append(dict(asked)) or real(asked))
    return rounds


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_admit_equals_the_loop_with_a_hot_key(spark, monkeypatch, partitions):
    rounds = _counted(monkeypatch)
    rnd = random.Random(9)
    balances = {k: rnd.choice([0, 900, 50_000, 10**7]) for k in range(30)} | {7: 3 * 10**7}
    rows = [(i, 7 if rnd.random() < 0.5 else rnd.randrange(30), rnd.randint(1, 40), 500 + int(10 ** (rnd.random() * 7))) for i in range(3000)]
    rows = [(*r, balances[r[1]], "y") for r in rows]
    table = spark.createDataFrame(rows, "id long, k long, at int, amount long, start long, pid string")
    got = {r.id: r["_left"] for r in admit(table, "k", ["at", "id"], "amount", "start", partitions).collect()}
    want = {}
    for k, b in balances.items():
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        want |= {r[0]: None if x < 0 else x for r, x in zip(own, _fold([r[3] for r in own], b)[0])}
    assert got == want
    assert len(rounds) <= 1 + np.log2(3 * 10**7 / 500) and (partitions == 1) == (not rounds)


def test_alternating_requests_of_one_key_take_few_rounds(spark, monkeypatch):
    rounds = _counted(monkeypatch)
    # Every second request is turned away: two hundred turns of the rule.
    amounts = [500 if i % 2 else 100_500 - 250 * i for i in range(400)]
    rows = [(i, 1, a, 100_000) for i, a in enumerate(amounts)]
    table = spark.createDataFrame(rows, "id long, k long, amount long, start long")
    got = {r.id: r["_left"] for r in admit(table, "k", ["id"], "amount", "start", 50).collect()}
    assert [-1 if got[i] is None else got[i] for i in range(400)] == _fold(amounts, 100_000)[0]
    assert len(rounds) <= 1 + np.log2(100_000 / 500)


def test_no_rows(spark):
    assert admit(spark.range(0).select("id", F.col("id").alias("k"), F.col("id").alias("a")), "k", ["id"], "a", "a").count() == 0
