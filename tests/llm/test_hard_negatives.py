"""Hard-negative mining against a plain search over all rows, and its edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acadia.llm import hard_negatives
from acadia.llm.hard_negatives import first, inner_products, mine, quantised

ROWS = "vec_id long, embedding array<float>, label int"


def _expected(rows, positives=5, negatives=5, share=(80, 100)):
    """rows: (vec_id, label, vector) that take part; anchors by vec_id % 100."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, (vec_id, label, vector) in enumerate(rows):
        if vec_id is None or vec_id % 100:
            continue
        scored = sorted(((-dot(vector, v), math.inf if c is None else c, j) for j, (c, _, v) in enumerate(rows) if j != i))
        pos = [(-s, j) for s, _, j in scored if rows[j][1] == label][:positives]
        for p, j in pos:
            neg = [(-s, n) for s, _, n in scored if rows[n][1] != label and share[0] * p <= share[1] * -s <= share[1] * p][:negatives]
            out += [(vec_id, rows[j][0], k + 1, rows[n][0], p, s) for k, (s, n) in enumerate(neg)]
    return sorted(out, key=str)


def _rows(seed, n, width=6, spread=3):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.integers(-1, spread, width) / 4], int(rng.integers(0, 4))) for i in range(n)]


def _got(spark, rows, **kw):
    table = spark.createDataFrame(rows, ROWS)
    vectors = quantised(table).withColumns({c: F.lit("x") for c in ("score", "slot", "rank", "_group", "row_key", "anchor")})
    return sorted((tuple(r) for r in mine(vectors, F.col("vec_id") % 100 == 0, **kw).collect()), key=str)


@pytest.mark.parametrize("group_bytes", [32 << 20, 3000])
def test_mining_matches_a_plain_search(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", group_bytes)
    rows = _rows(1, 420)
    want = _expected([(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in rows])
    assert _got(spark, rows) == want and len(want) > 50
    few = _expected([(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in rows], 2, 7, (1, 2))
    assert _got(spark, rows, positives=2, negatives=7, share=(1, 2)) == few


def test_rows_that_take_no_part_ties_and_repeats(spark):
    same = [1.0, 0.5]
    rows = [(0, same, 1), (1, same, 1), (2, same, 2), (3, same, 2), (3, same, 2), (None, same, 2), (4, [0.9, None], 2), (5, [float("nan"), 1.0], 2),
            (6, [float("inf"), 1.0], 2), (7, None, 2), (8, same, None), (9, [], 2), (100, same, 1), (100, same, 1), (10, [1.0], 2)]
    got = _got(spark, [r for r in rows])
    part = [(i, label, [math.floor(256 * x) for x in v] + [0] * (2 - len(v)))
            for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == _expected(part)
    # Ties go by vec_id, the row without one comes last, and each copy of row 100 is an anchor and the other's positive.
    assert [r[3] for r in got if r[:2] == (0, 1)] == [2, 3, 3, None, 10] and sum(r[:2] == (100, 100) for r in got) == 10


def test_few_rows_and_empty_table(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(0, [1.0], 1)]) == []
    assert _got(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-2.0], 2)]) == []
    assert _got(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 58880)]


def test_scores_are_exact_and_end_at_a_long():
    a = np.array([[2**31 + 1, 3], [2**62, 2**62]], np.int64)
    assert inner_products(a, a)[0, 0] == (2**31 + 1) ** 2 + 9 and inner_products(a, a)[1, 1] == 2**63 - 1
    assert inner_products(np.array([[3, 4]]), np.array([[1, 2], [0, -1]])).tolist() == [[11, -4]]


def test_first_breaks_ties_by_place():
    scores = np.array([5, 7, 5, 7, 5, -2**63, 2**63 - 1], np.int64)
    assert first(scores, np.arange(7), 4).tolist() == [6, 1, 3, 0] and first(scores, np.arange(0), 4).tolist() == []
    assert first(scores, np.array([2, 4, 5]), 5).tolist() == [2, 4, 5]
