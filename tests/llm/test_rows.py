"""Row by row: verdicts of the quality rules, likeness of fingerprints, and the packing's solver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acadia.llm import fingerprint, packing, quality_rules
from acadia.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_every_verdict_is_its_votes_posterior(spark):
    docs = read_table(spark, SF, "documents")
    stats = quality_rules.statistics(docs).withColumn("votes", quality_rules._votes())
    failed = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    model = quality_rules.estimate(stats.where(f"NOT ({failed})")).first().model
    want = {}
    for r in stats.withColumn("failed", F.expr(failed)).collect():
        odds = math.log(model.prior / (1 - model.prior))
        odds += sum(math.log(model.good[3 * j + v] / model.bad[3 * j + v]) for j, v in enumerate(r.votes))
        p = 1 / (1 + math.exp(-odds))
        want[r.doc_id] = (r.failed, not r.failed and p >= 0.5, p)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got.keys() == want.keys() and len({w[:2] for w in want.values()}) == 3
    for i, (failed, kept, p) in want.items():
        assert (got[i].base_failed, got[i].kept) == (failed, kept) and got[i].p_good == pytest.approx(p)


def test_every_likeness_is_a_share_of_the_sketch(spark):
    docs = read_table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted(fingerprint.edited_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    sketch = {r.doc_id: set(fingerprint.decode(r.fingerprint).tolist()) for r in rows}

    def share(a, b, same):
        return 1.0 if same else len(a & b) / len(a) if a else 0.0

    for r, after in zip(rows, rows[1:] + rows[:1]):
        own, text, following = sketch[r.doc_id], texts[r.doc_id], texts[after.doc_id]
        edited = set(fingerprint.decode(r.edited_fingerprint).tolist())
        k = len(text) // 4
        assert r.near_edited == pytest.approx(share(own, edited, text == text[:len(text) - k] + following[:k]))
        assert r.near_next == pytest.approx(share(own, sketch[after.doc_id], text == following))
    assert sum(r.near_edited > 0.5 for r in rows) > 100


def _least_squares(a, b):
    """Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(4 * a.shape[1]):
        grad = a.T @ (b - a @ x)
        if not (grad[~passive] > 1e-7).any():
            break
        passive[np.flatnonzero(~passive)[grad[~passive].argmax()]] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                break
            low = passive & (s <= 0)
            step = np.min(x[low] / (x[low] - s[low]))
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
    return x


@pytest.mark.parametrize("seed", range(3))
def test_repeat_counts_are_least_squares(seed, monkeypatch):
    monkeypatch.setattr(packing, "FINE", 8)
    monkeypatch.setattr(packing, "WIDTH", 4)
    monkeypatch.setattr(packing, "SLACK", 6)
    rng = np.random.default_rng(seed)
    table = packing.patterns(packing.bin_edges(64), 64)
    n = len(packing.bin_edges(64)) - 1
    histogram = rng.integers(0, 2000, n).astype(float)
    a = np.zeros((n, len(table)))
    for k, bins in enumerate(table):
        for b in bins[bins >= 0]:
            a[b, k] += 1
    best = np.linalg.norm(a @ _least_squares(a, histogram) - histogram)
    found = np.linalg.norm(a @ packing.solve_counts(table, histogram) - histogram)
    assert best - 1e-6 <= found <= best + 0.01 * np.linalg.norm(histogram)
