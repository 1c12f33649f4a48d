"""Co-training over all documents equals the same training done in one place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acadia.llm import quality_classifier as qc
from acadia.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def _fit(x, y, w, ridge=1.0):
    """Newton steps on all rows at once."""
    x, beta, keep = x.astype(float), np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (w * (p - y)) + keep * beta)
        beta -= step
        if np.abs(step).max() < 1e-6:
            return beta
    return beta


def _plain(rows, labels):
    """rows in the order of their hash."""
    xt = qc.text_view(pa.array([r.text for r in rows]))
    xm = qc.meta_view([r.lang for r in rows], [r.source for r in rows], [r.n_chars for r in rows])
    known = np.array([labels.get(r.doc_id, -1) for r in rows])
    own = np.flatnonzero(known >= 0)
    held = own[np.arange(len(own)) % 4 == 3]
    fit, prior = np.setdiff1d(own, held), known[own].mean()
    xs = [qc._text_matrix(xt), qc._meta_matrix(xm)]
    open_ = np.flatnonzero(known < 0)
    beta = [_fit(x[fit], known[fit], np.ones(len(fit))) for x in xs]
    limit = np.log(qc.SURE / (1 - qc.SURE))
    for _ in range(3):
        z = [x @ b for x, b in zip(xs, beta)]
        new = []
        for view in (0, 1):
            sure = open_[np.abs(z[1 - view][open_]) >= limit]
            label = (z[1 - view][sure] > 0).astype(float)
            w = np.array([min(0.3, len(fit) * (prior if k else 1 - prior) / (label == k).sum()) if (label == k).any() else 0 for k in (0, 1)])
            at = np.r_[fit, sure]
            new.append(_fit(xs[view][at], np.r_[known[fit], label], np.r_[np.ones(len(fit)), w[label.astype(int)]]))
        beta = new
    z, logit = [x @ b for x, b in zip(xs, beta)], -np.log(prior / (1 - prior))
    for v in z:
        a = _fit(np.stack([v[held], np.ones(len(held))], 1), known[held], np.ones(len(held)), 1e-3)
        logit = logit + max(a[0], 0) * v + a[1]
    return 1 / (1 + np.exp(-logit))


def test_scores_match_training_in_one_place(spark):
    docs, table = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    labels = {r.doc_id: r.quality for r in table.collect()}
    rows = docs.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], _plain(rows, labels)))
    got = {r.doc_id: r for r in qc.classify(docs, table).collect()}
    off = np.array([abs(got[i].p_good - p) for i, p in want.items()])
    assert off.max() < 0.01 and np.median(off) < 1e-4
    assert sum(got[i].kept != (p >= 0.5) for i, p in want.items()) <= 1


def test_many_tasks_are_added_up_by_slot(spark, monkeypatch):
    monkeypatch.setattr(qc, "SLOTS", 3)
    rows = spark.range(0, 40, 1, 7)
    ones = lambda batches: iter([qc._sums(0, np.ones((3, 2)) * sum(b.num_rows for b in batches))])
    assert (qc._summed(rows, ones, 2) == 40).all() and (qc._summed(rows.coalesce(2), ones, 2) == 40).all()


def test_every_sure_document_teaches_whatever_the_number(spark):
    # The same documents four times over: four times the sure rows at a quarter of the weight, above the bound.
    assert qc._taught_weights({0: 1000, 1: 4000}, 200, 0.5) == {0: 0.1, 1: 0.025}
    assert qc._taught_weights({0: 10, 1: 0}, 200, 0.5) == {0: 0.3, 1: 0.0}
    rng = np.random.default_rng(0)
    x, y = np.c_[rng.random((50, 3)), np.ones(50)], rng.integers(0, 2, 50).astype(float)
    again = lambda b: qc._moments(np.tile(x, (4, 1)), np.tile(y, 4), np.full(200, 0.25), b)
    twice = lambda b: qc._moments(x, y, np.ones(50), b)
    assert qc.fit_taught(x, y, again, np.zeros(4)) == pytest.approx(qc.fit_taught(x, y, twice, np.zeros(4)))
