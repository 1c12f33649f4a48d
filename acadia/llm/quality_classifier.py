"""Quality classifier by co-training.

Two logistic classifiers see a document from different sides: the text view (letter, word
and repetition statistics and hashed words of the whole text) and the metadata view
(language, source, length).  Both start from labelled documents.  In each round every
unlabelled document is scored by both; what one view is sure of becomes a pseudo-label for
the other, and both are fitted again.  Held-out labels calibrate each view, and the two
calibrated log-odds are added up into the score of every document.

Features are computed where the text is; scoring and teaching run over all documents.  The
metadata view is fitted on counts of its patterns (at most 16 * 64 * 24), the text view by
Newton steps whose sums every task adds up over its rows, so every document that a view is
sure of teaches the other.  Together the taught documents weigh as much as the labelled ones,
each class by its share in the labels, and none more than ``TAUGHT`` of a labelled one.  Only
labelled rows are sampled: ``max_labelled`` of them, by hash order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import staged

BINS, HASHED = 8, 64
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:?'\"()-", b"!", b"\n"]
DENSE = 16
SURE = 0.95
TAUGHT = 0.3
SLOTS = 64
_META = 16 + 64 + 24


def text_view(texts: pa.Array) -> np.ndarray:
    """``uint8[n, DENSE + HASHED]``: statistics scaled to 0-255, then hashed word shares."""
    raw, offsets = W.text_buffer(texts)
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, DENSE + HASHED))
    chars = np.maximum(size, 1)
    full = np.flatnonzero(size)
    counts = np.zeros((n, len(_CLASSES)))
    for k, members in enumerate(_CLASSES):
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        if len(full):
            counts[full, k] = np.add.reduceat(table[raw], offsets[full], dtype=np.int64)
    starts, ends, rows = W.word_spans(raw, offsets)
    words = W.word_hashes(raw, starts, ends)
    number = np.diff(rows)
    many = np.maximum(number, 1)
    for k in range(6):
        out[:, k] = np.minimum(counts[:, k] / (chars if k == 0 else many) * (1 if k == 0 else 0.5), 1)
    some = np.flatnonzero(number)
    if len(some):
        at = rows[some]
        length = ends - starts
        upper = (raw[starts] >= 65) & (raw[starts] <= 90)
        out[some, 6] = np.minimum(np.add.reduceat(length, at) / number[some] / 16, 1)
        out[some, 7] = np.minimum(np.maximum.reduceat(length, at) / 64, 1)
        out[some, 8] = np.add.reduceat(upper, at, dtype=np.int64) / number[some]
        out[some, 9] = np.add.reduceat(length == 1, at, dtype=np.int64) / number[some]
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[at] = False
        out[some, 10] = np.add.reduceat(again, at, dtype=np.int64) / number[some]
        doc = np.repeat(np.arange(n), number)
        share = np.bincount(doc * HASHED + (words >> np.uint64(58)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        out[:, DENSE:] = np.sqrt(share / many[:, None])
    threes, cuts = W.shingle_hashes(words, rows, 3)
    for i in some:
        out[i, 11] = len(np.unique(words[rows[i]:rows[i + 1]])) / number[i]
        own = threes[cuts[i]:cuts[i + 1]]
        out[i, 12] = len(np.unique(own)) / len(own)
    out[:, 13] = np.minimum(np.log2(1 + number) / 20, 1)
    out[:, 14] = np.minimum(chars / np.maximum(counts[:, 5], 1) / 1024, 1)
    high = np.add.reduceat(raw >= 128, offsets[full], dtype=np.int64) if len(full) else np.zeros(0)
    out[full, 15] = high / size[full]
    return np.rint(out * 255).astype(np.uint8)


def _bucket(name: str | None, size: int) -> int:
    raw = (name or "").encode()
    h = 2166136261
    for b in raw:
        h = (h ^ b) * 16777619 % 2**32
    return h % size


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """``uint8[n, 3]``: places of language, source and length among ``_META`` indicators."""
    length = [min(23, int(c).bit_length()) if c and c > 0 else 0 for c in n_chars]
    return np.array([[_bucket(a, 16), 16 + _bucket(b, 64), 80 + c] for a, b, c in zip(lang, source, length)],
                    dtype=np.uint8).reshape(len(length), 3)


def _text_matrix(x: np.ndarray) -> np.ndarray:
    """Design matrix of the text view: each statistic in ``BINS`` steps, hashed words, one."""
    n = len(x)
    bins = np.minimum(np.sqrt(x[:, :DENSE] / 255.0) * BINS, BINS - 1).astype(int) + np.arange(DENSE) * BINS
    out = np.zeros((n, DENSE * BINS + HASHED + 1), np.float32)
    out[np.arange(n)[:, None], bins] = 1
    out[:, DENSE * BINS:-1] = x[:, DENSE:] / 255.0
    out[:, -1] = 1
    return out


def _meta_matrix(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), _META + 1), np.float32)
    out[np.arange(len(x))[:, None], x.astype(int)] = 1
    out[:, -1] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = x.astype(np.float64)
    beta, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * beta
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-3:
            break
    return beta


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, shift) and the log-odds of the prior.
    Without labels of both kinds there are no weights and every score is ``prior``."""

    text: np.ndarray | None
    meta: np.ndarray | None
    calibration: tuple
    prior: float

    def logits(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _text_matrix(xt) @ self.text, _meta_matrix(xm) @ self.meta

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both together."""
        if self.text is None:
            flat = np.full(len(xt), self.prior)
            return flat, flat, flat
        (a, b), (c, d) = self.calibration
        t, m = self.logits(xt, xm)
        t, m = a * t + b, c * m + d
        sure = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return sure(t), sure(m), sure(t + m - np.log(self.prior / (1 - self.prior)))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (text_view(batch.column("text")),
            meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            xt, xm = _views(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("order"), pa.array([r.tobytes() for r in xt], pa.binary()),
                 pa.array([r.tobytes() for r in xm], pa.binary())], names=["doc_id", "order", "xt", "xm"])


def _arrays(frame) -> tuple[np.ndarray, np.ndarray]:
    """View arrays of collected or batched feature rows."""
    read = lambda col, width: np.frombuffer(b"".join(col), np.uint8).reshape(-1, width)
    return read(frame["xt"], DENSE + HASHED), read(frame["xm"], 3)


def _columns(batch: pa.RecordBatch) -> dict:
    return {c: batch.column(c).to_pylist() for c in ("xt", "xm")}


def _taught_weights(counts: dict, labelled: float, prior: float) -> dict:
    """Weight of a pseudo-labelled row by label, from the rows of each label."""
    return {k: min(TAUGHT, labelled * share / counts[k]) if counts.get(k) else 0.0 for k, share in ((0, 1 - prior), (1, prior))}


def _sure_labels(z: np.ndarray) -> np.ndarray:
    """1 and 0 where the log-odds are sure, -1 elsewhere."""
    limit = np.log(SURE / (1 - SURE))
    return np.where(z >= limit, 1, np.where(z <= -limit, 0, -1))


def _sure(model: Model):
    """How often each view is sure of each label: for what the text view is sure of, by metadata."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for batch in batches:
            xt, xm = _arrays(_columns(batch))
            zt, zm = model.logits(xt, xm)
            for view, z, patterns in ((0, zt, xm), (1, zm, np.zeros_like(xm))):
                label = _sure_labels(z)
                some = label >= 0
                keys, n = np.unique(np.column_stack([label[some], patterns[some]]), axis=0, return_counts=True)
                for key, c in zip(keys.tolist(), n.tolist()):
                    counts[view, *key] = counts.get((view, *key), 0) + c
        if counts:
            view, label, *pattern = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(view, pa.int32()), pa.array(label, pa.int32()), pa.array([bytes(p) for p in zip(*pattern)], pa.binary()),
                 pa.array(list(counts.values()), pa.int64())], names=["view", "label", "xm", "n"])
    return run


def _moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted loss at ``beta``, in one array."""
    x = x.astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    hess = (x * (weight * p * (1 - p) + 1e-9 * (weight > 0))[:, None]).T @ x
    return np.concatenate([[x.T @ (weight * (p - y))], hess])


def _taught_moments(model: Model, weights: dict, beta: np.ndarray):
    """Each task's moments of the text view over the rows that the metadata view is sure of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((len(beta) + 1, len(beta)))
        for batch in batches:
            xt, xm = _arrays(_columns(batch))
            label = _sure_labels(_meta_matrix(xm) @ model.meta)
            for lo in range(0, len(xt), 4096):
                at = lo + np.flatnonzero(label[lo:lo + 4096] >= 0)
                if len(at):
                    w = np.where(label[at] == 1, weights[1], weights[0])
                    total += _moments(_text_matrix(xt[at]), label[at].astype(float), w, beta)
        yield _sums(TaskContext.get().partitionId() % SLOTS, total)
    return run


def _sums(slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("sums").to_pylist():
            part = np.frombuffer(blob)
            total = part if total is None else total + part
    if total is not None:
        yield _sums(0, total)


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """The tasks' moments added up.  The driver gets at most ``SLOTS`` arrays: more tasks than that
    are added up by slot first."""
    parts = rows.mapInArrow(run, "slot int, sums binary")
    if rows.rdd.getNumPartitions() > SLOTS:
        parts = parts.repartition(SLOTS, "slot").mapInArrow(_added, "slot int, sums binary")
    return sum((np.frombuffer(r.sums).reshape(size + 1, size) for r in parts.collect()), np.zeros((size + 1, size)))


def fit_taught(x: np.ndarray, y: np.ndarray, taught, beta: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the labelled rows and on ``taught(beta)``, the moments of the others."""
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(8):
        sums = _moments(x, y, np.ones(len(y)), beta) + taught(beta)
        step = np.linalg.solve(sums[1:] + np.diag(keep), sums[0] + keep * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-2:
            break
    return beta


def co_train(features: DataFrame, labels: DataFrame, rounds: int = 3, max_labelled: int = 20_000) -> Model:
    """Fits both views on ``labels(doc_id, quality)`` and on what they teach each other."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    joined = staged(features.join(known, "doc_id", "left"), "quality-features")
    sample = (joined.where("label IS NOT NULL").orderBy("order", "doc_id").limit(max_labelled)
              .select("label", "xt", "xm").toPandas())
    y = sample["label"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, (), float(y.mean()) if len(y) else 1.0)
    xt, xm = _arrays(sample)
    held = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    fit, prior = ~held, float(np.clip(y.mean(), 0.01, 0.99))
    if not held.any() or len(set(y[held])) < 2 or len(set(y[fit])) < 2:
        held = fit = np.ones(len(y), bool)
    plain, own = ((1.0, 0.0), (1.0, 0.0)), np.ones(int(fit.sum()))
    open_rows = joined.where("label IS NULL").select("xt", "xm")
    text, meta = _text_matrix(xt[fit]), _meta_matrix(xm[fit])
    model = Model(fit_logistic(text, y[fit], own), fit_logistic(meta, y[fit], own), plain, prior)
    for _ in range(rounds):
        sure = open_rows.mapInArrow(_sure(model), "view int, label int, xm binary, n long")
        sure = sure.groupBy("view", "label", "xm").agg(F.sum("n").alias("n")).toPandas()
        by = sure.groupby(["view", "label"])["n"].sum().to_dict()
        weights = [_taught_weights({k: by.get((view, k), 0) for k in (0, 1)}, len(own), prior) for view in (0, 1)]
        seen = sure[sure["view"] == 0]
        label = seen["label"].to_numpy(dtype=float)
        patterns = np.frombuffer(b"".join(seen["xm"]), np.uint8).reshape(-1, 3)
        mass = seen["n"].to_numpy(dtype=float) * np.where(label == 1, weights[0][1], weights[0][0])
        size = len(model.text)
        beta = fit_taught(text, y[fit], lambda b: _summed(open_rows, _taught_moments(model, weights[1], b), size), model.text)
        model = Model(beta, fit_logistic(np.concatenate([meta, _meta_matrix(patterns)]), np.concatenate([y[fit], label]),
                                         np.concatenate([own, mass])), plain, prior)

    calibration = []
    for z in model.logits(xt[held], xm[held]):
        slope, shift = fit_logistic(np.stack([z, np.ones(len(z))], axis=1), y[held], np.ones(held.sum()), ridge=1e-3)
        calibration.append((float(max(slope, 0.0)), float(shift)))
    return Model(model.text, model.meta, tuple(calibration), prior)


def features_of(docs: DataFrame) -> DataFrame:
    """Slim feature rows of ``docs(doc_id, text, lang, source, n_chars)``."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("quality"), "doc_id").alias("order"),
                        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return typed.mapInArrow(_features, "doc_id long, order long, xt binary, xm binary")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """``doc_id, p_text, p_meta, p_good, kept`` for every row of ``docs``.

    ``labels(doc_id, quality)``: 1 good, 0 bad; other values and null ids are ignored, and of
    several labels of a document the lowest counts.  ``kept`` is ``p_good >= threshold``.
    Without labels of both kinds every score is the labels' share of good (1 without any).
    Null texts count as empty, null languages and sources as '', null lengths as 0.  Rows that
    repeat a doc_id are scored one by one.  Other columns are ignored; an empty table gives
    no rows.  ``bounds``: ``rounds``, ``max_labelled``.
    """
    features = staged(features_of(docs), "quality-views")
    model = co_train(features, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m, p = model.scores(*_arrays(_columns(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v.astype(np.float64)) for v in (t, m, p)),
                                              pa.array(p >= threshold)], names=["doc_id", "p_text", "p_meta", "p_good", "kept"])

    return features.mapInArrow(run, "doc_id long, p_text double, p_meta double, p_good double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns unchanged.  The fitted model
    reads each row again in place, so no text is moved."""
    model = co_train(staged(features_of(docs), "quality-views"), labels, **bounds)
    place = {c: docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                seen = pa.RecordBatch.from_arrays([part.column(i) for i in place.values()], names=list(place))
                good = model.scores(*_views(seen))[2] >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
