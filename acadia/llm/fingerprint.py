"""Document fingerprints: a threshold-scaled sketch of word shingles.

A text's sketch holds every shingle hash below a fixed fraction of the hash range, so long
texts keep proportionally more than short ones.  The sketch of a union is the union of the
sketches, and the share of one sketch that lies in another estimates how much of the one
text is contained in the other, however unequal their lengths.

``edited_fingerprints`` also fingerprints each text's edited form, which borrows the start
of the next document by doc_id.  The table is dealt into runs of doc_ids, each run is read
in order by one streaming pass, and a run's last document finds its successor in a copy of
the next run's first one; nothing but one document at a time is held back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

SHINGLE = 5
SCALE_BITS = 2  # one hash in 2**SCALE_BITS is retained
KEPT_BYTES = 5
MAX_RUNS, ROWS_PER_RUN = 1_000_000, 1000  # runs follow the rows; their bounds are a list on the driver

_ROWS = "doc_id long, text string, row_key long, run int, ahead boolean"
_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted retained hashes, their first ``8 * KEPT_BYTES`` bits below the limit."""
    hashes, offsets = W.shingles(pa.array(texts, pa.large_string()), SHINGLE)
    low = hashes < np.uint64(1 << (64 - SCALE_BITS))
    kept = hashes[low] >> np.uint64(64 - SCALE_BITS - 8 * KEPT_BYTES)
    cuts = np.concatenate([[0], np.cumsum(low)])[offsets]
    return [np.unique(kept[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def encode(text: str, sketch: np.ndarray) -> str:
    """Fingerprint: a hash of the whole text, then the sketch (big-endian, base64)."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES:].tobytes()
    return hashlib.md5(text.encode()).hexdigest()[:16] + ":" + base64.b64encode(raw).decode()


def decode(fingerprint: str) -> np.ndarray:
    """The sketch of a fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - KEPT_BYTES:] = raw
    return out.view(">u8").reshape(-1).astype(np.uint64)


def merge(fingerprints: list[str]) -> np.ndarray:
    """Sketch of all the texts together."""
    return np.unique(np.concatenate([decode(f) for f in fingerprints])) if fingerprints else np.zeros(0, np.uint64)


def contained(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    """Share of sketch ``a`` in ``b``; an empty ``a`` is in ``b`` only if the texts are the ``same``."""
    if len(a) == 0 or same:
        return 1.0 if same else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by the start of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _deal(bounds: list[int], first: int | None, nulls: bool):
    """Adds each row's run, and copies each run's first documents to the run before it."""
    limits = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy()
            at = np.where(null, 0, np.searchsorted(limits, plain, side="right")).astype(np.int32)
            yield _with(batch, at, False)
            heads = ~null & (at > 0) & (limits[np.maximum(at - 1, 0)] == plain) if len(limits) else np.zeros(len(at), bool)
            start = null if nulls else ~null & (plain == first)
            for pick, to in ((heads, at - 1), (start, np.full(len(at), len(limits), np.int32))):
                rows = np.flatnonzero(pick)
                if len(rows):
                    yield _with(batch.take(pa.array(rows)), to[rows], True)
    return run


def _with(batch: pa.RecordBatch, run: np.ndarray, ahead: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(run, pa.int32()), pa.array(np.full(batch.num_rows, ahead))],
        names=["doc_id", "text", "row_key", "run", "ahead"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (run, ahead, doc_id, row_key): each with its successor's text."""
    held, done = None, -1  # the document that waits for its successor; the last run finished
    for batch in batches:
        for part in W.slices(batch, "text", W.BATCH_BYTES // 2):
            texts, pairs = [], []  # texts in order; (doc_id, place, place of successor)
            for doc_id, text, run, ahead in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(),
                                                part.column("run").to_pylist(), part.column("ahead").to_pylist()):
                if run == done:
                    continue  # a further copy of the next run's first document
                if held is not None and not texts:
                    texts.append(held[1])
                    held = (held[0], held[1], 0)
                texts.append(text or "")
                if held is not None:
                    pairs.append((held[0], held[2], len(texts) - 1))
                held = None if ahead else (doc_id, text or "", len(texts) - 1)
                done = run if ahead else done
            if pairs:
                yield _result(texts, pairs)


def _result(texts: list[str], pairs: list[tuple]) -> pa.RecordBatch:
    own = sketches(texts)
    edited = [edit(texts[i], texts[j]) for _, i, j in pairs]
    other = sketches(edited)
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _, _ in pairs], pa.int64()),
        pa.array([len(texts[i]) for _, i, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array([encode(texts[i], own[i]) for _, i, _ in pairs]),
        pa.array([encode(e, s) for e, s in zip(edited, other)]),
        pa.array([contained(own[i], s, texts[i] == e) for (_, i, _), e, s in zip(pairs, edited, other)], pa.float64()),
        pa.array([contained(own[i], own[j], texts[i] == texts[j]) for _, i, j in pairs], pa.float64()),
    ], names=[c.split()[0] for c in _OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row of ``docs(doc_id, text)``; null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([encode(t, s) for t, s in zip(texts, sketches(texts))], pa.string())],
                    names=["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs(doc_id, text)`` and of its edited text.

    ``near_edited`` and ``near_next`` are the shares of the row's sketch in the sketch of the
    edited text and of the next document (0 to 1).  The next document is the next row by
    (doc_id, hash of the text), null doc_ids first; after the last comes the first, so a
    single row follows itself.  Null texts count as empty.  A text without shingles has an
    empty sketch, alike only to an equal text.  Other columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"),
                     F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    runs = max(1, min(MAX_RUNS, found.n // ROWS_PER_RUN))
    marks = docs.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)] or [0.5], max(10_000, 4 * runs)).alias("b")).first().b
    bounds = sorted({b for b in marks or [] if runs > 1 and b > found.first})
    dealt = docs.withColumn("row_key", F.xxhash64("text")).mapInArrow(_deal(bounds, found.first, bool(found.nulls)), _ROWS)
    ordered = dealt.repartition("run").sortWithinPartitions("run", "ahead", "doc_id", "row_key")
    return ordered.mapInArrow(_walk, _OUT)
