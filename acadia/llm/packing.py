"""Packing documents into training sequences by non-negative least squares.

Every document becomes token ids and an end mark.  Whole windows of it are sequences of their
own; the rest of each document is a piece of 1 to ``window`` - 1 tokens.  The lengths of the
pieces are counted in bins.  All ways to fill a window with up to three bins are enumerated,
non-negative least squares solves how often to use each so that the bins' counts come out,
the solution is rounded down, and what is left is packed greedily, largest first.

The plan is made on the histogram, whose size depends on the window alone.  Pieces find
their place by rank: a bin's pieces are ranked without being brought together (counts per
bin and chunk first), and rank intervals of the plan name sequence and slot.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._store import staged

END = 2
FINE, WIDTH = 128, 16  # bins: every length up to FINE, then steps of WIDTH
SLACK = 16  # a pattern fills a window up to less than this
CHUNK = 4096
_PIECES = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long"
_caches: dict[str, Vocabulary] = {}


class Vocabulary:
    """Token ids of words, remembered per Python worker.

    The tokenizer drops white space and never joins text across it, so a text's ids are its
    words' ids in order.  Words are looked up by their 64-bit hash; unknown ones are encoded
    many at a time, with a control character that has one id of its own between them.
    """

    LIMIT = 4_000_000  # words kept; beyond it the memory starts anew

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        marks = self._encode(["\x00"])[0]
        self.mark = marks[0] if len(marks) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        odd = [i for i, w in enumerate(words) if "\x00" in w or "<|" in w]
        plain = [w if "\x00" not in w and "<|" not in w else "" for w in words]
        if self.mark is None:
            odd, plain = list(range(len(words))), [""] * len(words)
        sizes, parts = np.zeros(len(words), np.int32), []
        for lo, ids in zip(range(0, len(words), 256), self._encode(
                [" \x00 ".join(plain[i:i + 256]) for i in range(0, len(words), 256)])):
            ids = np.array(ids, dtype=np.int32)
            cut = np.flatnonzero(ids == self.mark)
            edges = np.concatenate([[-1], cut, [len(ids)]])
            sizes[lo:lo + 256] = np.diff(edges) - 1
            parts.append(np.delete(ids, cut))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if odd:
            starts = np.concatenate([[0], np.cumsum(sizes)])
            own = dict(zip(odd, self._encode([words[i] for i in odd])))
            pieces = [np.array(own[i], np.int32) if i in own else flat[starts[i]:starts[i + 1]] for i in range(len(words))]
            sizes = np.array([len(p) for p in pieces], np.int32)
            flat = np.concatenate(pieces) if pieces else flat
        return flat, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's offsets into them."""
        raw, offsets = W.text_buffer(texts)
        starts, ends, rows = W.word_spans(raw, offsets)
        keys, first, which = np.unique(W.word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.LIMIT:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            words = [data[starts[i]:ends[i]].decode() for i in first[new]]
            flat, sizes = self._words(words)
            at = len(self.ids) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.ids = np.concatenate([self.ids, flat])
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.at, self.size = np.insert(self.at, place[new], at), np.insert(self.size, place[new], sizes)
            place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][which], self.size[place][which]
        ends_at = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(at - ends_at[:-1], size) + np.arange(ends_at[-1])]
        return flat, ends_at[rows]


def vocabulary(path: str) -> Vocabulary:
    if path not in _caches:
        _caches[path] = Vocabulary(path)
    return _caches[path]


def _pieces(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in W.slices(batch, "text", W.BATCH_BYTES // 2):
                ids, offsets = words.encode(part.column("text"))
                out = []
                for doc_id, key, a, b in zip(part.column("doc_id").to_pylist(), part.column("row_key").to_pylist(),
                                             offsets[:-1], offsets[1:]):
                    own = np.append(ids[a:b], END).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start:start + window]
                        out.append((doc_id, key, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=[c.split()[0] for c in _PIECES.split(", ")])
    return run


def bin_edges(window: int) -> np.ndarray:
    """Largest length of each bin; the last bin is the full window."""
    fine = min(FINE, window - 1)
    wide = np.arange(fine + WIDTH, window - 1, WIDTH)
    return np.unique(np.concatenate([np.arange(1, fine + 1), wide, [window - 1] if window > 1 else [], [window]])).astype(np.int64)


def patterns(edges: np.ndarray, window: int) -> np.ndarray:
    """All fillings of a window by one to three bins (falling; -1: none), by their upper edges,
    that leave less than ``SLACK``."""
    out = []
    small = edges[:-1]
    for a in range(len(small)):
        left = window - small[a]
        if left < SLACK:
            out.append((a, -1, -1))
        b = np.arange(0, min(a, np.searchsorted(small, left, side="right") - 1) + 1)
        rest = left - small[b]
        done = rest < SLACK
        out.extend((a, int(x), -1) for x in b[done])
        c = np.searchsorted(small, rest, side="right") - 1
        c = np.minimum(c, b)
        good = ~done & (c >= 0) & (rest - small[np.maximum(c, 0)] < SLACK)
        out.extend((a, int(x), int(y)) for x, y in zip(b[good], c[good]))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def solve_counts(table: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeats ``x >= 0`` of the patterns that minimise ``|A x - histogram|``, ``A`` being the
    patterns' bin counts, by multiplicative updates from a flat start."""
    x = np.full(len(table), max(1.0, histogram.sum() / max(1, 3 * len(table))))
    n = len(histogram)
    cols = np.where(table < 0, n, table)

    def down(v: np.ndarray) -> np.ndarray:  # A^T v
        return np.append(v, 0.0)[cols].sum(axis=1)

    def up(y: np.ndarray) -> np.ndarray:  # A y
        return np.bincount(cols.ravel(), weights=np.repeat(y, 3), minlength=n + 1)[:n]

    aim = down(histogram.astype(float))
    for _ in range(steps):
        x *= aim / np.maximum(down(up(x)), 1e-9)
    return x


def plan(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rank intervals ``(bin, first rank, repeats, first sequence, slot)`` that place every piece.

    Sequences ``first .. first + repeats - 1`` hold in this slot the bin's pieces of ranks
    ``first rank .. first rank + repeats - 1``.
    """
    edges = bin_edges(window)
    left, used = histogram.astype(np.int64).copy(), np.zeros(len(edges), np.int64)
    rows, sequence = [], 0

    def use(bins: list[int], times: int):
        nonlocal sequence
        for slot, b in enumerate(bins):
            rows.append((b, used[b], times, sequence, slot))
            used[b] += times
            left[b] -= times
        sequence += times

    if left[-1]:
        use([len(edges) - 1], int(left[-1]))
    table = patterns(edges, window)
    if len(table) and left.sum():
        x = solve_counts(table, left[:-1])
        for k in np.argsort(-x, kind="stable"):
            times = int(x[k])
            if times < 1:
                break
            bins = [int(b) for b in table[k] if b >= 0]
            for b in set(bins):
                times = min(times, int(left[b]) // bins.count(b))
            if times > 0:
                use(bins, times)
    while left.any():  # greedy: the largest piece, then always the largest that still fits
        room, bins, taken = window, [], np.zeros(len(edges), np.int64)
        top = len(edges) - 1
        while room > 0:
            top = min(top, int(np.searchsorted(edges, room, side="right")) - 1)
            while top >= 0 and left[top] - taken[top] <= 0:
                top -= 1
            if top < 0:
                break
            bins.append(top)
            taken[top] += 1
            room -= int(edges[top])
        some = np.flatnonzero(taken)
        use(bins, int((left[some] // taken[some]).min()))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _place(rows: np.ndarray):
    """Sequence and slot of each ranked piece, from the plan's intervals."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    bins = rows[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, rank = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(b), np.int64)
            for k in np.unique(b):
                lo, hi = np.searchsorted(bins, [k, k + 1])
                mine = b == k
                at[mine] = lo + np.searchsorted(rows[lo:hi, 1], rank[mine], side="right") - 1
            hit = rows[at]
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece.

    ``docs(doc_id, text)``; ``tokenizer`` is the path of a tokenizers file whose model keeps
    words apart at white space, present on every executor.  A document's ids are the
    tokenizer's, without special tokens, and the end mark 2; a null or empty text is the mark
    alone.  Every id is in exactly one piece, and a sequence's pieces follow each other from
    offset 0.  Rows that repeat a doc_id are packed one by one; other columns are ignored; an
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("row_key"))
    edges = bin_edges(window)
    pieces = docs.mapInArrow(_pieces(tokenizer, window), _PIECES)
    fine, full = min(FINE, window - 1), len(edges) - 1
    wide = F.lit(fine - 1) + F.ceil((F.col("length") - fine) / WIDTH)
    at = F.when(F.col("length") <= fine, F.col("length") - 1).when(F.col("length") == window, full).otherwise(
        F.least(wide, F.lit(full - 1)))
    pieces = staged(pieces.withColumn("bin", at.cast("long")), "pack-pieces")
    chunks = pieces.count() // CHUNK + 1
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(chunks)).cast("int"))
    counts = staged(pieces.groupBy("bin", "chunk").agg(F.count("*").alias("n")), "pack-counts")
    histogram = np.zeros(len(edges), np.int64)
    for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most one row per bin
        histogram[row["bin"]] = row["n"]
    rows = plan(histogram, window)
    before = Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("bin", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bin", "chunk").orderBy("doc_id", "row_key", "start")
    ranked = (pieces.withColumn("_n", F.row_number().over(within)).join(base, ["bin", "chunk"])
              .withColumn("rank", (F.col("base") + F.col("_n") - 1).cast("long")))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank").mapInArrow(
        _place(rows), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("slot")
