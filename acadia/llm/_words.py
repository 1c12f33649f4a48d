"""Words and word shingles of whole Arrow text columns, in numpy.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.  Hashes are
64-bit polynomials over random byte values (arithmetic modulo 2**64, finished by an
avalanche step), so a word has the same hash in every task.  Work is done in windows of
``WINDOW`` bytes, so temporary memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 19
BATCH_BYTES = 2 << 20
_U = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_TERM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _pow() -> list[np.ndarray]:
    """Powers of the base and of its inverse, one window long."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(WINDOW, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; null counts as empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and each row's offsets into them."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    power, inverse = _pow()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + WINDOW, side="right"))
        if j <= i:  # one word longer than a window: fold it window by window
            acc = np.zeros(1, np.uint64)
            for a in range(int(starts[i]), int(ends[i]), WINDOW):
                part = raw[a:min(a + WINDOW, int(ends[i]))]
                acc = mix(acc + np.sum(_BYTE[part] * power[:len(part)], dtype=np.uint64)[None])
            out[i] = acc[0]
            i += 1
            continue
        a, b = int(starts[i]), int(ends[j - 1])
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * power[:b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each row, and each row's offsets into them.

    A row with fewer than ``k`` words has one shingle of all its words; a row without
    words has none.
    """
    counts = np.diff(rows)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per)])
    if offsets[-1] == 0:
        return np.zeros(0, np.uint64), offsets
    first = np.repeat(rows[:-1] - offsets[:-1], per) + np.arange(offsets[-1])
    end = np.repeat(rows[1:], per)
    acc = np.zeros(len(first), dtype=np.uint64)
    for j in range(k):
        at = first + j
        here = at < end
        acc += np.where(here, words[np.minimum(at, len(words) - 1)], _U(j + 1)) * _TERM[j]
    return mix(acc), offsets


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word-shingle hashes of each text (with repeats) and row offsets."""
    raw, offsets = text_buffer(texts)
    starts, ends, rows = word_spans(raw, offsets)
    return shingle_hashes(word_hashes(raw, starts, ends), rows, k)


def minhash(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """``size`` 32-bit minima per row; rows without hashes get zeros."""
    seeds = np.random.default_rng(7).integers(1, 2**63, (size, 2), dtype=np.uint64)
    out = np.zeros((len(offsets) - 1, size), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full) == 0:
        return out
    at = offsets[full]
    for lo in range(0, len(full), 512):  # keeps a row group's hashes in the processor cache
        hi = min(lo + 512, len(full))
        a, b = at[lo], offsets[full[hi - 1] + 1]
        part, cuts = hashes[a:b], at[lo:hi] - a
        for k in range(size):
            v = part * (seeds[k, 0] | _U(1))
            v ^= seeds[k, 1]
            out[full[lo:hi], k] = np.minimum.reduceat(v, cuts) >> _U(32)
    return out
