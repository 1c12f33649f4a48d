"""The comparison of line sets in numpy, on Arrow batches: what ``line_dedup`` did before it
was put in DataFrame operations.  No query runs it; tests hold the DataFrame form against it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _words as W
from .jaccard_join import _overlaps

SHINGLE = 12
BATCH_BYTES = 1 << 20
STEP = 1 << 15


def _run_hashes(raw: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hash of the ``SHINGLE`` characters from each character on, as ``W.word_hashes`` gives it;
    ``chars`` is where each character starts, and the end."""
    power, inverse = W._pow()
    out = np.empty(max(len(chars) - SHINGLE, 0), dtype=np.uint64)
    for lo in range(0, len(out), STEP):
        at = chars[lo:lo + STEP + SHINGLE]
        a, b = int(at[0]), int(at[-1])
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(W._BYTE[raw[a:b]] * power[:b - a], out=total[1:])
        at = at - a
        sums = total[at]
        out[lo:lo + STEP] = W.mix((sums[SHINGLE:] - sums[:-SHINGLE]) * inverse[at[:-SHINGLE]] + (at[SHINGLE:] - at[:-SHINGLE]).astype(np.uint64))
    return out


def shingle_hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of each line (with repeats), and each line's offsets
    into them.  An empty line has one as well."""
    raw, offsets = W.text_buffer(lines)
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character starts
    at = np.searchsorted(chars, offsets)
    first, last = at[:-1], at[1:]
    cuts = np.concatenate([[0], np.cumsum(np.maximum(last - first - SHINGLE + 1, 1))])
    short = last - first < SHINGLE
    inside = np.zeros(len(chars) + 1, dtype=np.int8)
    inside[first[~short]] = 1
    inside[last[~short] - SHINGLE + 1] = -1
    runs = _run_hashes(raw, chars)
    runs = runs[np.cumsum(inside[:len(runs)], dtype=np.int8).view(bool)]
    if not short.any():
        return runs, cuts
    out, long = np.empty(cuts[-1], dtype=np.uint64), np.ones(cuts[-1], dtype=bool)
    long[cuts[:-1][short]] = False
    out[long] = runs
    out[~long] = W.word_hashes(raw, offsets[:-1][short], offsets[1:][short])
    return out, cuts


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The set of ``hashes``, in order."""
    own = np.sort(hashes)
    new = own[1:] != own[:-1]
    return own if new.all() else own[np.append(True, new)]


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches the threshold."""
    if threshold * max(len(a), len(b)) > min(len(a), len(b)) + 1e-9:
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= threshold * (len(both) - shared) - 1e-9


def _verify_unit(sets: list[np.ndarray], components: list[tuple], minor: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The links (two places) that connect the components of one unit: a spanning forest."""
    names = {}
    component = np.array([names.setdefault(c, len(names)) for c in components])
    left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
    parent, links = list(range(len(names))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(left) * len(right) <= 16:
        known, near = False, ((i, j) for i in left.tolist() for j in right.tolist())
    else:
        lens = np.array([len(s) for s in sets])
        inter = _overlaps(sets, left, right)
        close = inter >= threshold * (lens[left][:, None] + lens[right][None, :] - inter) - 1e-9
        a, b = np.nonzero(close & (component[left][:, None] != component[right][None, :]))
        a, b = left[a], right[b]
        at = np.unique(component[a] * len(names) + component[b], return_index=True)[1]
        known, near = True, zip(a[at].tolist(), b[at].tolist())
    for i, j in near:
        x, y = root(component[i]), root(component[j])
        if x != y and (known or _alike(sets[i], sets[j], threshold)):
            parent[x] = y
            links.append((i, j))
    return links


def _verify(threshold: float):
    def unit_links(batch: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        """Links of the units that start at ``cuts`` (the last one is the end)."""
        component = list(zip(*(batch.column("component").field(c).to_pylist() for c in ("c1", "c2"))))
        minor = batch.column("minor").to_numpy(zero_copy_only=False)
        sizes = np.append(0, np.cumsum(pc.binary_length(batch.column("line")).to_numpy()))
        links, lo = [], 0
        while lo < len(cuts) - 1:  # some units at a time, as their shingles are held at once
            hi = max(int(np.searchsorted(sizes[cuts], sizes[cuts[lo]] + BATCH_BYTES, side="right")) - 1, lo + 1)
            start, end = int(cuts[lo]), int(cuts[hi])
            hashes, at = shingle_hashes(batch.column("line").slice(start, end - start))
            for a, b in zip(cuts[lo:hi].tolist(), cuts[lo + 1:hi + 1].tolist()):
                sets = [_distinct(hashes[at[k]:at[k + 1]]) for k in range(a - start, b - start)]
                links += [(a + i, a + j) for i, j in _verify_unit(sets, component[a:b], minor[a:b], threshold)]
            lo = hi
        cls = batch.column("cls")
        return pa.RecordBatch.from_arrays([cls.take(pa.array([x[k] for x in links], pa.int64())) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
            keys = [held[0].column(c).to_numpy() for c in ("band", "i", "j")]
            cuts = np.append(0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1)
            if len(cuts) > 1:
                yield unit_links(held[0], cuts)
                held = [held[0].slice(int(cuts[-1]))]
        for batch in held:
            yield unit_links(batch, np.array([0, batch.num_rows]))
    return run
