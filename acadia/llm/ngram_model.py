"""Interpolated modified Kneser-Ney model over words, counted in Spark, read through memory maps.

Counting: every task counts the n-grams of bounded chunks of text and sends them, packed, to
the shard of their context; a shard's task adds them up, writes its n-grams as a sorted array
of 64-bit hashes beside their counts, and passes on how many different words stand before
each shorter n-gram, which the next order adds up in the same way.  A context that holds
more than about one shard's share of all tokens is dealt by the whole n-gram instead.

Scoring: workers memory-map the shards that a chunk of text asks for and look its different
n-grams up in order.  Nothing but the discounts, the frequent contexts and file names travels
with the tasks; the model lies in the shared folder and is never gathered.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import _words as W
from ._store import staged

CHUNK_BYTES = 8 << 20  # text counted at a time; some twenty times that in arrays
SCORED_BYTES = 4 << 20  # text scored at a time
SHARD_BYTES = 16 << 20  # text whose n-grams make one shard
MOST_SHARES = 1 << 16  # contexts are split from a share of one in this many tokens, or one shard's
OPEN_MAPS = 256
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64

# Arrays of a packed run of n-grams, of a shard of n-grams, and of its contexts.  Counts are
# bytes; those from 255 on are listed by place.
_COUNT = lambda n: [(n, "u1"), (f"{n}_at", "i8"), (f"{n}_of", "i8")]
_RUN = [("ctx", "u8"), *_COUNT("runs"), ("last", "u8"), *_COUNT("adjusted"), *_COUNT("raw")]
_SHARD = [("key", "u8"), *_COUNT("adjusted"), *_COUNT("raw"), ("ctx", "u8"), *_COUNT("total"), *_COUNT("n1"), *_COUNT("n2"), *_COUNT("n3")]

_COUNTED = "shard int, blob binary"
_REDUCED = "kind string, shard int, key long, n1 long, n2 long, n3 long, n4 long, total long, size long, blob binary"


def _coded(name: str, v: np.ndarray) -> dict:
    at = np.flatnonzero(v >= 255)
    return {name: np.minimum(v, 255).astype(np.uint8), f"{name}_at": at.astype(np.int64), f"{name}_of": v[at].astype(np.int64)}


def _counts(arrays: dict, name: str, places: np.ndarray | None = None) -> np.ndarray:
    codes = arrays[name] if places is None else arrays[name][places]
    out = codes.astype(np.int64)
    big = np.flatnonzero(codes == 255)
    if len(big):
        at = big if places is None else places[big]
        out[big] = arrays[f"{name}_of"][np.searchsorted(arrays[f"{name}_at"], at)]
    return out


def _dump(arrays: dict, kinds: list) -> bytes:
    """The arrays one after another, eight-byte ones first, behind their lengths."""
    kinds = sorted(kinds, key=lambda x: x[1] == "u1")
    sizes = np.array([len(arrays[n]) for n, _ in kinds], np.int64)
    return b"".join([sizes.tobytes(), *(np.ascontiguousarray(arrays[n], dtype=t).tobytes() for n, t in kinds)])


def _parse(data: np.ndarray, kinds: list) -> dict:
    kinds = sorted(kinds, key=lambda x: x[1] == "u1")
    sizes = np.frombuffer(data[:8 * len(kinds)], np.int64)
    out, at = {}, 8 * len(kinds)
    for (name, kind), n in zip(kinds, sizes.tolist()):
        end = at + n * np.dtype(kind).itemsize
        out[name] = data[at:end].view(kind)
        at = end
    return out


# Files in the shared folder.

def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _write(path: str, data: bytes) -> None:
    """Whole or not at all: a repeated attempt replaces the file with the same bytes."""
    fs, path = _located(path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        out.write(data)
    fs.move(attempt, path)


def _mapped(path: str) -> np.ndarray:
    """The file's bytes as a memory map; a file that is not on a mounted file system is copied
    into one of the task's own, which goes when it is closed."""
    fs, at = _located(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, np.uint8, "r")
    with fs.open_input_stream(at) as source, tempfile.TemporaryFile() as copy:
        while block := source.read(8 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")


class _Maps:
    """The shards opened last."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()

    def __call__(self, order: int, shard: int) -> dict:
        if (order, shard) not in self.open:
            if len(self.open) >= OPEN_MAPS:
                self.open.popitem(last=False)
            self.open[order, shard] = _parse(_mapped(self.model.path(order, shard)), _SHARD)
        self.open.move_to_end((order, shard))
        return self.open[order, shard]


# Tokens and n-grams of a chunk.

def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text, A-Z lower-cased, and one end; and each text's offsets."""
    raw, offsets = W.text_buffer(texts)
    raw = _LOWER[raw]
    starts, ends, rows = W.word_spans(raw, offsets)
    words, n = W.word_hashes(raw, starts, ends), len(rows) - 1
    out = np.empty(len(words) + n, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(rows))] = words
    out[rows[1:] + np.arange(n)] = END
    return out, rows + np.arange(n + 1)


def _grams(toks: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of the n-gram that ends at each token; before a text's start stand BEGINs."""
    place = np.arange(len(toks)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for back in range(order - 1, 0, -1):
        column = np.full(len(toks), BEGIN)
        column[back:] = toks[:-back]
        column[place < back] = BEGIN
        out.append(column)
    return [*out, toks]


def _fold(columns: list[np.ndarray], size: int) -> np.ndarray:
    key = np.zeros(size, np.uint64)
    for column in columns:
        key = W.mix(key * _ODD + column)
    return key


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in W.slices(batch, "text", limit):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def _dealt(ctx: np.ndarray, key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What an n-gram is dealt by: its context, or for a frequent context the whole n-gram."""
    return np.where(np.isin(ctx, hot), key, ctx) if len(hot) else ctx


def _shard(dealt: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, so shards rise with ``dealt``."""
    return ((dealt >> _U(32)) * _U(shards) >> _U(32)).astype(np.int32)


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _packed(columns: list[np.ndarray], adjusted: np.ndarray, raw: np.ndarray | None, hot: np.ndarray | None,
            shards: int) -> Iterator[tuple[int, bytes]]:
    """Different n-grams packed by shard: runs of one context share it.  ``hot`` is None for
    single words, which are dealt by themselves."""
    n = len(adjusted)
    ctx = _fold(columns[:-1], n)
    key = W.mix(ctx * _ODD + columns[-1])
    dealt = key if hot is None else _dealt(ctx, key, hot)
    order = np.argsort(dealt)
    shard, ctx = _shard(dealt[order], shards), ctx[order]
    cuts = _firsts(shard)
    for a, b in zip(cuts, [*cuts[1:], n]):
        part = order[a:b]
        starts = _firsts(ctx[a:b])
        arrays = {"ctx": np.concatenate([c[part][starts] for c in columns[:-1]] or [np.zeros(0, np.uint64)]), "last": columns[-1][part],
                  **_coded("runs", np.diff([*starts, b - a])), **_coded("adjusted", adjusted[part]),
                  **_coded("raw", np.zeros(0, np.int64) if raw is None else raw[part])}
        yield int(shard[a]), _dump(arrays, _RUN)


def _unpacked(blobs: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    columns, adjusted, raw = [[] for _ in range(order)], [], []
    for blob in blobs:
        run = _parse(np.frombuffer(blob, np.uint8), _RUN)
        runs = _counts(run, "runs")
        for j, ctx in enumerate(run["ctx"].reshape(order - 1, -1) if order > 1 else []):
            columns[j].append(np.repeat(ctx, runs))
        columns[-1].append(run["last"])
        adjusted.append(_counts(run, "adjusted"))
        raw.append(_counts(run, "raw") if len(run["raw"]) else adjusted[-1])
    return [np.concatenate(c) for c in columns], np.concatenate(adjusted), np.concatenate(raw)


# The model.

@dataclass
class Model:
    """What tasks need besides the shards: sizes, discounts and the frequent contexts."""

    folder: str
    order: int
    shards: int
    tokens: int = 0  # tokens of the training texts
    words: int = 0  # different ones
    hot: dict = field(default_factory=dict)  # order -> frequent contexts, sorted
    hot_counts: dict = field(default_factory=dict)  # order -> their total, n1, n2, n3
    written: dict = field(default_factory=dict)  # order -> shards with n-grams
    discounts: dict = field(default_factory=dict)  # order -> D1, D2, D3+
    continuations: int = 0  # sum of the single words' adjusted counts
    left: float = 1.0  # the share of single words' probability that goes to all words alike

    def path(self, order: int, shard: int) -> str:
        return f"{self.folder}/{order}/{shard:07d}"


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; 0.5, 1 and 1.5 where those do not
    give discounts above nothing and within the count."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d <= c else fallback for d, c, fallback in zip(found, (1, 2, 3), (0.5, 1.0, 1.5)))


def _frequent(order: int, shares: int):
    """Contexts with at least one in ``2 * shares`` of a chunk's tokens, and the chunk's tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK_BYTES):
            toks, offsets = tokens(chunk.column("text"))
            columns = _grams(toks, offsets, order)
            orders, keys, sizes = [0], [np.zeros(1, np.uint64)], [np.array([len(toks)])]
            for k in range(2, order + 1):
                key, n = np.unique(_fold(columns[order - k:-1], len(toks)), return_counts=True)
                often = n * 2 * shares >= len(toks)
                orders += [k] * int(often.sum())
                keys.append(key[often])
                sizes.append(n[often])
            yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)),
                                              pa.array(np.concatenate(sizes), pa.int64())], names=["k", "key", "n"])
    return run


def _count(order: int, hot: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK_BYTES):
            toks, offsets = tokens(chunk.column("text"))
            columns = _grams(toks, offsets, order)
            key = _fold(columns, len(toks))
            by = np.argsort(key)
            starts = _firsts(key[by])
            n, pick = np.diff([*starts, len(by)]), by[starts]
            for shard, blob in _packed([c[pick] for c in columns], n, None, hot, shards):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])
    return run


def _reduced(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in _REDUCED.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _reduce(model: Model, order: int):
    """Rows (shard, blob) in order of shard: writes each shard's arrays; yields its counts of
    counts, its part of the frequent contexts, and the shorter n-grams for the next order."""
    hot = model.hot.get(order, np.zeros(0, np.uint64))
    below = model.hot.get(order - 1, np.zeros(0, np.uint64)) if order > 2 else None

    def one(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns, adjusted, raw = _unpacked(blobs, order)
        key = _fold(columns, len(raw))
        by = np.argsort(key)
        starts = _firsts(key[by])
        key, columns = key[by][starts], [c[by[starts]] for c in columns]
        adjusted, raw = np.add.reduceat(adjusted[by], starts), np.add.reduceat(raw[by], starts)
        arrays = {"key": key, **_coded("adjusted", adjusted), **_coded("raw", raw if order == 1 else raw[:0])}
        counted = [int((adjusted == c).sum()) for c in (1, 2, 3, 4)]
        rows = [("stat", shard, None, *counted, int(adjusted.sum() if order == 1 else raw.sum()), len(key), None)]

        contexts, stats = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 4
        if order > 1:
            ctx = _fold(columns[:-1], len(key))
            at = np.argsort(ctx)
            cuts = _firsts(ctx[at])
            a = adjusted[at]
            contexts, stats = ctx[at][cuts], [np.add.reduceat(x, cuts) for x in (a, (a == 1).astype(int), (a == 2).astype(int), (a > 2).astype(int))]
            often = np.isin(contexts, hot)
            rows += [("hot", None, int(k), n1, n2, n3, None, t, None, None) for k, t, n1, n2, n3 in
                     zip(contexts[often].view(np.int64), *(s[often].tolist() for s in stats))]
            contexts, stats = contexts[~often], [s[~often] for s in stats]
        for name, v in zip(("total", "n1", "n2", "n3"), stats):
            arrays |= _coded(name, v)
        _write(model.path(order, shard), _dump(arrays | {"ctx": contexts}, _SHARD))
        yield _reduced(rows)

        if order > 1:  # a shorter n-gram counts once for each word before it; at a text's start as often as it occurs
            shorter = columns[1:]
            once = np.where(shorter[0] == BEGIN, raw, 1)
            key = _fold(shorter, len(raw))
            by = np.argsort(key)
            starts = _firsts(key[by])
            once, raw = np.add.reduceat(once[by], starts), np.add.reduceat(raw[by], starts)
            for to, blob in _packed([c[by[starts]] for c in shorter], once, raw, below, model.shards):
                yield _reduced([("shorter", to, None, None, None, None, None, None, None, blob)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                if shard != now and blobs:
                    yield from one(now, blobs)
                    blobs = []
                now = shard
                blobs.append(blob)
        if blobs:
            yield from one(now, blobs)
    return run


def train(docs: DataFrame, order: int = 2, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts the n-grams up to ``order`` of every text of ``docs(text)``.

    A text's tokens are its words (runs of other than space, tab, LF, VT, FF, CR; A-Z
    lower-cased) and one end; a null text is empty.  The shards go to ``folder``, by default
    a new one in the session's shared folder; a shard holds those of about ``shard_bytes`` of
    text, and its task ten times that.  Collected to the driver: a row per order, and
    at most twice MOST_SHARES frequent contexts of each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(1, math.ceil(size / shard_bytes))
    shares = min(shards, MOST_SHARES)
    model = Model(folder or f"{checkpoint_dir(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}", order, shards)
    if order > 1:
        often = staged(docs.mapInArrow(_frequent(order, shares), "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n")), "frequent")
        total = often.where("k = 0").agg(F.sum("n").alias("n")).first().n or 0
        rows = often.where((F.col("k") > 0) & (F.col("n") * 2 * shares >= total)).collect()
        model.hot = {k: np.sort(np.array([r.key for r in rows if r.k == k], np.int64).view(np.uint64)) for k in range(2, order + 1)}
    counted = docs.mapInArrow(_count(order, model.hot.get(order) if order > 1 else None, shards), _COUNTED)
    for k in range(order, 0, -1):
        dealt = counted.repartition(shards, "shard").sortWithinPartitions("shard")
        reduced = staged(dealt.mapInArrow(_reduce(model, k), _REDUCED), f"order-{k}")
        s = reduced.where("kind = 'stat'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "size")],
                                                     F.count("*").alias("files")).first()
        model.written[k] = s.files
        model.discounts[k] = discounts(s.n1, s.n2, s.n3, s.n4)
        if k == order:
            model.tokens = s.total
        if k == 1:
            model.words, model.continuations = s.size, s.total
            d = model.discounts[1]
            model.left = (d[0] * s.n1 + d[1] * s.n2 + d[2] * (s.size - s.n1 - s.n2)) / s.total if s.total else 1.0
        else:
            rows = reduced.where("kind = 'hot'").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3")]).collect()
            found = {np.int64(r.key).view(np.uint64).item(): (r.total, r.n1, r.n2, r.n3) for r in rows}
            model.hot_counts[k] = np.array([found.get(int(x), (0, 0, 0, 0)) for x in model.hot[k]], np.int64).reshape(-1, 4)
        counted = reduced.where("kind = 'shorter'").select("shard", "blob")
    return model


# Scoring.

def _look_up(maps: _Maps, order: int, asked: np.ndarray, shard: np.ndarray, array: str, names: tuple[str, ...]) -> list[np.ndarray]:
    """Counts of the sorted, different keys ``asked`` (0 if absent), shard by shard."""
    out = [np.zeros(len(asked), np.int64) for _ in names]
    by = np.argsort(shard, kind="stable")
    cuts = _firsts(shard[by])
    for a, b in zip(cuts, [*cuts[1:], len(by)]):
        pick = by[a:b]
        try:
            arrays = maps(order, int(shard[pick[0]]))
        except FileNotFoundError:
            if maps.model.written[order] == maps.model.shards:
                raise
            continue  # a shard without n-grams has no file
        keys = arrays[array]
        at = np.searchsorted(keys, asked[pick])
        hit = np.flatnonzero(at < len(keys))
        hit = hit[keys[at[hit]] == asked[pick[hit]]]
        for v, name in zip(out, names):
            v[pick[hit]] = _counts(arrays, name, at[hit])
    return out


def _taken(counts: np.ndarray, d: tuple) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


def _probabilities(model: Model, maps: _Maps, toks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its probability after the words before it, and its count in training."""
    columns = _grams(toks, offsets, model.order)
    key, back = np.unique(_fold([toks], len(toks)), return_inverse=True)
    adjusted, raw = _look_up(maps, 1, key, _shard(key, model.shards), "key", ("adjusted", "raw"))
    p = (_taken(adjusted, model.discounts[1]) / max(1, model.continuations) + model.left / (model.words + 1))[back]
    count = raw[back]
    for k in range(2, model.order + 1):
        ctx = _fold(columns[model.order - k:-1], len(toks))
        key, at, back = np.unique(W.mix(ctx * _ODD + toks), return_index=True, return_inverse=True)
        dealt = _dealt(ctx[at], key, model.hot[k])
        taken = _taken(_look_up(maps, k, key, _shard(dealt, model.shards), "key", ("adjusted",))[0], model.discounts[k])[back]
        key, back = np.unique(ctx, return_inverse=True)
        total, n1, n2, n3 = _look_up(maps, k, key, _shard(key, model.shards), "ctx", ("total", "n1", "n2", "n3"))
        if len(model.hot[k]):
            place = np.minimum(np.searchsorted(model.hot[k], key), len(model.hot[k]) - 1)
            often = model.hot[k][place] == key
            for j, v in enumerate((total, n1, n2, n3)):
                v[often] = model.hot_counts[k][place[often], j]
        d, size = model.discounts[k], np.maximum(total, 1)
        left = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / size, 1.0)
        p = taken / size[back] + left[back] * p
    return p, count


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = _Maps(model)
        for chunk in _chunks(batches, SCORED_BYTES):
            toks, offsets = tokens(chunk.column("text"))
            p, count = _probabilities(model, maps, toks, offsets)
            base = np.log10((count + 1) / (model.tokens + model.words + 1))
            at, n = offsets[:-1], np.diff(offsets)
            score = np.add.reduceat(np.log10(p), at)
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(i) for i in range(chunk.num_columns - 1)), pa.array(n, pa.int64()),
                 pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(len(n), model.tokens), pa.int64()),
                 pa.array(np.add.reduceat(base, at)), pa.array(score), pa.array(10 ** (-score / n))],
                names=[*chunk.schema.names[:-1], *(c.split()[0] for c in _SCORES.split(", "))])
    return run


_SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Each row's columns ``keep`` and, of its whole text, the tokens, those known from training,
    the training tokens, log10 probabilities and perplexity.

    ``base_score`` is that of single words with one added to every count, ``score`` the
    model's: each order's discounted counts over their context's total, and what the
    discounts leave times the next shorter order's; single words end in an equal share for
    every training word and one unknown.  A null or empty text is its end alone.  Without
    training texts every token has probability 1.  Other columns are ignored; repeated rows
    are scored each; an empty table gives no rows.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    return rows.toDF(*keep, "text").mapInArrow(_score(model), f"{kinds}, {_SCORES}")


def held_out_scores(docs: DataFrame, order: int = 2, **kw) -> DataFrame:
    """``score`` of all rows of ``docs(doc_id, text)``, learnt from those whose crc32(doc_id as text)
    leaves another remainder by 7 than 2 (a row without doc_id teaches too)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    return score(docs, train(docs.where("not held_out"), order, **kw), ["doc_id", "held_out"])
