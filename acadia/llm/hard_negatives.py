"""Hard-negative mining by slot-decomposed selection.

An anchor's positives set the upper limits of its windows of negatives.  The limits, in
order, cut the scores into disjoint slots; every task keeps the first few rows of each slot
it sees, a reduce keeps the first few of each slot over all tasks, and a window is answered
from the slots at and below its limit, read downwards.  So overlapping windows share one
scoring of the rows.

Anchors are a query set against all rows, in blocks: rows are dealt into groups of bounded
bytes, and the anchors pass each group in a stream, multiplied with it tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import staged

GROUP_BYTES = 32 << 20
TILE_BYTES = 16 << 20
EXACT = 2.0**53  # sums of whole numbers below this are exact in doubles

_DEALT = "_group int, stream boolean, row_key long, vec_id long, label long, vector array<long>, limits array<long>"
_FOUND = "anchor_key long, slot int, score long, vec_id long, row_key long"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``; beyond a long they end at its limits."""
    def largest(m):
        return float(np.abs(m.astype(np.float64)).max(initial=0))

    if largest(a) * largest(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -2**63, 2**63 - 1).astype(np.int64).reshape(len(a), len(b))


def first(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Of ``places``, those of the ``k`` highest scores, higher ones first, ties by place."""
    own = scores[places]
    if len(own) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        above = np.flatnonzero(own > least)
        pick = np.concatenate([above, np.flatnonzero(own == least)[:k - len(above)]])
        places, own = places[pick], own[pick]
    return places[np.lexsort((places, ~own))]


class _Group:
    """The rows of one group, in order of vec_id (nulls last), then of their own key."""

    def __init__(self, parts: list[tuple], width: int):
        keys, ids, null, labels, vectors = (np.concatenate([p[i] for p in parts]) for i in range(5)) if parts else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, width), np.int64))
        order = np.lexsort((keys, ids, null))
        self.keys, self.ids, self.null, self.labels, self.vectors = (x[order] for x in (keys, ids, null, labels, vectors))


def _columns(batch: pa.RecordBatch, width: int) -> tuple:
    ids = batch.column("vec_id")
    return (batch.column("row_key").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
            batch.column("label").to_numpy(), _matrix(batch.column("vector"), width))


def _pass(width: int, choose: Callable) -> Callable:
    """Streams rows in order of (_group, stream): a group's rows are held, then its anchors meet them.

    ``choose(scores, label_is_same, is_itself, limits)`` yields (slot, places) for one anchor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, group = None, [], None
        for batch in batches:
            groups, stream = batch.column("_group").to_numpy(), batch.column("stream").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(stream.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(groups)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if groups[a] != now:
                    now, parts, group = groups[a], [], None
                if not stream[a]:
                    parts.append(_columns(part, width))
                    continue
                if group is None:
                    group, parts = _Group(parts, width), []
                yield from _met(part, group)

    def _met(anchors: pa.RecordBatch, group: _Group) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE_BYTES // (8 * max(1, len(group.keys))))
        for a in range(0, anchors.num_rows, step):
            part = anchors.slice(a, step)
            keys, _, _, labels, vectors = _columns(part, width)
            limits = part.column("limits").to_pylist()
            scores = inner_products(vectors, group.vectors)
            out = []
            for i, key in enumerate(keys):
                for slot, places in choose(scores[i], group.labels == labels[i], group.keys == key, limits[i]):
                    out.append((np.full(len(places), key), np.full(len(places), slot), scores[i][places], places))
            if out:
                key, slot, score, places = (np.concatenate([o[j] for o in out]) for j in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()),
                     pa.array(group.ids[places], pa.int64(), mask=group.null[places]), pa.array(group.keys[places], pa.int64())],
                    names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _positives(k: int) -> Callable:
    def choose(scores, same, itself, limits):
        yield 0, first(scores, np.flatnonzero(same & ~itself), k)
    return choose


def _negatives(k: int) -> Callable:
    """``limits`` ascend; slot j holds the scores above limit j - 1 up to limit j."""
    def choose(scores, same, itself, limits):
        other = np.flatnonzero(~same & (scores <= limits[-1]))
        slots = np.searchsorted(np.array(limits, np.int64), scores[other], side="left")
        for j in range(len(limits)):
            yield j, first(scores, other[slots == j], k)
    return choose


def _score(rows: DataFrame, anchors: DataFrame, groups: int, width: int, choose: Callable) -> DataFrame:
    """Every row meets every anchor, in ``groups`` groups of rows; anchors go to each."""
    own = rows.select(F.pmod(F.xxhash64("row_key"), F.lit(groups)).cast("int").alias("_group"), F.lit(False).alias("stream"),
                      "row_key", "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("limits"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(True).alias("stream"),
                           "row_key", "vec_id", "label", "vector", "limits")
    dealt = own.unionByName(asked).repartition(groups, "_group").sortWithinPartitions("_group", "stream")
    return dealt.mapInArrow(_pass(width, choose), _FOUND)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key: higher scores, then smaller ids (nulls last).  The rank
    limit works before the shuffle too, as a combiner."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Hard negatives of the anchors of ``rows(vec_id, label, vector)``: ``anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score``.

    ``vector`` holds whole numbers; a score is the inner product with the anchor.  Higher scores
    come first, ties by smaller vec_id (nulls last).  Positives: the first ``positives`` other
    rows of the anchor's label; all, if fewer.  For each, the first ``negatives`` rows of other
    labels whose score is at most the positive's and, times share[1], at least share[0] times
    it.  A positive with a negative score has no such rows.

    Rows with a null label or vector, or a null in the vector, take no part.  Rows that repeat
    a vec_id, or have none, are rows of their own; a null vec_id is no anchor unless ``is_anchor``
    says so.  Shorter vectors count as ending in zeros.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = rows.sparkSession
    whole = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"),
                       F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where(whole)
    # Written once, so that each row's own key is the same for every reader.
    rows = staged(rows.withColumn("row_key", F.monotonically_increasing_id()), "vectors")
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    width = max(1, found.width)
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(found.n / 2048))
    groups = max(1, spread, math.ceil(found.n * 8 * width / GROUP_BYTES))

    anchors = rows.where("anchor").withColumn("limits", F.lit(None).cast("array<long>"))
    pairs = staged(_best(_score(rows, anchors, groups, width, _positives(positives)), ["anchor_key"], positives).select(
        "anchor_key", F.col("vec_id").alias("positive_id"), F.col("row_key").alias("positive_key"), F.col("score").alias("positive_score")), "positives")
    limits = pairs.groupBy(F.col("anchor_key").alias("row_key")).agg(F.array_sort(F.collect_set("positive_score")).alias("limits"))
    asked = staged(anchors.drop("limits").join(limits, "row_key"), "anchors")
    slots = _best(_score(rows, asked, groups, width, _negatives(negatives)), ["anchor_key", "slot"], negatives).drop("rank")

    # The window of a positive reads the slots at and below its limit: of each the first few.
    windows = pairs.join(limits.withColumnRenamed("row_key", "anchor_key"), "anchor_key").withColumn(
        "top", F.array_position("limits", F.col("positive_score")) - 1).drop("limits")
    wide = [F.col(c).cast("decimal(38,0)") for c in ("score", "positive_score")]
    inside = windows.join(slots, "anchor_key").where((F.col("slot") <= F.col("top")) & (wide[0] * share[1] >= wide[1] * share[0]))
    ranked = _best(inside, ["anchor_key", "positive_key"], negatives)
    ids = asked.select(F.col("row_key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(ids, "anchor_key").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``embeddings(vec_id, embedding, label)`` in whole numbers: ``vec_id, label, vector``, each
    component floor(scale * x).  Vectors with a null or non-finite component become null."""
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = F.when(usable, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
