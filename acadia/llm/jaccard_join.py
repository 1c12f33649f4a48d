"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Every text becomes its set of word ``n``-grams.  Texts with equal sets form one class, and
classes are what the join works on, so thousands of copies cost one row.  A class has
``TREES`` labels of ``DEPTH`` minima, the sorted prefix tries of the forest.  Classes that
share a prefix of a trie are candidates.  The join starts at full depth and shortens the
matched prefix; after each depth it verifies the candidates that are new.  It stops at the
depth where a pair that just meets the threshold is found with the target probability;
what other pairs there are does not matter.

Verification compares the whole shingle sets.  Members of a trie node are dealt into blocks
of bounded size, one task unit per pair of blocks, and a pair is compared only where it
first meets (earliest depth, lowest tree), so links are counted once without a table of
pairs.  Each unit returns link counts per class and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._components import components
from ._store import staged

TREES = 12
DEPTH = 8
DEPTHS = (8, 6, 5, 4, 3, 2, 1)
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000
BROADCAST_KEYS = 2_000_000
NODE = 4 * DEPTH

_SETS = "doc_id long, cls binary, label binary, n_shingles int"
_LINKS = "kind int, cls binary, other binary, links long"


def _class_key(own: np.ndarray) -> bytes | None:
    """128-bit name of a set of shingles; None for the empty set."""
    if len(own) == 0:
        return None
    other = W.mix(own ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([W.mix(own).sum(dtype=np.uint64), other.sum(dtype=np.uint64)]).astype(">u8").tobytes()


def _label(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                hashes, offsets = W.shingles(part.column("text"), n)
                labels = W.minhash(hashes, offsets, TREES * DEPTH).astype(">u4")
                sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([_class_key(s) for s in sets], pa.binary()),
                     pa.array([x.tobytes() for x in labels], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int32())],
                    names=["doc_id", "cls", "label", "n_shingles"])
    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                hashes, offsets = W.shingles(part.column("text"), n)
                labels = W.minhash(hashes, offsets, TREES * DEPTH).astype(">u4")
                sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class_key(s) for s in sets], pa.binary()), pa.array([x.tobytes() for x in labels], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "label", "shingles"])
    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every ``left`` set with every ``right`` set."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if len(left) * len(right) <= 16:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if a != b:
                    out[i, j] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    used = np.unique(np.concatenate([left, right]))
    rows = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    values, column, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    at_left, at_right = np.searchsorted(used, left), np.searchsorted(used, right)
    total = int(shared.sum())
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(used), min(4096, total - lo)), dtype=np.float32)
        m[rows[a:b], column[a:b] - lo] = 1
        out += np.rint(m[at_left] @ m[at_right].T).astype(np.int64)
    return out


def _met(labels: np.ndarray, i: int, js: np.ndarray, tree: int, depth: int, before: int) -> np.ndarray:
    """Which ``js`` first meet ``i`` at this tree and depth."""
    same = labels[js] == labels[i]
    new = same[:, tree, :depth].all(axis=1) & ~same[:, :tree, :depth].all(axis=2).any(axis=1)
    if before:
        new &= ~same[:, :, :before].all(axis=2).any(axis=1)
    return new


def _verify_unit(rows: list[dict], threshold: float, depth: int, before: int):
    """Links among the members of one unit: counts per class and forest edges."""
    tree, cross = rows[0]["tree"], rows[0]["lo"] != rows[0]["hi"]
    size = np.array([r["size"] for r in rows])
    side = np.array([r["block"] == r["hi"] for r in rows])
    labels = np.stack([np.frombuffer(r["label"], dtype=">u4") for r in rows]).reshape(len(rows), TREES, DEPTH)
    sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
    lens = np.array([len(s) for s in sets])
    left = np.flatnonzero(~side) if cross else np.arange(len(rows))
    right = np.flatnonzero(side) if cross else left
    links, parent = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for lo in range(0, len(left), 256):
        part = left[lo:lo + 256]
        inter = _overlaps(sets, part, right)
        union = lens[part][:, None] + lens[right][None, :] - inter
        close = inter >= threshold * union - 1e-9
        for a, i in enumerate(part):
            js = np.flatnonzero(close[a])
            js = js[right[js] > i] if not cross else js
            if len(js) == 0:
                continue
            js = js[_met(labels, i, right[js], tree, depth, before)]
            if len(js) == 0:
                continue
            others = right[js]
            links[i] += size[others].sum()
            links[others] += size[i]
            for b in others:
                x, y = root(int(i)), root(int(b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    forest.append((int(i), int(b)))
    return links, forest


def _verify(threshold: float, depth: int, before: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows):
            if len(rows) < 2:
                return
            links, forest = _verify_unit(rows, threshold, depth, before)
            at = np.flatnonzero(links)
            out.extend((0, rows[i]["cls"], None, int(links[i])) for i in at)
            out.extend((1, rows[a]["cls"], rows[b]["cls"], 0) for a, b in forest)

        unit, rows, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["node"], r["lo"], r["hi"])
                if key != unit:
                    done(rows)
                    unit, rows = key, []
                if not rows or rows[-1]["cls"] != r["cls"]:  # rows that repeat a doc_id bring a set twice
                    rows.append(r)
            if out:
                yield _link_batch(out)
                out = []
        done(rows)
        if out:
            yield _link_batch(out)
    return run


def _link_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                      names=["kind", "cls", "other", "links"])


def _members(classes: DataFrame, depth: int) -> DataFrame:
    """``cls, n_shingles, size, tree, node``: the trie node of each class in each tree.  A node
    is named by a hash of its tree and prefix; where the prefixes meet, ``_met`` looks."""
    trees = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    prefix = F.substring("label", F.col("tree") * NODE + 1, F.lit(4 * depth))
    return trees.select("cls", "n_shingles", "size", "tree", F.xxhash64("tree", prefix).alias("node"))


def _nodes(classes: DataFrame, depth: int) -> DataFrame:
    """Trie nodes of ``depth`` with more than one class.  Nodes with the same members are
    one node (the lowest tree's); ``x`` and ``y`` identify the member set."""
    node = _members(classes, depth).groupBy("node").agg(
        F.count("*").alias("n"), F.sum(F.col("n_shingles").cast("long")).alias("mass"), F.min("tree").alias("tree"),
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")).where("n > 1")
    first = node.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "node", "mass")).alias("f"))
    return first.select("n", "x", "y", "f.node", "f.mass")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs(doc_id, text)``.

    Two documents are linked if the Jaccard similarity of their sets of word ``n``-grams
    (bytes between white space, case kept; fewer than ``n`` words: one gram of all of them)
    is at least ``threshold``.  ``n_links`` counts the other documents a row is linked to,
    copies included; ``class_id`` is the smallest doc_id among all documents that links
    connect with it (its own if it has none).

    Links between different sets are found with probability ``recall`` or more, those at
    the threshold included; links between equal sets always.
    Null and empty texts and texts of white space have no grams and hence no links.  Rows
    that repeat a doc_id are separate documents.  A null doc_id is kept (class_id null
    unless linked).  Other columns are ignored.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(docs.mapInArrow(_label(n), _SETS), "join-labels")
    worded = rows.where("cls IS NOT NULL")
    classes = staged(
        worded.groupBy("cls").agg(F.count("*").alias("size"), F.min("doc_id").alias("rep"),
                                  F.min(F.struct("doc_id", "label")).alias("f"), F.max("n_shingles").alias("n_shingles"))
        .select("cls", "size", "rep", F.col("f.label").alias("label"), "n_shingles"), "join-classes")

    links, seen, before = None, None, 0
    for depth in DEPTHS:
        nodes = _nodes(classes, depth)
        if seen is not None:  # the same members have met before
            nodes = nodes.join(seen, ["n", "x", "y"], "left_anti")
        nodes = staged(nodes, "join-nodes")
        found = staged(_round(docs, classes, nodes, n, threshold, depth, before), "join-links")
        links = found if links is None else links.unionByName(found)
        keys = nodes.select("n", "x", "y")
        seen = keys if seen is None else seen.union(keys)
        before = depth
        if 1 - (1 - threshold ** depth) ** TREES >= recall:
            break

    group = components(links.where("kind = 1").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    count = links.where("kind = 0").groupBy("cls").agg(F.sum("links").alias("links"))
    per = (classes.select("cls", "size", "rep").join(count, "cls", "left")
           .join(group.withColumnRenamed("node", "cls"), "cls", "left")
           .withColumn("component", F.coalesce("component", "cls")))
    least = per.groupBy("component").agg(F.min("rep").alias("class_id"))
    per = per.join(least, "component").select("cls", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "cls").join(per, "cls", "left").select(
        "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _small(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if they are few enough; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _round(docs: DataFrame, classes: DataFrame, nodes: DataFrame, n: int, threshold: float, depth: int, before: int) -> DataFrame:
    """Verified new links among the members of ``nodes``."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    blocks = nodes.select("node", blocks.alias("blocks"))
    dealt = (_members(classes, depth).join(_small(blocks), "node")
             .withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
             .select("cls", "size", "tree", "node", "block", "blocks"))
    dealt = staged(dealt, "join-dealt")
    # The row with the class's smallest doc_id brings its text; the task that reads it names
    # the class anew, so rows that share a doc_id cannot swap their sets.
    met = dealt.select("cls").distinct()
    wanted = staged(classes.select("cls", "rep").join(met, "cls", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "join-wanted")
    texts = docs.join(_small(wanted), docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(n), "cls binary, label binary, shingles binary").where("cls IS NOT NULL")
    units = (dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cls", "size", "tree", "node", "block",
                     F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi")))
    full = units.join(sets, "cls")
    return (full.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", "cls")
            .mapInArrow(_verify(threshold, depth, before), _LINKS))
