"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  Each node hooks its larger (``large``) or its smaller neighbours,
    and itself, onto the smallest node it sees."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hooked = both.join(low, "a")
    if large:
        out = hooked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether no node hangs on two others, or on one while others hang on it: a further
    round would change nothing then."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    roles = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node on an edge.

    The component is its smallest node.  Large-star and small-star steps alternate until
    only stars are left (a logarithmic number of rounds); each round is one aggregate and
    one join per step, and its edges are written to the shared folder.  Loops and repeated
    edges are harmless; an empty table gives an empty result.
    """
    edges = staged(edges.select("a", "b").where("a != b").distinct(), "edges")
    while True:
        edges = staged(_stars(_stars(edges, True), False), "edges")
        if _only_stars(edges):
            break
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
