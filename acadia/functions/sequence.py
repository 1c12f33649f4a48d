"""Skew-safe numbering and running totals within a key.

``Window.partitionBy(key).orderBy(...)`` puts every row of a key into one task; with a
key that holds a third of all rows that task is the whole job.  These helpers get the
same results with the work spread evenly:

1. ``repartitionByRange(key, order...)`` + ``sortWithinPartitions``: range boundaries
   are sampled over the full sort key, so one hot key is split over many partitions
   while each partition holds a contiguous, sorted run.
2. Each row gets its partition id and ``monotonically_increasing_id`` (increasing with
   the position in the partition).
3. A small summary per (key, partition) - row count, value total, first position - is
   turned into offsets with a window over partitions of the same key (its size is
   keys x partitions, independent of rows per key).
4. Offsets are joined back; the numbering / running total inside a (key, partition)
   run comes from a window partitioned by (key, partition), i.e. evenly sized groups.

Partition ids and positions are read in two branches (summary and rows), so the laid
out frame is checkpointed once (reliable checkpoint in the session's checkpoint
folder): both branches then see the same ids, and a lost executor re-reads the
checkpoint instead of re-running a range shuffle whose placement could differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _laid_out(df: DataFrame, keys: list, order: list, partitions: int | None) -> DataFrame:
    sort_cols = [_c(k) for k in keys] + [_c(o) for o in order]
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id())
            .checkpoint(eager=True))


def _join_back(laid: DataFrame, summary: DataFrame, key_cols: list, cols: list) -> DataFrame:
    """Join the per-(key, partition) summary back; NULL keys match NULL keys."""
    s = summary.select(*[F.col(k).alias(f"_sk_{k}") for k in key_cols],
                       F.col("_pid").alias("_spid"), *cols)
    cond = laid["_pid"] == s["_spid"]
    for k in key_cols:
        cond = cond & laid[k].eqNullSafe(s[f"_sk_{k}"])
    return laid.join(s, cond, "inner").drop("_spid", *[f"_sk_{k}" for k in key_cols])


def sequence_number(df: DataFrame, keys: list, order: list, name: str = "seq",
                    partitions: int | None = None) -> DataFrame:
    """``row_number()`` within ``keys`` under ascending ``order``, 1-based, skew-safe.

    ``keys`` may be empty (one sequence over the whole frame).  ``order`` columns are
    ascending sort expressions (use a negated value for descending numeric order).
    """
    laid = _laid_out(df, keys, order, partitions)
    key_cols = [k if isinstance(k, str) else None for k in keys]
    if None in key_cols:
        raise ValueError("keys must be column names")
    summary = laid.groupBy(*key_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                                  F.min("_pos").alias("_first"))
    w = Window.partitionBy(*key_cols).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = summary.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    out = _join_back(laid, summary, key_cols, ["_first", "_before"])
    return (out.withColumn(name, F.col("_before") + (F.col("_pos") - F.col("_first")) + 1)
            .drop("_pid", "_pos", "_first", "_before"))


def running_total(df: DataFrame, keys: list, order: list, value: str | Column,
                  name: str = "running", partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` under ``order``, skew-safe.

    Type and NULLs are those of ``sum(value) OVER (PARTITION BY keys ORDER BY order)``: a
    NULL value adds nothing, and the total is NULL until the first value of the key.
    """
    key_cols = list(keys)
    kind = df.select(F.sum(_c(value)).alias("s")).schema["s"].dataType
    laid = _laid_out(df.withColumn("_v", _c(value)), key_cols, order, partitions)
    summary = laid.groupBy(*key_cols, "_pid").agg(F.sum("_v").alias("_t"))
    past = Window.partitionBy(*key_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_before", F.sum("_t").over(past))
    local = Window.partitionBy(*key_cols, "_pid").orderBy("_pos") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _join_back(laid.withColumn("_local", F.sum("_v").over(local)), summary, key_cols,
                     ["_before"])
    total = F.coalesce(F.col("_before") + F.col("_local"), F.col("_before"), F.col("_local"))
    return (out.withColumn(name, total.cast(kind))
            .drop("_pid", "_pos", "_v", "_local", "_before"))
