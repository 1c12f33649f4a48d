"""Per-key selection helpers: latest row per key, top-n per key, existence flags.

``row_number() <= n`` over a key is planned with a partial ``WindowGroupLimit`` before
the shuffle, so each map task forwards at most ``n`` rows per key: a key holding a third
of all rows costs one task no more than any other key after the exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def top_n_per_key(df: DataFrame, keys, order: list[Column], n: int,
                  rank_col: str = "_rn") -> DataFrame:
    """Rows ranked 1..n per key under ``order`` (ties resolved by the order's last keys)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def latest_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """The first row per key under ``order`` (e.g. newest by created_at desc, id desc)."""
    return top_n_per_key(df, keys, order, 1, "_rn").drop("_rn")


def flag_exists(df: DataFrame, other: DataFrame, left_key: str, right_key: str,
                name: str) -> DataFrame:
    """Add boolean ``name``: whether a row of ``other`` has ``right_key = left_key``.

    ``other`` is reduced to its distinct keys first (partial aggregation), so a key
    repeated many times on the right never multiplies the left rows.
    """
    keys = other.select(F.col(right_key).alias("_fk")).where(F.col("_fk").isNotNull()) \
        .distinct().withColumn(name, F.lit(True))
    return (df.join(keys, df[left_key] == keys["_fk"], "left").drop("_fk")
            .withColumn(name, F.coalesce(F.col(name), F.lit(False))))


def flag_first(df: DataFrame, keys: list[str], order: list[str], name: str = "is_first",
               when: Column | None = None) -> DataFrame:
    """Add boolean ``name``: the row is the first of its key under ascending ``order``.

    Only rows where ``when`` holds take part (others get false).  The first position per
    key is a grouped ``min(struct(order))`` - combined map-side, so a key holding a third
    of the rows adds one partial row per task - and is joined back on the key.
    ``order`` must identify a row within its key (end with a unique column).
    """
    cond = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    probe = df.where(cond).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_ff_min"))
    probe = probe.select(*[F.col(k).alias(f"_fk_{k}") for k in keys], F.lit(0).cast("long").alias("_ff_probe"), "_ff_min")
    # Rows that take no part (rejected ones, with NULL or '' as key) match nothing: each joins on a
    # number of its own, so they are spread over all tasks instead of meeting under one key.
    df = df.withColumn("_ff_part", F.when(cond, F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*order), F.lit(1 << 40))))
    on = [df["_ff_part"] == probe["_ff_probe"], *[df[k].eqNullSafe(probe[f"_fk_{k}"]) for k in keys]]
    joined = df.join(probe, reduce(lambda a, b: a & b, on), "left")
    me = F.struct(*[F.col(o) for o in order])
    return (joined.withColumn(name, F.coalesce(cond & (me == F.col("_ff_min")), F.lit(False)))
            .drop("_ff_min", "_ff_part", "_ff_probe", *[f"_fk_{k}" for k in keys]))
