"""Admission against a falling balance, key by key, with hot keys spread over tasks.

The rule is sequential: an amount is admitted if it is at most the balance left, which it then
lowers; otherwise it is turned away and lowers nothing.  ``admit`` runs it over one sorted
layout by (key, order) whose partitions are contiguous, so only the first and the last key of
a partition can go on in another one.

* Within a partition the rule is a stream with one number of state.
* A key that crosses partitions needs the balance it enters each of them with.  Its run in a
  partition has a summary of fixed size: for each power of two 2**k, the sum of the amounts up
  to 2**k, and the least balance at which one of the amounts in (2**k, 2**(k+1)] would be
  admitted, if all the smaller ones before it are.  Entered with a balance in (2**k, 2**(k+1)],
  a run is *quiet* if the small amounts leave more than 2**k and no large one is admitted; its
  outcome is then known without reading it.  In a run that is not quiet the balance falls to
  2**k or below, and the run is read.

So a key has at most one run that is read for each halving of its balance: at most
log2(balance / least amount) + 1 rounds, whatever the number of rows.  The driver sees two
summaries a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

LEVELS = 62  # powers of two that amounts and balances stay below
NEVER = 1 << 62
SHORT = 24  # runs up to here are walked row by row
BLOCK = 1 << 16

_PIECE = "pid int, first boolean, last boolean, key long, balance long, sums array<long>, least array<long>"


def walk(amounts: np.ndarray, balance: int) -> tuple[np.ndarray, int]:
    """The balance left after each admitted amount (-1 where turned away), and at the end."""
    left = np.full(len(amounts), -1, np.int64)
    if len(amounts) <= SHORT:
        for i, a in enumerate(amounts.tolist()):
            if a <= balance:
                balance -= a
                left[i] = balance
        return left, balance
    at = 0
    while at < len(amounts):
        rest = amounts[at:at + BLOCK]
        small = rest <= balance // 2
        sums = np.cumsum(np.where(small, rest, 0))
        # Small amounts fit until half of the balance is gone; the first large one that fits
        # ends the stretch too.  Either way the balance has at least halved.
        ends = np.flatnonzero(np.where(small, sums >= (balance + 1) // 2, rest + sums <= balance))
        n = int(ends[0]) + 1 if len(ends) else len(rest)
        left[at:at + n][small[:n]] = balance - sums[:n][small[:n]]
        balance -= int(sums[n - 1])
        if len(ends) and not small[n - 1]:
            balance -= int(rest[n - 1])
            left[at + n - 1] = balance
        at += n
    return left, balance


def summary(amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of amounts up to 2**k, least balance that admits one in (2**k, 2**(k+1)]) by k."""
    sums, least = np.zeros(LEVELS, np.int64), np.full(LEVELS, NEVER, np.int64)
    for k in range(LEVELS):
        small = amounts <= 1 << k
        before = np.cumsum(np.where(small, amounts, 0))
        sums[k] = before[-1] if len(before) else 0
        large = ~small & (amounts <= 2 << k)
        if large.any():
            least[k] = (amounts + before)[large].min()
        if small.all():
            sums[k:] = sums[k]
            break
    return sums, least


def joined(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Summary of two runs, one after the other."""
    return a[0] + b[0], np.minimum(a[1], np.minimum(b[1], NEVER - a[0]) + a[0])


def through(sums: list[int], least: list[int], balance: int) -> int | None:
    """The balance that leaves a quiet run; None for a run that has to be read."""
    if balance <= 0:
        return balance
    k = min((balance - 1).bit_length() - 1, LEVELS - 1)  # 2**k < balance <= 2**(k+1)
    if k < 0:
        return None if sums[0] else balance
    return balance - sums[k] if balance - sums[k] > 1 << k and least[k] > balance else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, start, end, key, amounts, starting balance) for each stretch of one key in a batch."""
    for batch in batches:
        keys = batch.column("_key").to_numpy()
        amounts, start = batch.column("_amount").to_numpy(), batch.column("_start").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if b > a:
                yield batch, int(a), int(b), int(keys[a]), amounts[a:b], int(start[a])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of a partition's first and last key, the only ones that others may share."""
    done, now, held, whole, pid, start = [], None, [], None, None, 0

    def fold():
        run = summary(np.concatenate(held)) if held else None
        return run if whole is None else whole if run is None else joined(whole, run)

    for batch, a, _, key, amounts, balance in _runs(batches):
        if key != now:
            if now is not None and not done:
                done.append((True, False, now, start, *fold()))
            now, held, whole, pid, start = key, [], None, batch.column("_pid")[a].as_py(), balance
        held.append(amounts)
        if sum(map(len, held)) >= BLOCK:
            whole, held = fold(), []
    if now is not None:
        done.append((not done, True, now, start, *fold()))
    for first, last, key, balance, sums, least in done:
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid], pa.int32()), pa.array([first]), pa.array([last]), pa.array([key], pa.int64()), pa.array([balance], pa.int64()),
             pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([least.tolist()], pa.list_(pa.int64()))],
            names=[c.split()[0] for c in _PIECE.split(", ")])


def _exits(entries: dict):
    """Reads the runs named by (pid, key): the balance that leaves each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch, a, _, key, amounts, _ in _runs(batches):
            place = (batch.column("_pid")[a].as_py(), key)
            if place in entries:
                found[place] = walk(amounts, found.get(place, entries[place]))[1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int64()),
                                              pa.array(list(found.values()), pa.int64())], names=["pid", "key", "balance"])
    return run


def _decided(entries: dict):
    """Every row with the balance left after it, or null where it is turned away."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, balance, last, out = None, 0, None, []

        def flush(batch):
            left = np.concatenate(out)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.int64(), mask=left < 0)], names=[*batch.schema.names, "_left"])

        for batch, a, _, key, amounts, start in _runs(batches):
            if batch is not last:
                if out:
                    yield flush(last)
                last, out = batch, []
            if key != now:
                now, balance = key, entries.get((batch.column("_pid")[a].as_py(), key), start)
            left, balance = walk(amounts, balance)
            out.append(left)
        if out:
            yield flush(last)
    return run


def _entered(laid: DataFrame) -> dict:
    """(pid, key) -> balance on entry, of every run that is not its key's first."""
    rows = laid.mapInArrow(_pieces, _PIECE).collect()  # two rows a partition at most
    chains: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.key, r.pid)):
        chains.setdefault(r.key, []).append(r)
    chains = {k: c for k, c in chains.items() if len(c) > 1}
    entries = {(c[0].pid, k): c[0].balance for k, c in chains.items()}
    exits: dict = {}
    while True:
        asked = {}
        for key, chain in chains.items():
            for run, after in zip(chain, chain[1:]):
                place = (run.pid, key)
                gone = exits[place] if place in exits else through(run.sums, run.least, entries[place])
                if gone is None:
                    asked[place] = entries[place]
                    break
                entries[after.pid, key] = gone
        if not asked:
            return entries
        where = F.col("_pid").isin(*{p for p, _ in asked}) & F.col("_key").isin(*{k for _, k in asked})
        for r in laid.where(where).mapInArrow(_exits(asked), "pid int, key long, balance long").collect():
            exits[r.pid, r.key] = r.balance


def admit(rows: DataFrame, key: str, order: list[str], amount: str, start: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``_left``: what is left of the key's balance after an admitted row, null for
    one that is turned away.

    ``key``, ``amount`` and ``start`` (the key's balance before all its rows, the same in each)
    are whole numbers without nulls, amounts above zero.  Rows equal in key and ``order`` come in
    an order that is fixed when they are laid out.  Jobs: the layout, its summaries, and one
    for each round; the rows themselves are judged by the plan returned.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.withColumns({"_key": F.col(key).cast("long"), "_amount": F.col(amount), "_start": F.col(start),
                             "_tie": F.monotonically_increasing_id()})
    laid = (laid.repartitionByRange(n, "_key", *order, "_tie").sortWithinPartitions("_key", *order, "_tie")
            .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    own = [c for c in laid.columns if c not in ("_key", "_amount", "_start", "_tie", "_pid")]
    kinds = T.StructType([*laid.schema.fields, T.StructField("_left", T.LongType())])
    return laid.mapInArrow(_decided(_entered(laid)), kinds).select(*own, "_left")
