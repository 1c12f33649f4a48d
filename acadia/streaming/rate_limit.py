"""Request-rate report per client and window (item 47), batch and Structured Streaming.

The original keeps per-client counters in process memory and answers 429 beyond the ceiling:
a client's first request opens a window, requests before its end count in it, and the first
one at or after its end opens the next.

Batch.  Windows of one client start at least a window apart, so a cell (a stretch of one
window's length on the clock) holds one start at most, and only the cell before matters.  A
gap of a window or more between two requests makes the later one a start, whatever came
before.  What is left are busy sessions over several cells: there each request points to the
first one past its window, and the starts are found by pointer doubling from the session's
first request, in log2(cells of the longest session) rounds of joins on (client, time).  No
client's requests meet in one task; windows over a client alone see a row per cell.

Stream.  A stateful processor keeps each client's open window and the requests the watermark
has not passed yet.  Settled windows are final; open ones are reported anew in every
micro-batch that changes them, and the sink is read as all final rows and each client's
latest open ones, so replays change nothing.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import RATE_LIMITS
from ..functions.stored import stored
from ..session import checkpoint_dir
from ..sources.fixtures import FIXTURE_SQL
from ..sources.tables import DRIVER_SCHEMAS

KEY = ["client_key", "window_start", "window_end"]
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def window_micros(window: str) -> int:
    """Length of a window such as ``15 minutes``."""
    n, unit = window.split()
    return int(n) * _UNITS[unit.rstrip("s")] * 1_000_000


def _same(a: DataFrame, b: DataFrame, *columns: str):
    """Rows of one client (null is a client too) that agree in ``columns``."""
    on = a["client_key"].eqNullSafe(b["client_key"])
    for c in columns:
        on = on & (a[c] == b[c])
    return on


def _next(hits: DataFrame, cells: DataFrame, w: int) -> DataFrame:
    """``client_key, t, nxt`` of the requests of busy sessions: the first request of the session
    at least a window later, or null.

    A session has no empty cell, so that is in the next cell or the first of the one after.
    """
    busy = cells.where("many").select("client_key", "cell", "session", "after")
    nodes = hits.join(busy, _same(hits, busy, "cell")).select(hits["client_key"], hits["cell"], "session", "t", "after")
    asked = nodes.select("client_key", "session", (F.col("cell") + 1).alias("cell"), (F.col("t") + w).alias("at"), F.lit(1).alias("asks"), "t", "after")
    there = nodes.select("client_key", "session", "cell", F.col("t").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("t"), "after")
    # Downwards in time within a cell: the request seen last is the first at or after this place.
    seen = Window.partitionBy("client_key", "session", "cell").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(seen)
    return asked.unionByName(there).withColumn("found", found).where("asks = 1").select(
        "client_key", "t", F.coalesce("found", "after").alias("nxt"))


def _starts(hits: DataFrame, cells: DataFrame, w: int) -> DataFrame:
    """``client_key, start``: every request that opens a window."""
    firsts = cells.where("opens").select("client_key", F.col("lo").alias("start"))
    longest = cells.where("many").agg(F.max("cells").alias("n")).first().n
    if longest is None:
        return firsts
    jumps = [stored(_next(hits, cells, w), "rate-jump")]
    for _ in range(math.ceil(math.log2(longest)) - 1):
        near = jumps[-1].where("nxt IS NOT NULL")
        far = near.select(F.col("client_key").alias("c2"), F.col("t").alias("t2"), F.col("nxt").alias("n2"))
        jumps.append(stored(near.join(far, F.col("client_key").eqNullSafe(F.col("c2")) & (F.col("nxt") == F.col("t2")))
                            .select("client_key", "t", F.col("n2").alias("nxt")), "rate-jump"))
    # A start's number in its session is a sum of powers of two: each is reached once, in one plan.
    marked = cells.where("opens AND many").select("client_key", F.col("lo").alias("start"))
    for jump in reversed(jumps):
        to = jump.where("nxt IS NOT NULL").select(F.col("client_key").alias("c2"), "t", "nxt")
        ahead = marked.join(to, F.col("client_key").eqNullSafe(F.col("c2")) & (F.col("start") == F.col("t")), "left")
        marked = ahead.select("client_key", F.explode(F.array("start", "nxt")).alias("start")).where("start IS NOT NULL")
    return cells.where("opens AND NOT many").select("client_key", F.col("lo").alias("start")).unionByName(marked)


def rate_limit_counts(requests: DataFrame, window: str, routes: tuple | None = None) -> DataFrame:
    """Requests per (client_key, window from the client's first request on).

    Requests at the same time are folded first.  A null client_key is a client of its own; requests
    without a time are not counted.
    """
    w = window_micros(window)
    r = requests if routes is None else requests.where(F.col("route").isin(*routes))
    hits = r.where(F.col("ts").isNotNull()).groupBy("client_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(
        F.count(F.lit(1)).alias("n"))
    hits = stored(hits.withColumn("cell", F.floor(F.col("t") / w).cast("long")), "rate-hits")

    line = Window.partitionBy("client_key").orderBy("cell")
    cells = hits.groupBy("client_key", "cell").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cells = cells.withColumn("opens", F.coalesce(F.col("lo") - F.lag("hi").over(line) >= w, F.lit(True)))
    cells = cells.withColumn("session", F.sum(F.col("opens").cast("long")).over(line))
    inside = Window.partitionBy("client_key", "session")
    cells = cells.withColumns({"cells": F.count("*").over(inside), "after": F.lead("lo", 2).over(inside.orderBy("cell"))})
    cells = stored(cells.withColumn("many", F.col("cells") > 1), "rate-cells")

    starts = _starts(hits, cells, w).select(F.col("client_key").alias("c2"), F.floor(F.col("start") / w).cast("long").alias("cell2"), "start")
    own = cells.select("client_key", "cell", "session")
    own = own.join(starts, F.col("client_key").eqNullSafe(F.col("c2")) & (F.col("cell") == F.col("cell2")), "left").select(
        "client_key", "cell", "session", "start")
    own = own.withColumn("before", F.lag("start").over(inside.orderBy("cell")))
    counted = hits.join(own, _same(hits, own, "cell")).select(
        hits["client_key"], F.when(F.col("start") <= F.col("t"), F.col("start")).otherwise(F.col("before")).alias("s"), "n")
    return counted.groupBy("client_key", "s").agg(F.sum("n").alias("requests")).select(
        "client_key", F.timestamp_micros("s").alias("window_start"), F.timestamp_micros(F.col("s") + w).alias("window_end"), "requests")


def _flag(counts: DataFrame, max_requests: int) -> DataFrame:
    return counts.select(*KEY, "requests",
                         (F.col("requests") > max_requests).alias("over_limit"),
                         F.greatest(F.col("requests") - max_requests, F.lit(0)).alias("rejected"))


def rate_limit_report(requests: DataFrame, window: str | None = None,
                      max_requests: int | None = None, limiter: str = "global",
                      routes: tuple | None = None) -> DataFrame:
    """Item 47 (batch). Requests per client and window, ``over_limit`` and ``rejected``
    (requests beyond the ceiling).  Defaults come from the named limiter
    (global 300 / 15 min, auth 20 / 15 min, slug 30 / 1 min)."""
    dmax, dwin = RATE_LIMITS[limiter]
    return _flag(rate_limit_counts(requests, window or dwin, routes),
                 dmax if max_requests is None else max_requests)


def requests_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table read as a stream, shaped into limiter requests."""
    reader = (spark.readStream.schema(DRIVER_SCHEMAS["events"])
              .option("pathGlobFilter", "events*.parquet"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    events = reader.parquet(sf_dir)
    return spark.sql(FIXTURE_SQL["f_requests"], events=events)


_REPORTED = "client_key {kind}, start long, requests long, final boolean"
_STATE = "start long, n long, times array<long>, counts array<long>"


def walk(start: int | None, n: int, hits: list[tuple[int, int]], w: int) -> tuple[list[tuple[int, int]], int | None, int]:
    """Windows closed by ``hits`` (time, count; in order), and the window open after them."""
    closed = []
    for t, count in hits:
        if start is None or t >= start + w:
            if start is not None:
                closed.append((start, n))
            start, n = t, 0
        n += count
    return closed, start, n


def _processor(w: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, times, counts = state.get if state.exists else (None, 0, [], [])
        pending: dict[int, int] = dict(zip(times, counts))
        for frame in frames:
            for t, count in frame["t"].value_counts().items():
                pending[int(t)] = pending.get(int(t), 0) + int(count)
        # What the watermark has passed is settled: nothing on time can come before it any more.
        passed = state.getCurrentWatermarkMs() * 1000
        settled = sorted((t, c) for t, c in pending.items() if t < passed)
        final, start, n = walk(start, n, settled, w)
        if start is not None and start + w <= passed:
            final.append((start, n))
            start, n = None, 0
        ahead = sorted((t, c) for t, c in pending.items() if t >= passed)
        more, now, m = walk(start, n, ahead, w)
        rows = [(s, c, True) for s, c in final] + [(s, c, False) for s, c in more] + ([(now, m, False)] if now is not None else [])
        if start is None and not ahead:
            state.remove()
        else:
            state.update((start, n, [t for t, _ in ahead], [c for _, c in ahead]))
            due = (start + w if start is not None else ahead[0][0]) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame({"client_key": [key[0]] * len(rows), "start": [r[0] for r in rows], "requests": [r[1] for r in rows],
                                "final": [r[2] for r in rows]})
    return run


def start_rate_limit_stream(requests: DataFrame, sink_dir: str, checkpoint: str, window: str,
                            watermark: str, routes: tuple | None = None,
                            available_now: bool = True) -> StreamingQuery:
    """Item 47 (stream). Windows from each client's first request, into ``sink_dir``.

    Requests older than the watermark are dropped: the windows they fall in are settled.  The
    state holds a client's open window and its requests of the last ``watermark``; a client
    without either has none.
    """
    r = requests if routes is None else requests.where(F.col("route").isin(*routes))
    kind = requests.schema["client_key"].dataType.simpleString()
    slim = r.withWatermark("ts", watermark).select("client_key", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    windows = slim.groupBy("client_key").applyInPandasWithState(
        _processor(window_micros(window)), _REPORTED.format(kind=kind), _STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_dir)

    q = (windows.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def read_rate_limit_sink(spark: SparkSession, sink_dir: str, window: str, max_requests: int) -> DataFrame:
    """All final windows and the open ones of each client's latest report."""
    raw = spark.read.parquet(sink_dir)
    last = raw.groupBy("client_key").agg(F.max("batch_id").alias("last"))
    raw = raw.join(last, raw["client_key"].eqNullSafe(last["client_key"])).select(raw["*"], "last")
    live = raw.where("final OR batch_id = last").groupBy("client_key", "start").agg(F.max("requests").alias("requests"))
    return _flag(live.select("client_key", F.timestamp_micros("start").alias("window_start"),
                             F.timestamp_micros(F.col("start") + window_micros(window)).alias("window_end"), "requests"), max_requests)


def run_rate_limit_stream(spark: SparkSession, sf_dir: str, window: str, max_requests: int,
                          watermark: str = "1 hour", work_dir: str | None = None,
                          max_files: int | None = None) -> DataFrame:
    """Run the stream over everything available now and return the final report.

    Output and stream checkpoint live under ``work_dir`` (default: a fresh folder in
    the session's checkpoint directory, shared storage on a cluster).
    """
    base = work_dir or f"{checkpoint_dir(spark).rstrip('/')}/rate-limit-{uuid.uuid4().hex}"
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "checkpoint")
    q = start_rate_limit_stream(requests_stream(spark, sf_dir, max_files), sink, ckpt, window,
                                watermark)
    q.awaitTermination()
    return read_rate_limit_sink(spark, sink, window, max_requests)
