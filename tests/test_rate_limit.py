"""Windows from each client's first request equal a loop over the client's requests."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from acadia.streaming import rate_limit
from acadia.streaming.rate_limit import rate_limit_report, walk, window_micros

ZERO = dt.datetime(2001, 7, 1)


def _loop(hits, w):
    """hits: (client, seconds) -> {(client, start): requests}."""
    out, start = Counter(), {}
    for c, t in sorted(hits, key=lambda h: (str(h[0]), h[1])):
        if c not in start or t >= start[c] + w:
            start[c] = t
        out[c, start[c]] += 1
    return dict(out)


def _table(spark, hits):
    return spark.createDataFrame([(c, "r", ZERO + dt.timedelta(seconds=t)) for c, t in hits], "client_key long, route string, ts timestamp")


def _got(report):
    return {(r.client_key, (r.window_start - ZERO).total_seconds()): r.requests for r in report.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_windows_match_the_loop(spark, seed):
    rnd = random.Random(seed)
    hits = []
    for c in [None, *range(12)]:
        t = rnd.randint(0, 200)
        for _ in range(rnd.choice([1, 5, 60, 400])):
            t += rnd.choice([0, 1, 7, 20, rnd.randint(0, 59), 60, 61, 400]) if rnd.random() < 0.7 else 0
            hits.append((c, t))
    report = rate_limit_report(_table(spark, hits), "1 minute", 9)
    assert _got(report) == _loop(hits, 60)
    assert all(r.over_limit == (r.requests > 9) and r.rejected == max(0, r.requests - 9)
               and r.window_end - r.window_start == dt.timedelta(minutes=1) for r in report.collect())


def test_a_busy_client_takes_logarithmic_rounds(spark, monkeypatch):
    made = []
    real = rate_limit.stored
    monkeypatch.setattr(rate_limit, "stored", lambda df, name: made.append(name) or real(df, name))
    hits = [(1, t) for t in range(0, 6000, 7)] + [(2, 5)]
    assert _got(rate_limit_report(_table(spark, hits), "1 minute", 9)) == _loop(hits, 60)
    assert made.count("rate-jump") <= 7  # a hundred windows


def test_no_requests_and_requests_without_time(spark):
    none = _table(spark, [(1, 5)]).where("client_key = 0")
    assert rate_limit_report(none).count() == 0
    assert rate_limit_report(_table(spark, [(1, 5)]).withColumn("ts", F.lit(None).cast("timestamp"))).count() == 0
    other = _table(spark, [(1, 5), (1, 6)]).withColumn("route", F.when(F.col("ts") > F.lit(ZERO + dt.timedelta(seconds=5)), "a"))
    assert [r.requests for r in rate_limit_report(other, limiter="auth", routes=("a",)).collect()] == [1]


def test_walk_closes_windows():
    assert walk(None, 0, [(0, 2), (59, 1), (60, 1), (200, 3)], 60) == ([(0, 3), (60, 1)], 200, 3)
    assert window_micros("15 minutes") == 900_000_000


def test_stream_settles_windows_in_any_order_within_the_watermark(spark, tmp_path):
    rnd = random.Random(2)
    hits = [(rnd.randrange(3), t + rnd.randint(0, 40)) for t in range(0, 4000, 9)] + [(7, 3), (8, 3900)]
    hits.sort(key=lambda h: h[1] + rnd.randint(0, 100))  # at most 140 s out of order
    src = tmp_path / "in"
    for i in range(0, len(hits), 90):
        _table(spark, hits[i:i + 90]).coalesce(1).write.mode("append").parquet(str(src))
    late = [(7, 4)]
    _table(spark, late).coalesce(1).write.mode("append").parquet(str(src))
    stream = (spark.readStream.schema("client_key long, route string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = rate_limit.start_rate_limit_stream(stream, str(tmp_path / "sink"), str(tmp_path / "ckpt"), "1 minute", "200 seconds")
    q.awaitTermination()
    sink = spark.read.parquet(str(tmp_path / "sink"))
    got = _got(rate_limit.read_rate_limit_sink(spark, str(tmp_path / "sink"), "1 minute", 9))
    assert got == _loop(hits, 60)
    by_final = defaultdict(set)
    for r in sink.where("final").collect():
        by_final[r.client_key, r.start].add(r.requests)
    assert len(by_final) > 100 and all(len(v) == 1 for v in by_final.values())  # a final window never changes
