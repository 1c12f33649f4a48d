"""Stream equals batch for items 47 and 48, with shuffled file order and a late row."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from acadia.operators.progress import fold_progress, progress_admission, progress_upsert
from acadia.sources.versions import snapshot, version_files
from acadia.streaming import progress as pstream
from acadia.streaming import rate_limit

from .conftest import SF_SMALL


def _split_events(tmp_path, late_row=None, parts=6, seed=3, in_time_order=False):
    """Write the sf0.001 events as several files (+ an optional late file).

    By default every file spans all days and the files come in shuffled order; with
    ``in_time_order`` each file holds a contiguous time range and files arrive in order.
    """
    table = pq.read_table(f"{SF_SMALL}/events.parquet")
    rows = table.to_pylist()
    rows.sort(key=lambda r: r["ts"])
    if in_time_order:
        step = -(-len(rows) // parts)
        chunks = [rows[i:i + step] for i in range(0, len(rows), step)]
    else:
        chunks = [rows[i::parts] for i in range(parts)]
        random.Random(seed).shuffle(chunks)
    d = tmp_path / "events_in"
    d.mkdir()
    for i, chunk in enumerate(chunks):
        pq.write_table(pa.Table.from_pylist(chunk, schema=table.schema), d / f"events_{i:02d}.parquet")
        os.utime(d / f"events_{i:02d}.parquet", (1_000_000 + i, 1_000_000 + i))
    if late_row is not None:
        p = d / f"events_{parts:02d}.parquet"
        pq.write_table(pa.Table.from_pylist([late_row], schema=table.schema), p)
        os.utime(p, (2_000_000, 2_000_000))
    return str(d)


def test_rate_limit_stream_equals_batch(spark, fx, tmp_path):
    src = _split_events(tmp_path)
    got = rate_limit.run_rate_limit_stream(spark, src, "1 day", 5, watermark="400 days",
                                           work_dir=str(tmp_path / "w"), max_files=1)
    want = rate_limit.rate_limit_report(fx.requests, "1 day", 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rate_limit_stream_drops_rows_behind_watermark(spark, fx, tmp_path):
    late = {"event_id": 10**9, "ts": dt.datetime(2024, 1, 1, 0, 0, 1), "user_id": 424242,
            "event_type": "view", "value": 0.0, "props": None}
    src = _split_events(tmp_path, late_row=late, in_time_order=True)
    got = rate_limit.run_rate_limit_stream(spark, src, "1 day", 5, watermark="2 days",
                                           work_dir=str(tmp_path / "w"), max_files=1)
    assert got.where(F.col("client_key") == 424242).count() == 0   # behind the watermark
    # every on-time row is counted: equal to the batch report without the late row
    want = rate_limit.rate_limit_report(fx.requests, "1 day", 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_progress_stream_equals_batch(spark, fx, tmp_path):
    src = _split_events(tmp_path, seed=11)
    got = pstream.run_progress_stream(spark, src, fx.lessons, fx.orders, fx.users,
                                      work_dir=str(tmp_path / "w"), max_files=2)
    adm = progress_admission(fx.progress_events, fx.lessons, fx.orders, fx.users) \
        .where(F.col("reason").isNull())
    want = fold_progress(adm)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def _table(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _batches(fx, n):
    return [fx.progress_events.where(F.col("event_id") % n == i) for i in range(n)]


def test_progress_table_stays_the_same_through_replays_and_compaction(spark, fx, tmp_path):
    base, static = str(tmp_path / "t"), (fx.lessons, fx.orders, fx.users)
    pstream.create_progress_table(spark.createDataFrame([], pstream.SCHEMA), base, buckets=8)
    deltas = []
    for i, batch in enumerate(_batches(fx, 7)):
        assert pstream.apply_batch(batch, *static, base, "s", i, compact_after=3)
        assert not pstream.apply_batch(batch, *static, base, "s", i)  # run again after a failure
        deltas.append(len({f.split("/")[0] for f in pstream._files(spark, base)[1]}))
    assert deltas == [1, 2, 0, 1, 2, 0, 1]  # a read merges a bounded number of deltas
    adm = progress_admission(fx.progress_events, *static).where(F.col("reason").isNull())
    want = _table(fold_progress(adm))
    assert _table(pstream.read_progress_table(spark, base)) == want
    assert pstream.compact(spark, base).version and pstream.compact(spark, base) is None
    assert _table(pstream.read_progress_table(spark, base)) == want
    # A second stream into the same table, whose batch is numbered on its own.
    again = fx.progress_events.where("event_id < 200").withColumn("lesson_id", F.lit(0))
    assert pstream.apply_batch(again, *static, base, "other", 0)
    assert snapshot(spark, base).notes["progress_batch_s"] == "6" and snapshot(spark, base).notes["progress_batch_other"] == "0"


def test_compaction_and_upsert_touch_the_buckets_of_their_users_only(spark, fx, tmp_path):
    base, static = str(tmp_path / "t"), (fx.lessons, fx.orders, fx.users)
    state = fx.course_progress.where("user_id % 3 > 0")
    pstream.create_progress_table(state, base, buckets=16)
    before = set(version_files(spark, base, "progress", snapshot(spark, base).versions["progress"]))
    few = fx.progress_events.where("user_id IN (3, 9)")
    done = pstream.upsert_stored(spark, base, few, *static)
    assert 1 <= len(done.touched) <= 2 and len(done.carried) >= len(before) - 2
    assert _table(pstream.read_progress_table(spark, base)) == _table(progress_upsert(few, state, *static))
    whole = pstream.upsert_stored(spark, base, fx.progress_events, *static)
    assert whole.version and _table(pstream.read_progress_table(spark, base)) == _table(
        progress_upsert(fx.progress_events, progress_upsert(few, state, *static), *static))
    nobody = pstream.upsert_stored(spark, base, few.where("user_id = 0 AND user_id = 1"), *static)
    assert nobody.version is None


def test_progress_stream_survives_a_restart(spark, fx, tmp_path):
    src, base = _split_events(tmp_path, seed=5), str(tmp_path / "t")
    for _ in range(2):  # the second run finds nothing new
        q = pstream.start_progress_stream(pstream.progress_events_stream(spark, src, 1), fx.lessons, fx.orders, fx.users,
                                          base, str(tmp_path / "c"), compact_after=4)
        q.awaitTermination()
    adm = progress_admission(fx.progress_events, fx.lessons, fx.orders, fx.users).where(F.col("reason").isNull())
    assert _table(pstream.read_progress_table(spark, base)) == _table(fold_progress(adm))
