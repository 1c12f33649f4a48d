"""Continuous progress fold (item 48): item 31's upsert, kept as an incremental table.

Every micro-batch is folded per (user, lesson) first, with map-side combine, so a hot user is
one row a lesson before any join; the folded rows are admitted (lessons, paid orders, admins)
and written as a delta.  The stream keeps no state of its own: the table is the state.

The table ``progress`` of ``base`` is laid out by a hash of the user (``sources.rewrite``), and a
version is its bucketed files and the deltas since (``sources.versions``).  A read merges the
deltas into the rows of the buckets; after ``compact_after`` of them a compaction folds them in,
rewriting the buckets they touch only.  Flags only rise and each time is the first that set
its flag, so the fold gives the same whatever the order, and before or after a compaction.

A publication names the last micro-batch it holds: a batch that is run again after a failure
finds itself there and writes nothing.  Several streams may feed one table: each has its own
name, and a conflicting publication is made again from the new state.

The static sides are read again for every micro-batch; a longer trigger interval amortises it.
A parquet DataFrame keeps the file list taken when it was created, so files added to those
tables later are seen after a restart of the stream (its checkpoint makes the restart safe).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import PROGRESS_COLUMNS, admitted_keys, fold_events, merge_progress
from ..session import checkpoint_dir
from ..sources.fixtures import FIXTURE_SQL
from ..sources.rewrite import BUCKETS, Rewrite, merge_buckets, write_buckets
from ..sources.tables import DRIVER_SCHEMAS
from ..sources.versions import Conflict, publish_on, read_files, refer, snapshot, version_files, version_path

TABLE = "progress"
SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("lesson_id", T.IntegerType()),
                       T.StructField("viewed", T.BooleanType()), T.StructField("completed", T.BooleanType()),
                       T.StructField("viewed_at", T.TimestampType()), T.StructField("completed_at", T.TimestampType())])


def progress_events_stream(spark: SparkSession, sf_dir: str,
                           max_files: int | None = None) -> DataFrame:
    """The ``events`` table read as a stream, shaped into progress events."""
    reader = (spark.readStream.schema(DRIVER_SCHEMAS["events"])
              .option("pathGlobFilter", "events*.parquet"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return spark.sql(FIXTURE_SQL["f_progress_events"], events=reader.parquet(sf_dir))


def fold_rows(rows: DataFrame) -> DataFrame:
    """Progress rows folded per (user, lesson)."""
    return rows.groupBy("user_id", "lesson_id").agg(
        F.bool_or("viewed").alias("viewed"), F.bool_or("completed").alias("completed"),
        F.min("viewed_at").alias("viewed_at"), F.min("completed_at").alias("completed_at"))


def _parts(files: list[str]) -> tuple[list[str], list[str]]:
    """Bucketed files, and deltas."""
    return [f for f in files if "/bucket=" in f], [f for f in files if "/bucket=" not in f]


def _files(spark: SparkSession, base: str) -> tuple[list[str], list[str]]:
    version = snapshot(spark, base).versions.get(TABLE)
    return _parts(version_files(spark, base, TABLE, version)) if version else ([], [])


def create_progress_table(progress: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """Publish ``progress`` (one row per user and lesson) as the table's first version."""
    spark, version = progress.sparkSession, uuid.uuid4().hex
    rows = progress.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])
    write_buckets(rows, base, TABLE, version, "user_id", buckets)
    publish_on(spark, base, snapshot(spark, base), {TABLE: version}, notes={f"{TABLE}_buckets": str(buckets)})


def read_progress_table(spark: SparkSession, base: str) -> DataFrame:
    """The progress table as published: bucketed rows merged with the deltas since."""
    rows, deltas = _files(spark, base)
    table = read_files(spark, base, TABLE, rows, SCHEMA)
    if deltas:
        table = fold_rows(table.unionByName(read_files(spark, base, TABLE, deltas, SCHEMA)))
    return table.select(*PROGRESS_COLUMNS)


def compact(spark: SparkSession, base: str) -> Rewrite | None:
    """Fold the deltas into the buckets they touch; None if there are none."""
    now = snapshot(spark, base)
    rows, deltas = _files(spark, base)
    if not deltas:
        return None
    version, held = uuid.uuid4().hex, uuid.uuid4().hex
    # The bucketed files alone are a version of their own for the merge; it is never published.
    refer(spark, base, TABLE, held, rows)
    batch = fold_rows(read_files(spark, base, TABLE, deltas, SCHEMA))
    done = merge_buckets(spark, base, TABLE, held, SCHEMA, batch, "user_id", lambda state, new: fold_rows(state.unionByName(new)), version,
                         int(now.notes[f"{TABLE}_buckets"]))
    if done.version is None:  # deltas without rows
        refer(spark, base, TABLE, version, rows)
    publish_on(spark, base, now, {TABLE: version})
    return done


def apply_batch(events: DataFrame, lessons: DataFrame, orders: DataFrame, users: DataFrame, base: str, stream: str, batch_id: int,
                compact_after: int = 20, attempts: int = 5) -> bool:
    """Fold, admit and publish one micro-batch; False if the table holds it already."""
    spark, note = events.sparkSession, f"{TABLE}_batch_{stream}"
    delta = uuid.uuid4().hex
    for attempt in range(attempts):
        now = snapshot(spark, base)
        if int(now.notes.get(note, -1)) >= batch_id:
            return False
        if attempt == 0:
            rows = admitted_keys(fold_events(events), lessons, orders, users).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])
            rows.write.mode("overwrite").parquet(version_path(base, TABLE, delta))
        version = uuid.uuid4().hex
        before = version_files(spark, base, TABLE, now.versions[TABLE])
        refer(spark, base, TABLE, version, [*before, *version_files(spark, base, TABLE, delta)])
        try:
            publish_on(spark, base, now, {TABLE: version}, notes={note: str(batch_id)})
            break
        except Conflict:
            if attempt == attempts - 1:
                raise
    if len({f.split("/")[0] for f in _files(spark, base)[1]}) >= compact_after:
        try:
            compact(spark, base)
        except Conflict:  # another writer published meanwhile; the next batch tries again
            pass
    return True


def start_progress_stream(events: DataFrame, lessons: DataFrame, orders: DataFrame,
                          users: DataFrame, base: str, checkpoint: str, stream: str = "events",
                          available_now: bool = True, compact_after: int = 20) -> StreamingQuery:
    """Feed ``events`` into the progress table of ``base``, which is created empty if need be."""
    spark = events.sparkSession
    if TABLE not in snapshot(spark, base).versions:
        create_progress_table(spark.createDataFrame([], SCHEMA), base)

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, lessons, orders, users, base, stream, batch_id, compact_after)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_progress_stream(spark: SparkSession, sf_dir: str, lessons: DataFrame, orders: DataFrame,
                        users: DataFrame, work_dir: str | None = None,
                        max_files: int | None = None) -> DataFrame:
    """Run the fold over everything available now; return the resulting progress table."""
    base = work_dir or f"{checkpoint_dir(spark).rstrip('/')}/progress-{uuid.uuid4().hex}"
    q = start_progress_stream(progress_events_stream(spark, sf_dir, max_files), lessons, orders, users, f"{base}/tables", f"{base}/checkpoint")
    q.awaitTermination()
    return read_progress_table(spark, f"{base}/tables")


def upsert_stored(spark: SparkSession, base: str, events: DataFrame, lessons: DataFrame, orders: DataFrame, users: DataFrame) -> Rewrite:
    """Item 31 on the stored table: a batch of events merged into the buckets of its users alone,
    with the batch job's rule that a time already stored stays."""
    if _files(spark, base)[1]:
        compact(spark, base)
    now, version = snapshot(spark, base), uuid.uuid4().hex
    batch = admitted_keys(fold_events(events), lessons, orders, users).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])
    done = merge_buckets(spark, base, TABLE, now.versions[TABLE], SCHEMA, batch, "user_id", merge_progress, version,
                         int(now.notes[f"{TABLE}_buckets"]))
    if done.version:
        publish_on(spark, base, now, {TABLE: version})
    return done
