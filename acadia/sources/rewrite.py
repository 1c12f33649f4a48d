"""Changes to stored tables that read and write only the files they touch.

``delete_rows`` finds the files that hold doomed keys by a slim semi join over (key, file path),
and rewrites those.  ``write_buckets`` lays a table out by a hash of its key, one folder a
bucket, and ``merge_buckets`` reads and writes only the buckets a batch has keys of.  Files that
are not touched belong to the new version by reference (``sources.versions``); nothing is
published here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import sized
from .versions import read_files, refer, version_files, version_path

BUCKETS = 64
_BUCKET = re.compile(r"/bucket=(\d+)/")


@dataclass(frozen=True)
class Rewrite:
    """What a change did: its version (None where it touched nothing), rows removed, files."""

    version: str | None
    removed: int
    touched: list[str]
    carried: list[str]


def _file(name: str) -> Column:
    """A row's file, relative to its table's folder."""
    return F.regexp_extract("_metadata.file_path", rf".*/{re.escape(name)}/(v=.*)$", 1)


def touched_files(table: DataFrame, name: str, links: list[tuple[str, DataFrame]]) -> list[str]:
    """Files of ``table`` (read from storage) with a row whose column is among the ids of a link.

    Reads the linked columns alone, and of those only row groups between the least and the
    largest id.  The list is as long as the table has files at most.
    """
    hits = []
    for column, ids in links:
        ids = ids.toDF("_id").where(F.col("_id").isNotNull()).distinct()
        span = ids.agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).first()
        if span.lo is not None:
            near = table.where(F.col(column).between(F.lit(span.lo), F.lit(span.hi))).select(F.col(column).alias("_k"), _file(name).alias("file"))
            hits.append(near.join(sized(ids), F.col("_k") == F.col("_id"), "left_semi").select("file"))
    found = reduce(DataFrame.union, hits).distinct().collect() if hits else []
    return sorted(unquote(r.file) for r in found)


def delete_rows(spark: SparkSession, base: str, name: str, current: str, schema: T.StructType,
                links: list[tuple[str, DataFrame]], version: str) -> Rewrite:
    """``version`` of a table: ``current`` without the rows that a link's ids are in.

    ``links``: (column, one-column table of ids); null columns and null ids never match.  A row
    found through several links is removed once.
    """
    files = version_files(spark, base, name, current)
    touched = touched_files(read_files(spark, base, name, files, schema), name, links)
    carried = sorted({*files} - {*touched})
    if not touched:
        return Rewrite(None, 0, [], files)
    rows = read_files(spark, base, name, touched, schema)
    kept = rows
    for i, (column, ids) in enumerate(links):
        ids = ids.toDF(f"_id{i}").where(F.col(f"_id{i}").isNotNull()).distinct()
        kept = kept.join(sized(ids), kept[column] == ids[f"_id{i}"], "left_anti")
    kept.write.mode("overwrite").parquet(version_path(base, name, version))
    refer(spark, base, name, version, carried)
    left = spark.read.schema(schema).parquet(version_path(base, name, version)).count()
    return Rewrite(version, rows.count() - left, touched, carried)


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    # One file a bucket: within its folder it is sorted by key, so row groups can be skipped.
    (df.withColumn("bucket", bucket(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def write_buckets(df: DataFrame, base: str, name: str, version: str, key: str, buckets: int = BUCKETS) -> None:
    """``df`` as a version laid out by the hash of ``key``."""
    _write(df, version_path(base, name, version), key, buckets)
    refer(df.sparkSession, base, name, version, [])


def merge_buckets(spark: SparkSession, base: str, name: str, current: str, schema: T.StructType, batch: DataFrame, key: str,
                  merge: Callable[[DataFrame, DataFrame], DataFrame], version: str, buckets: int = BUCKETS) -> Rewrite:
    """``version`` of a bucketed table: ``merge(rows, batch)`` in the buckets ``batch`` has keys of.

    ``merge`` gets all rows of those buckets and the batch, and must leave rows of other keys
    as they are.  ``buckets`` is the number the table was written with.
    """
    files = version_files(spark, base, name, current)
    own = {f: int(_BUCKET.search(f"/{f}").group(1)) for f in files}
    hit = {r.b for r in batch.select(bucket(key, buckets).alias("b")).distinct().collect()}
    touched = [f for f in files if own[f] in hit]
    carried = [f for f in files if own[f] not in hit]
    if not hit:
        return Rewrite(None, 0, [], files)
    _write(merge(read_files(spark, base, name, touched, schema), batch), version_path(base, name, version), key, buckets)
    refer(spark, base, name, version, carried)
    return Rewrite(version, 0, touched, carried)
