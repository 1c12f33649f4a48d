"""Substring search through a trigram index.

The index holds a row (gram, key) for every run of three characters, lower-cased, of the indexed
columns, laid out by gram, and the number of keys of each gram.  A term's literal stretches
(between wildcards) give the grams that every match must have; the keys of its rarest few are
the candidates, and ``ILIKE`` over those rows decides, so the result is that of a scan.  A term
without three literal characters in a row is searched by a scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import search, sized

RAREST = 3


def grams_of(column: str | Column) -> Column:
    """The distinct runs of three characters of a column, lower-cased; none for a shorter or null one."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    size = F.coalesce(F.length(text), F.lit(0))
    every = F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring(text, i, 3))
    return F.when(size >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def grams_of_term(term: str) -> list[str]:
    """Grams that every text matching ``%term%`` has.  ``%`` and ``_`` are wildcards; a backslash
    makes the character after it literal, which is left out here."""
    pieces = re.split(r"\\.|[%_\\]", term.lower(), flags=re.S)
    return sorted({p[i:i + 3] for p in pieces for i in range(len(p) - 2)})


@dataclass(frozen=True)
class Index:
    grams: DataFrame  # gram, key
    counts: DataFrame  # gram, n


def write_index(table: DataFrame, key: str, columns: list[str], path: str, partitions: int | None = None) -> None:
    """Index ``columns`` of ``table`` by its unique ``key`` under ``path``."""
    spark = table.sparkSession
    own = F.array_distinct(F.concat(*[grams_of(c) for c in columns]))
    rows = table.select(F.col(key).alias("key"), F.explode(own).alias("gram"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By range of (gram, key): a gram in every row is spread over files, and a read of a rare one
    # skips all row groups but its own.
    rows.repartitionByRange(n, "gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{path}/grams")
    spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/counts"))


def candidates(index: Index, term: str) -> DataFrame | None:
    """``key`` of the rows that have the term's rarest grams; None if the term has none."""
    grams = grams_of_term(term or "")
    if not grams:
        return None
    found = index.counts.where(F.col("gram").isin(grams)).collect()  # a row per gram of the term
    if len(found) < len(grams):
        return index.grams.select("key").limit(0)
    rare = [r.gram for r in sorted(found, key=lambda r: (r.n, r.gram))[:RAREST]]
    return index.grams.where(F.col("gram").isin(rare)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def indexed_search(table: DataFrame, key: str, columns: list[str], term: str | None, index: Index) -> DataFrame:
    """The rows of ``table`` in which one of ``columns`` contains ``term``, as ``filters.search`` finds them."""
    if not term:
        return table
    keys = candidates(index, term)
    if keys is not None:
        keys = sized(keys.withColumnRenamed("key", "_key"))
        table = table.join(keys, F.col(key) == F.col("_key"), "left_semi")
    return table.where(search(term, *columns))
