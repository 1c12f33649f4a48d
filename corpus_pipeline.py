"""A training corpus from the documents table, in five stages.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as parquet and reread as the next one's ``docs``.  All
but the last return the columns of documents, ``n_chars`` being kept true to ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acadia.llm import jaccard_join, line_dedup, packing, quality_classifier
from acadia.llm._store import staged
from acadia.llm.queries import mixture, tokenizer_path
from acadia.session import prepare
from acadia.sources.tables import read_table

BROADCAST_IDS = 2_000_000


def _sized(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, with ``n_chars`` counted anew."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; without those left with no word."""
    clash = [c for c in docs.columns if c in ("n_lines", "n_dropped")]
    held = docs.select("*", F.struct(*[F.col(c) for c in clash]).alias("_own")) if clash else docs
    kept = line_dedup.line_dedup(held).where("n_lines > n_dropped")
    return _sized(kept.withColumns({c: F.col(f"_own.{c}") for c in clash}), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest by doc_id (nulls last) and text hash.

    Rows are told apart by a key of their own, so rows that repeat a doc_id or have none are
    separate documents here too.  The key is written once, as every reader must see the same.
    """
    rows = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("_row")),
                  "pipeline-rows")
    joined = jaccard_join.jaccard_join(rows.select(F.col("_row").alias("doc_id"), "doc.text"))
    linked = joined.where("n_links > 0").select(F.col("doc_id").alias("_row"), "class_id")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), "doc.doc_id", F.xxhash64("doc.text").alias("hash"), "_row")
    linked = staged(linked.join(rows.select("_row", order.alias("order")), "_row"), "linked")
    first = linked.groupBy("class_id").agg(F.min("order").alias("order")).select("order._row")
    surplus = staged(linked.select("_row").join(first, "_row", "left_anti"), "surplus")
    if surplus.count() <= BROADCAST_IDS:
        surplus = F.broadcast(surplus)
    return rows.join(surplus, "_row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the target weights, once per epoch that takes them."""
    return _sized(mixture(docs), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("jaccard_join", near_copies),
          ("mixing", mixing), ("packing", sequences)]

# Models, sketches and a tokenizer decide the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages, each written and reread."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
