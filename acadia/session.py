"""Session settings the library relies on, and where lineage cuts are written."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator assumes.  The time zone is fixed to UTC so DATE()/date_trunc
# buckets do not depend on the host zone; AQE re-plans joins (broadcast vs sort-merge),
# coalesces small shuffle partitions and splits skewed ones at run time.  Batches handed to
# Python are bounded by bytes, as ten thousand long texts would not fit a worker's memory.
LIBRARY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "acadia", extra: dict | None = None) -> SparkSession:
    """Session for tests, benches and local runs (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**LIBRARY_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to a session someone else built."""
    for key, value in LIBRARY_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``DataFrame.checkpoint``.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (or an earlier
    ``setCheckpointDir``) and must be on shared storage.  Only a local-mode session
    without one (tests, benches) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared checkpoint folder")
    scratch = tempfile.mkdtemp(prefix="acadia-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return scratch
