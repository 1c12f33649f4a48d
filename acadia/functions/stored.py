"""Cutting lineage with a table in the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet under the shared folder and read back: it survives the loss of
    any executor, has a known size for the planner and is read with column pruning."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
