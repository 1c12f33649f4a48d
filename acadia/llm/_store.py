"""Where an operator cuts its lineage: tables in the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet under the shared folder and read back.

    The folder is the one ``spark.checkpoint.dir`` names (see ``session.checkpoint_dir``),
    so a table written here survives the loss of any executor, has a known size for the
    planner and is read with column pruning.  The folder's owner clears it after the job,
    as with any checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
