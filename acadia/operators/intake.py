"""User sign-up batch (item 45)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import ts_lit
from ..functions.keys import flag_first
from ..functions.sequence import sequence_number
from ..functions.text import trimmed


def user_intake(batch: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Item 45. Admit sign-ups (request_id, ts, email, name); passwords are not handled.

    e-mail = trim + lower, required (``email_required``); an address already registered
    or taken by an earlier request of the batch (ts, request_id) is ``duplicate``.  name
    is trimmed, blank -> NULL; role 'user', unverified, created at ``as_of``.  Admitted
    rows get ids ``max(users.id) + 1, 2, ...`` in batch order (skew-safe numbering).
    Returns every request with the would-be row and ``reason``.
    """
    b = (batch.withColumn("email", F.lower(trimmed(F.coalesce(F.col("email"), F.lit("")))))
         .withColumn("name", F.nullif(trimmed(F.col("name")), F.lit(""))))
    present = F.col("email") != ""
    existing = users.select(F.col("email").alias("_ex")).distinct()
    b = b.join(existing, b["email"] == existing["_ex"], "left")
    b = flag_first(b, ["email"], ["ts", "request_id"], "_first",
                   when=present & F.col("_ex").isNull())
    reason = (F.when(~present, F.lit("email_required"))
              .when(F.col("_ex").isNotNull() | ~F.col("_first"), F.lit("duplicate")))
    b = b.withColumn("reason", reason)
    ok = sequence_number(b.where(F.col("reason").isNull()).select("request_id", "ts"), [],
                         ["ts", "request_id"], "_n")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    ids = ok.crossJoin(top).select("request_id", (F.col("_max") + F.col("_n")).alias("id"))
    return b.join(ids, "request_id", "left").select(
        "request_id", "id", "email", "name",
        F.when(F.col("reason").isNull(), F.lit("user")).alias("role"),
        F.when(F.col("reason").isNull(), F.lit(False)).alias("email_verified"),
        F.when(F.col("reason").isNull(), ts_lit(as_of)).alias("created_at"), "reason")
