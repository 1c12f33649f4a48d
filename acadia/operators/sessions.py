"""Sessions and one-time codes: token retention (36), active sessions (37), code status (38)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHANGE_EMAIL_PREFIX, KEEP_TOKENS
from ..functions.filters import ts_lit
from ..functions.keys import flag_first, latest_per_key, top_n_per_key
from ..functions.stored import stored
from ..functions.text import trimmed


def session_retention(tokens: DataFrame, keep: int = KEEP_TOKENS) -> DataFrame:
    """Item 36. The tokens that survive pruning: the newest ``keep`` per user.

    Newest is ``created_at`` descending, then id descending.  The rank filter is planned
    with a partial per-task limit before the shuffle, so a user with millions of tokens
    sends at most ``keep`` rows per task.
    """
    return top_n_per_key(tokens, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()],
                         keep, "_rn").drop("_rn")


def session_pruned(tokens: DataFrame, keep: int = KEEP_TOKENS) -> DataFrame:
    """Item 36 (complement). Tokens deleted by pruning: all but the newest ``keep``."""
    kept = session_retention(tokens, keep).select(F.col("id").alias("_kid"))
    return tokens.join(kept, tokens["id"] == kept["_kid"], "left_anti")


def active_sessions(tokens: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Item 37. Tokens whose user exists, with the user and ``expired = as_of > expires_at``."""
    u = users.select(F.col("id").alias("_uid"), "email", "name", "role")
    return (tokens.join(u, tokens["user_id"] == u["_uid"], "inner").drop("_uid")
            .select("id", "user_id", "token_hash", "created_at", "expires_at", "email", "name",
                    "role", (ts_lit(as_of) > F.col("expires_at")).alias("expired")))


def _status(used: F.Column, expires_at: F.Column, as_of) -> F.Column:
    return (F.when(used, F.lit("used"))
            .when(ts_lit(as_of) > expires_at, F.lit("expired"))
            .otherwise(F.lit("valid")))


def _target(purpose: F.Column) -> F.Column:
    return F.when(purpose.startswith(CHANGE_EMAIL_PREFIX),
                  F.substring(purpose, len(CHANGE_EMAIL_PREFIX) + 1, 1 << 20))


def code_status(codes: DataFrame, as_of) -> DataFrame:
    """Item 38. Newest row per (email, purpose, code) and its state: used > expired > valid.

    ``new_email`` is the address carried by a ``change_email:<address>`` purpose.
    """
    newest = latest_per_key(codes, ["email", "purpose", "code"],
                            [F.col("created_at").desc(), F.col("id").desc()])
    return newest.select("email", "purpose", "code", "id", "created_at", "expires_at",
                         _status(F.col("used"), F.col("expires_at"), as_of).alias("status"),
                         _target(F.col("purpose")).alias("new_email"))


def current_codes(codes: DataFrame, as_of) -> DataFrame:
    """Item 38 (replacement). Issuing a code deletes older codes of the same (email,
    purpose), so the live set is the newest row per (email, purpose)."""
    newest = latest_per_key(codes, ["email", "purpose"],
                            [F.col("created_at").desc(), F.col("id").desc()])
    return newest.select("email", "purpose", "code", "id", "created_at", "expires_at",
                         _status(F.col("used"), F.col("expires_at"), as_of).alias("status"))


def code_check(attempts: DataFrame, codes: DataFrame, as_of) -> DataFrame:
    """Item 38 (lookup). Each attempt (attempt_id, email, purpose, code) against the newest
    matching code: ``invalid`` (no match), ``used``, ``expired`` or ``ok``.

    An attempt whose purpose is exactly ``change_email:`` matches any
    ``change_email:<address>`` code, and reports the address.  The attempt's address is
    trimmed and lower-cased for the lookup.  A code works once: of a batch's good attempts
    on one code the first (by attempt_id) is ``ok``, the others are ``used``.

    The attempts with their codes are stored once, as the search for the first reads them twice.
    """
    newest = latest_per_key(
        codes.withColumn("_kind", F.when(F.col("purpose").startswith(CHANGE_EMAIL_PREFIX),
                                         F.lit(CHANGE_EMAIL_PREFIX)).otherwise(F.col("purpose"))),
        ["email", "_kind", "code"], [F.col("created_at").desc(), F.col("id").desc()])
    n = newest.select(F.col("email").alias("_e"), F.col("_kind"), F.col("code").alias("_c"),
                      F.col("id").alias("code_id"), "used", "expires_at",
                      _target(F.col("purpose")).alias("new_email"))
    # The address is a column of its own: a sort by an expression evaluates it at every comparison.
    a = attempts.select("attempt_id", "email", "purpose", "code", F.lower(trimmed(F.col("email"))).alias("_address"))
    j = a.join(n, (a["_address"] == n["_e"]) & (a["purpose"] == n["_kind"]) & (a["code"] == n["_c"]), "left")
    result = (F.when(F.col("code_id").isNull(), F.lit("invalid"))
              .when(F.col("used"), F.lit("used"))
              .when(ts_lit(as_of) > F.col("expires_at"), F.lit("expired"))
              .otherwise(F.lit("ok")))
    j = stored(j.select("attempt_id", "email", "purpose", "code", "code_id", result.alias("result"), "new_email"), "code-check")
    j = flag_first(j, ["code_id"], ["attempt_id"], "_first", when=F.col("result") == "ok")
    spent = (F.col("result") == "ok") & ~F.col("_first")
    return j.select("attempt_id", "email", "purpose", "code", "code_id",
                    F.when(spent, "used").otherwise(F.col("result")).alias("result"), "new_email")


def codes_after_check(attempts: DataFrame, codes: DataFrame, as_of) -> DataFrame:
    """Item 38 (new state). The codes table with every code that an attempt used up marked."""
    return mark_spent(codes, code_check(attempts, codes, as_of))


def mark_spent(codes: DataFrame, checked: DataFrame) -> DataFrame:
    """The codes table with every code marked as used that ``checked`` (of ``code_check``) used up."""
    spent = checked.where(F.col("result") == "ok").select(F.col("code_id").alias("_cid"))
    marked = codes.join(spent, codes["id"] == spent["_cid"], "left")
    return marked.select(*[(F.col("used") | F.col("_cid").isNotNull()).alias("used") if c == "used" else F.col(c)
                           for c in codes.columns])
