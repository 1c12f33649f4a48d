"""Chained jobs read their attempts once, however many steps and searches use the outcome."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acadia.operators import chains, sessions
from acadia.sources.domain import publish, write_version

AS_OF = dt.datetime(2001, 8, 1)
N = 40


def _tables(spark, purpose):
    ids = spark.range(N).select(F.col("id"), F.concat(F.lit("u"), "id", F.lit("@x")).alias("email"))
    users = ids.select("id", "email", F.lit("user").alias("role"), F.lit(False).alias("email_verified"))
    codes = ids.select("id", "email", F.lit("c").alias("code"), F.format_string(purpose, "id").alias("purpose"), F.lit(AS_OF).alias("created_at"),
                       F.lit(AS_OF + dt.timedelta(1)).alias("expires_at"), F.lit(False).alias("used"))
    return {"users": users, "otp_codes": codes, "refresh_tokens": ids.select("id", F.col("id").alias("user_id"))}


def _counted(spark, rows):
    """``rows``, and an accumulator of how often one of them was made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def code(x):
        made.add(1)
        return x

    return rows.withColumn("code", code.asNondeterministic()("code")), made


def _run(spark, base, tables, steps):
    for n, df in tables.items():
        write_version(df, base, n, "0")
    publish(spark, base, {n: "0" for n in tables})
    return chains.run_chain(spark, base, {n: df.schema for n, df in tables.items()}, steps)[1]


@pytest.mark.parametrize("purpose", ["change_email:n%d@x", "verify_email"])
def test_attempts_are_judged_once(spark, tmp_path, purpose):
    tables = _tables(spark, purpose)
    columns = [F.col("id").alias("attempt_id"), F.col("id").alias("user_id"), "email", "code"]
    attempts, made = _counted(spark, tables["otp_codes"].where("id % 2 = 0").select(*columns, F.lit("verify_email").alias("purpose")))
    verify = purpose == "verify_email"
    state = _run(spark, str(tmp_path / "t"), tables, (chains.verify_steps if verify else chains.email_change_steps)(attempts, AS_OF))
    assert {r.id for r in state["otp_codes"].where("used").collect()} == set(range(0, N, 2))
    assert {r.id for r in state["users"].where("updated_at IS NOT NULL").collect()} == set(range(0, N, 2))
    if not verify:
        assert {r.id: r.email for r in state["users"].collect()} == {i: f"n{i}@x" if i % 2 == 0 else f"u{i}@x" for i in range(N)}
        assert {r.user_id for r in state["refresh_tokens"].collect()} == set(range(1, N, 2))
    assert made.value == N // 2


def test_code_check_reads_attempts_once(spark):
    codes = _tables(spark, "verify_email")["otp_codes"]
    attempts, made = _counted(spark, codes.select(F.col("id").alias("attempt_id"), "email", "purpose", "code"))
    assert {r.result for r in sessions.code_check(attempts, codes, AS_OF).collect()} == {"ok"}
    assert made.value == N


def test_equal_attempts_keep_their_rows(spark):
    """Rows that repeat an attempt are all first or none is, and each meets each."""
    tables = _tables(spark, "change_email:n%d@x")
    attempts = spark.createDataFrame([(1, 2, "u2@x", "c"), (1, 2, "u2@x", "c"), (2, 2, "u2@x", "c"), (None, 4, "u4@x", "c")],
                                     "attempt_id long, user_id long, email string, code string")
    got = chains.email_changes(attempts, tables["otp_codes"], tables["users"], AS_OF).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 2, "n2@x", "changed")] * 4 + [(2, 2, 2, "n2@x", "used")]
