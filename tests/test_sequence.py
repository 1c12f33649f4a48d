"""Skew-safe helpers equal their single-task window equivalents, also with a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from acadia.functions.keys import flag_first, latest_per_key
from acadia.functions.sequence import running_total, sequence_number


def _data(spark, n=3000, seed=5):
    rnd = random.Random(seed)
    rows = [(i, 0 if rnd.random() < 0.6 else rnd.randint(1, 30), rnd.randint(1, 1000)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long, v long")


def test_running_total_and_sequence_match_windows(spark):
    d = _data(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    ref = {r.id: (r.s, r.n) for r in d.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.row_number().over(w).alias("n")).collect()}
    rt = {r.id: r.run for r in running_total(d, ["k"], ["v", "id"], "v", "run", partitions=16).collect()}
    sq = {r.id: r.seq for r in sequence_number(d, ["k"], ["v", "id"], "seq", partitions=16).collect()}
    assert rt == {i: s for i, (s, _) in ref.items()}
    assert sq == {i: n for i, (_, n) in ref.items()}


def test_running_total_has_the_windows_type_and_nulls(spark):
    from decimal import Decimal
    rows = [(i, i % 2, None if i % 5 < 3 else Decimal(i)) for i in range(60)] + [(100 + i, 7, None) for i in range(9)]
    d = spark.createDataFrame(rows, "id long, k long, v decimal(12,2)")
    want = d.withColumn("run", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    got = running_total(d, ["k"], ["id"], "v", "run", partitions=6)
    assert got.schema["run"].dataType == want.schema["run"].dataType
    assert {r.id: r.run for r in got.collect()} == {r.id: r.run for r in want.collect()}


def test_hot_key_is_spread_over_partitions(spark):
    d = _data(spark)
    from acadia.functions.sequence import _laid_out
    laid = _laid_out(d, ["k"], ["v", "id"], 16)
    parts = laid.where("k = 0").select("_pid").distinct().count()
    assert parts > 4   # the key with 60 % of the rows does not sit in one task


def test_flag_first_and_latest(spark):
    d = _data(spark)
    first = {r.id for r in flag_first(d, ["k"], ["v", "id"], "f").where("f").collect()}
    lat = {r.id for r in latest_per_key(d, ["k"], [F.col("v").asc(), F.col("id").asc()]).collect()}
    w = Window.partitionBy("k").orderBy("v", "id")
    ref = {r.id for r in d.withColumn("n", F.row_number().over(w)).where("n = 1").collect()}
    assert first == ref == lat


def test_page_joined_equals_full_join_page(spark):
    from acadia.functions.filters import page, page_joined, search, where
    rnd = random.Random(7)
    left = spark.createDataFrame(
        [(i, rnd.randint(0, 40), rnd.randint(1, 60)) for i in range(300)], "id long, t long, uid long")
    right = spark.createDataFrame([(u, f"user{u}") for u in range(1, 50) if u % 7], "rid long, name string")
    order = [F.col("t").desc(), F.col("id").desc()]
    for term in (None, "user1"):
        def joiner(df, term=term):
            j = df.join(right, df["uid"] == right["rid"], "inner")
            return where(j, search(term, "name")).select("id", "t", "uid", "name")
        for page_no, limit in ((1, 5), (3, 7), (40, 10), (2, 400)):
            got = [tuple(r) for r in page_joined(left, joiner, order, page_no, limit).collect()]
            want = [tuple(r) for r in page(joiner(left), order, page_no, limit).collect()]
            assert got == want, (term, page_no, limit)


def test_null_keys_are_kept_as_a_group(spark):
    rows = [(i, None if i % 3 == 0 else i % 2, i * 10) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, k long, v long")
    w = Window.partitionBy("k").orderBy("id")
    ref = {r.id: (r.s, r.n) for r in d.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.row_number().over(w).alias("n")).collect()}
    rt = {r.id: r.run for r in running_total(d, ["k"], ["id"], "v", "run", partitions=4).collect()}
    sq = {r.id: r.seq for r in sequence_number(d, ["k"], ["id"], "seq", partitions=4).collect()}
    assert rt == {i: s for i, (s, _) in ref.items()}
    assert sq == {i: n for i, (_, n) in ref.items()}
