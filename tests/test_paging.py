"""Keyset pages walk the whole order; the trigram index finds what a scan finds, from candidates only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acadia.functions.filters import search
from acadia.functions.keyset import NEWEST, after, page_after
from acadia.functions.trigrams import candidates, grams_of_term, indexed_search, read_index, write_index
from acadia.operators import partners, sales, subscriptions, users


def _walk(page, key, limit):
    rows, last = [], None
    while True:
        got = page(last).collect()
        rows += got
        if len(got) < limit:
            return rows
        last = key(got[-1])


def _ids(rows):
    return [r.id for r in rows]


def test_pages_after_the_last_row_walk_the_whole_order(spark, fx):
    key = lambda r: (r.created_at, r.id)
    start = (dt.datetime(9999, 1, 1), 0)
    walk = _walk(lambda last: sales.sales_page(fx.orders, fx.users, fx.partners, term="00001", limit=7, last_seen=last or start), key, 7)
    want = fx.orders.join(fx.users.where(search("00001", "email", "name")).select(F.col("id").alias("u")), F.col("user_id") == F.col("u"))
    assert _ids(walk) == _ids(want.orderBy(F.desc("created_at"), F.desc("id")).collect()) and len(walk) > 50
    walk = _walk(lambda last: users.user_directory(fx.users, limit=40, last_seen=last or start), key, 40)
    assert _ids(walk) == _ids(fx.users.orderBy(F.desc("created_at"), F.desc("id")).collect())
    walk = _walk(lambda last: users.application_queue(fx.partner_applications, limit=9, last_seen=last or (-1, None, None)),
                 lambda r: (int(r.status != "pending"), r.created_at, r.id), 9)
    assert _ids(walk) == _ids(fx.partner_applications.orderBy(F.col("status") != "pending", F.desc("created_at"), F.desc("id")).collect())
    by_number = subscriptions.subscription_page(fx.orders, fx.users, fx.course_progress, fx.lessons, page_no=3, limit=5)
    second = subscriptions.subscription_page(fx.orders, fx.users, fx.course_progress, fx.lessons, page_no=2, limit=5).collect()
    last = min((r.created_at, r.id) for r in second)
    by_key = subscriptions.subscription_page(fx.orders, fx.users, fx.course_progress, fx.lessons, limit=5, last_seen=last)
    assert sorted(map(str, by_key.collect())) == sorted(map(str, by_number.collect()))
    ties = ["l_orderkey", "l_linenumber", "partner_id", "amount", "method", "status"]
    two = partners.payout_queue(fx.partner_payouts, fx.partners, fx.users, page_no=2, limit=11, tie_break=ties)
    one = partners.payout_queue(fx.partner_payouts, fx.partners, fx.users, page_no=1, limit=11, tie_break=ties).collect()[-1]
    nxt = partners.payout_queue(fx.partner_payouts, fx.partners, fx.users, limit=11, tie_break=ties,
                                last_seen=tuple(one[c] for c in ("created_at", *ties)))
    assert list(map(str, nxt.collect())) == list(map(str, two.collect()))


def test_nulls_and_the_scan(spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else dt.datetime(2001, 1, 1 + i % 5)) for i in range(30)]
    table = spark.createDataFrame(rows, "id long, created_at timestamp")
    walk = _walk(lambda last: page_after(table, NEWEST, last, 4), lambda r: (r.created_at, r.id), 4)
    assert _ids(walk) == _ids(table.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).collect())
    up = [("created_at", True), ("id", True)]
    walk = _walk(lambda last: page_after(table, up, last, 7), lambda r: (r.created_at, r.id), 7)
    assert _ids(walk) == _ids(table.orderBy(F.asc_nulls_first("created_at"), "id").collect())
    table.write.parquet(str(tmp_path / "t"))
    plan = page_after(spark.read.parquet(str(tmp_path / "t")), NEWEST, (dt.datetime(2001, 1, 3), 7))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThanOrEqual(created_at" in plan


def test_a_page_runs_no_job_while_it_is_planned(spark, fx):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job is expected here")
    sales.sales_page(fx.orders, fx.users, fx.partners, term="1", last_seen=(dt.datetime(1998, 1, 1), 0))
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("term", ["0003", "R.0000", "@exa", "a", "", None, "er%0_", "%", "x\\%y", "zzz", "İst", "Straße", "a%b", "cust_mer", "'; --"])
def test_indexed_search_equals_the_scan(spark, tmp_path, fx, term):
    odd = spark.createDataFrame([(10**6, "İSTANBUL x%y", None), (10**6 + 1, None, "STRASSE Straße"), (10**6 + 2, "", "'; -- "), (10**6 + 3, "ab", "a b")],
                                "id long, email string, name string")
    table = fx.users.select("id", "email", "name").unionByName(odd)
    write_index(table, "id", ["email", "name"], str(tmp_path / "i"), 5)
    index = read_index(spark, str(tmp_path / "i"))
    got = indexed_search(table, "id", ["email", "name"], term, index)
    want = table.where(search(term, "email", "name")) if term else table
    assert sorted(_ids(got.collect())) == sorted(_ids(want.collect()))


def test_candidates_are_few(spark, tmp_path, fx):
    write_index(fx.users, "id", ["email", "name"], str(tmp_path / "i"))
    index = read_index(spark, str(tmp_path / "i"))
    assert candidates(index, "ab") is None and candidates(index, "%a%b_") is None
    assert candidates(index, "customer 000000077x").count() == 0
    few = candidates(index, "customer.000000077")
    assert 1 <= few.count() <= 10
    assert grams_of_term("a%bcde_f\\%gh") == ["bcd", "cde"] and grams_of_term("ABCD") == ["abc", "bcd"]
    assert after(NEWEST, (None, 3)) is not None
