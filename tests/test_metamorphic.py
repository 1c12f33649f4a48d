
from pyspark.sql import functions as F

from acadia.operators import partners, progress, purge, sales
from acadia.plans.jobs import B_PURGE_USERS, PURGE_ACTOR, _purge_tables


def test_daily_sales_sum_to_paid_revenue(fx):
    start, end = "1996-01-01", "1997-12-31"
    daily = sales.sales_daily(fx.orders, start=start, end=end, product="Extra")
    by_day = daily.agg(F.sum("revenue").alias("r"), F.sum("count").alias("n")).collect()[0]
    # Same orders through the other report: paid Extra orders with paid_at in range.
    paid = fx.orders.where((F.col("status") == "paid") & (F.col("product") == "Extra")
                           & (F.col("paid_at") >= "1996-01-01")
                           & (F.col("paid_at") < "1998-01-01"))
    direct = paid.agg(F.sum("amount").alias("r"), F.count(F.lit(1)).alias("n")).collect()[0]
    assert (by_day.r, by_day.n) == (direct.r, direct.n)


def test_partner_stats_totals_equal_attributed_counts(fx):
    st = partners.partner_stats(fx.partners, fx.referrals, fx.orders, "2001-08-01") \
        .agg(F.sum("purchases_total").alias("p"), F.sum("referrals_total").alias("r")).collect()[0]
    known = fx.partners.select(F.col("id").alias("k"))
    paid = fx.orders.where(F.col("status") == "paid") \
        .join(known, F.col("referral_partner_id") == F.col("k"), "left_semi").count()
    refs = fx.referrals.join(known, F.col("partner_id") == F.col("k"), "left_semi").count()
    assert (st.p, st.r) == (paid, refs)


def test_progress_upsert_twice_equals_once(fx):
    once = progress.progress_upsert(fx.progress_events, fx.course_progress, fx.lessons,
                                    fx.orders, fx.users)
    twice = progress.progress_upsert(fx.progress_events, once, fx.lessons, fx.orders, fx.users)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_purge_counts_agree_with_new_tables(fx):
    tables = _purge_tables(fx)
    ids = fx.sql(B_PURGE_USERS)
    after = purge.user_purge(ids, PURGE_ACTOR, tables)
    counts = {r.item: r.n for r in purge.user_purge_counts(ids, PURGE_ACTOR, tables).collect()}
    for name, before in tables.items():
        assert before.count() - after[name].count() == counts[name], name
