"""Hand-made edge cases for the reports (items 1-24)."""

import datetime as dt
from decimal import Decimal as D

from acadia.operators import courses, partners, promo, sales, subscriptions, users

from .conftest import df

ORDERS = ("id long, user_id long, product string, amount decimal(12,2), "
          "referral_partner_id long, promo_code string, status string, "
          "created_at timestamp, paid_at timestamp")
USERS = "id long, email string, name string, role string, email_verified boolean, created_at timestamp"
T = dt.datetime


def o(i, product, status="paid", paid=T(2001, 7, 31, 23, 0), amount="10.00", user=1,
      partner=None, code=None, created=None):
    return (i, user, product, D(amount), partner, code, status, created or paid, paid)


def test_sales_daily_null_product_and_end_day(spark):
    rows = [o(1, None), o(2, "Essential"), o(3, "Partnership"),
            o(4, "Essential", paid=T(2001, 8, 1, 0, 0)),       # first instant after 'to' day
            o(5, "Essential", paid=T(2001, 7, 31, 23, 59, 59)),
            o(6, "Essential", status="pending")]
    out = sales.sales_daily(df(spark, rows, ORDERS), start="2001-07-31", end="2001-07-31").collect()
    assert [(r.day, r.product, r["count"], r.revenue) for r in out] == \
        [(dt.date(2001, 7, 31), "Essential", 2, D("20.00"))]


def test_sales_daily_default_window_is_14_days(spark):
    as_of = T(2001, 8, 1)
    rows = [o(1, "Extra", paid=as_of - dt.timedelta(days=14)),
            o(2, "Extra", paid=as_of - dt.timedelta(days=14, seconds=1))]
    for days in (None, 0):
        out = sales.sales_daily(df(spark, rows, ORDERS), as_of=as_of, days=days).collect()
        assert sum(r["count"] for r in out) == 1


def test_subscription_stats_empty_and_rounding(spark):
    empty = subscriptions.subscription_stats(df(spark, [], ORDERS), T(2001, 8, 1)).collect()[0]
    assert (empty.total, empty.revenue, empty.active_pct, empty.completed_pct) == (0, D("0.00"), 0, 0)
    rows = [o(1, "Essential")] + [o(i, "Essential", status="pending") for i in range(2, 9)]
    s = subscriptions.subscription_stats(df(spark, rows, ORDERS), T(2001, 8, 1)).collect()[0]
    assert (s.total, s.active, s.active_pct) == (8, 1, 13)  # 12.5 % rounds half up


def test_subscription_stats_last30d_is_strict(spark):
    as_of = T(2001, 8, 1)
    edge = as_of - dt.timedelta(days=30)
    rows = [o(1, "Essential", created=edge), o(2, "Essential", created=edge + dt.timedelta(seconds=1))]
    s = subscriptions.subscription_stats(df(spark, rows, ORDERS), as_of).collect()[0]
    assert s.last30d == 1


def test_sales_page_breaks_ties_by_id(spark):
    same = T(2001, 7, 1)
    rows = [o(i, "Essential", created=same) for i in range(1, 6)]
    u = df(spark, [(1, "a@x", "A", "user", True, same)], USERS)
    p = df(spark, [], "id long, slug string")
    page = sales.sales_page(df(spark, rows, ORDERS), u, p, page_no=2, limit=2).collect()
    assert [r.id for r in page] == [3, 2]


def test_search_wildcards_are_not_escaped(spark):
    u = df(spark, [(1, "a_b@x", "n", "user", True, T(2001, 1, 1)),
                   (2, "axb@x", "n", "user", True, T(2001, 1, 2))], USERS)
    got = {r.id for r in users.user_directory(u, term="a_b").collect()}
    assert got == {1, 2}  # '_' matches any character, as with ILIKE in the original


def test_subscription_page_plan_end_and_progress(spark):
    start = T(2001, 1, 31)
    rows = [o(1, "Essential", paid=start), o(2, "Gift", paid=None, status="pending", created=start)]
    u = df(spark, [(1, "a@x", "A", "user", True, start)], USERS)
    prog = df(spark, [(1, 1, True, True, start, start), (1, 2, True, False, start, None)],
              "user_id long, lesson_id int, viewed boolean, completed boolean, "
              "viewed_at timestamp, completed_at timestamp")
    les = df(spark, [(1, "l1", 1, True), (2, "l2", 2, False), (3, "l3", 3, False)],
             "id int, title string, sort_order int, is_free boolean")
    out = {r.id: r for r in subscriptions.subscription_page(df(spark, rows, ORDERS), u, prog, les).collect()}
    assert out[1].end_at == start + dt.timedelta(days=30)
    assert out[2].end_at is None and out[2].start_at == start
    assert (out[1].completed_lessons, out[1].total_lessons, out[1].progress_pct) == (1, 3, 33)


def test_promo_code_usage_status_precedence(spark):
    codes = df(spark, [(1, "A", 10, T(1999, 1, 1), False), (2, "B", 10, T(1999, 1, 1), True),
                       (3, "C", 10, None, True)],
               "id int, code string, discount_percent int, expires_at timestamp, is_active boolean")
    rows = [o(1, "Essential", code="C"), o(2, "Essential", code="C", status="refunded")]
    out = {r.code: r for r in promo.promo_code_usage(codes, df(spark, rows, ORDERS), T(2001, 8, 1)).collect()}
    assert [out[k].code_status for k in "ABC"] == ["disabled", "expired", "active"]
    assert (out["C"].use_count, out["C"].revenue, out["A"].revenue) == (2, D("10.00"), D("0.00"))


def test_partner_purchases_source_and_commission(spark):
    u = df(spark, [(1, "", "A", "user", True, T(2001, 1, 1)), (2, "b@x", "B", "user", True, T(2001, 1, 1))], USERS)
    p = df(spark, [(7, 99, "p7", "P7", D("0"), D("0"))],
           "id long, user_id long, slug string, promo_code string, balance decimal(12,2), "
           "total_earned decimal(12,2)")
    rows = [o(1, "Course Deluxe", partner=7, code="", user=1, amount="0.03"),
            o(2, "EXTRA pack", partner=7, code="", user=2, amount="10.05"),
            o(3, "x", partner=8, user=2)]
    out = {r.id: r for r in partners.partner_purchases(df(spark, rows, ORDERS), u, p).collect()}
    assert set(out) == {1, 2}
    assert (out[1].source, out[1].product_class, out[1].commission) == ("—", "deluxe", D("0.01"))
    assert (out[2].source, out[2].product_class, out[2].commission) == ("b@x", "extra", D("2.01"))


def test_lesson_engagement_counts_rows_not_viewed(spark):
    les = df(spark, [(1, "l1", 1, True), (2, "l2", 2, False)],
             "id int, title string, sort_order int, is_free boolean")
    prog = df(spark, [(1, 1, False, False, None, None), (2, 1, True, True, None, None)],
              "user_id long, lesson_id int, viewed boolean, completed boolean, "
              "viewed_at timestamp, completed_at timestamp")
    out = {r.id: r for r in courses.lesson_engagement(les, prog).collect()}
    assert (out[1].viewed_count, out[1].completed_count) == (2, 1)
    assert (out[2].viewed_count, out[2].completed_count) == (0, 0)


def test_user_entitlements_variants(spark):
    as_of = T(2001, 8, 1)
    u = df(spark, [(1, "a@x", "A", "user", True, as_of), (2, "b@x", "B", "admin", True, as_of),
                   (3, "c@x", "C", "user", True, as_of)], USERS)
    rows = [o(1, None, paid=T(2001, 7, 2), created=T(2001, 7, 2)),
            o(2, "Extra", paid=T(2001, 7, 1), created=T(2001, 7, 1))]
    subs = df(spark, [(1, "a", "active", None), (1, "b", "active", T(2002, 1, 1)),
                      (3, "c", "active", T(2000, 1, 1))],
              "user_id long, plan string, status string, expires_at timestamp")
    out = {r.user_id: r for r in users.user_entitlements(u, df(spark, rows, ORDERS), subs, as_of).collect()}
    a, b, c = out[1], out[2], out[3]
    assert (a.course_plan, a.has_paid_order, a.course_access, a.course_plan_access) == (None, True, True, False)
    assert (a.subscription_plan, a.sub_active_server, a.sub_active_page) == ("a", True, False)
    assert (b.course_access, b.materials_access, b.sub_active_any) == (True, True, False)
    assert (c.sub_active_any, c.sub_active_server, c.sub_active_page) == (True, False, False)


def test_sales_page_skips_orphans_exactly(spark):
    # The two newest orders have no buyer: the early cut drops them, so the full join is paged.
    rows = [o(i, "Essential", created=T(2001, 7, i), user=(9 if i >= 9 else 1)) for i in range(1, 11)]
    u = df(spark, [(1, "a@x", "A", "user", True, T(2001, 1, 1))], USERS)
    p = df(spark, [], "id long, slug string")
    page1 = sales.sales_page(df(spark, rows, ORDERS), u, p, page_no=1, limit=3).collect()
    page2 = sales.sales_page(df(spark, rows, ORDERS), u, p, page_no=2, limit=3).collect()
    assert [r.id for r in page1] == [8, 7, 6] and [r.id for r in page2] == [5, 4, 3]
    # without orphans the early cut is used and gives the same kind of page
    clean = [r for r in rows if r[1] == 1]
    assert [r.id for r in sales.sales_page(df(spark, clean, ORDERS), u, p, limit=2).collect()] == [8, 7]


def test_lesson_catalog_for_some_users(spark, fx):
    ids = spark.createDataFrame([(1,), (2,)], "user_id long")
    some = courses.lesson_catalog(fx.users, fx.lessons, fx.lesson_topics, fx.lesson_videos,
                                  fx.course_progress, fx.orders, user_ids=ids)
    full = courses.lesson_catalog(fx.users, fx.lessons, fx.lesson_topics, fx.lesson_videos,
                                  fx.course_progress, fx.orders)
    assert sorted(map(tuple, some.collect())) == \
        sorted(map(tuple, full.where("user_id IN (1, 2)").collect()))
    assert some.count() == 2 * fx.lessons.count()


def test_per_user_views_for_some_users(spark, fx):
    ids = spark.createDataFrame([(4,), (8,), (12,)], "user_id long")
    for some, full in (
            (courses.progress_summary(fx.course_progress, fx.lessons, user_ids=ids),
             courses.progress_summary(fx.course_progress, fx.lessons)),
            (users.user_entitlements(fx.users, fx.orders, fx.subscriptions, T(2001, 8, 1), user_ids=ids),
             users.user_entitlements(fx.users, fx.orders, fx.subscriptions, T(2001, 8, 1)))):
        want = full.where("user_id IN (4, 8, 12)")
        assert sorted(map(str, some.collect())) == sorted(map(str, want.collect()))


def test_sales_totals_with_open_date_bounds(spark):
    rows = [o(i, "Essential", created=T(2001, 7, i)) for i in range(1, 11)]
    u = df(spark, [(1, "a@x", "A", "user", True, T(2001, 1, 1))], USERS)
    orders = df(spark, rows, ORDERS)
    assert sales.sales_totals(orders, u, start="2001-07-05").collect()[0].total == 6
    assert sales.sales_totals(orders, u, end="2001-07-05").collect()[0].total == 5


def test_public_materials_only_four_categories(spark, fx):
    assert courses.material_listing(fx.materials, category="updates", public=True).count() == 0
    assert courses.material_listing(fx.materials, category="nope", public=True).count() == 0
    maps = courses.material_listing(fx.materials, category="maps", public=True)
    assert maps.count() == fx.materials.where("category = 'maps'").count() > 0
    assert "category" not in maps.columns


def test_single_lesson_and_application_detail(spark, fx):
    one = courses.lesson_outline(fx.lessons, fx.lesson_topics, fx.lesson_videos, lesson_id=3)
    assert {r.lesson_id for r in one.collect()} == {3}
    eng = courses.lesson_engagement(fx.lessons, fx.course_progress, lesson_id=3).collect()
    assert [r.id for r in eng] == [3]
    app_id = fx.partner_applications.first().id
    detail = users.application_detail(fx.partner_applications, fx.users, app_id=app_id).collect()
    assert [r.id for r in detail] == [app_id] and detail[0].user_email is not None
