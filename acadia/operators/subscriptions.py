"""Course subscription reports: headline stats (item 7) and the subscription list (item 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PARTNERSHIP_PRODUCT, PLAN_DAYS
from ..functions.filters import BROADCAST_KEYS, eq_if, page_joined, search, since, where
from ..functions.keyset import NEWEST, after, page_after
from ..functions.money import money_sum, percent_of


def subscription_stats(orders: DataFrame, as_of) -> DataFrame:
    """Item 7. Non-partnership orders: totals by status, paid revenue, new paid in 30 days.

    active = paid, completed = refunded, on_pause = pending; ``last30d`` counts paid
    orders created strictly after ``as_of - 30 days``; the two percentages are
    ``Math.round`` of the share of the total, 0 when there is no order.
    """
    base = orders.filter(F.col("product") != F.lit(PARTNERSHIP_PRODUCT))
    s = base.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "paid").alias("active"),
        F.count_if(F.col("status") == "refunded").alias("completed"),
        F.count_if(F.col("status") == "pending").alias("on_pause"),
        F.coalesce(money_sum(F.when(F.col("status") == "paid", F.col("amount"))),
                   F.lit(0).cast("decimal(18,2)")).alias("revenue"),
        F.count_if((F.col("status") == "paid") & since("created_at", as_of, 30, strict=True))
        .alias("last30d"))
    return s.select("*", percent_of(F.col("active"), F.col("total")).alias("active_pct"),
                    percent_of(F.col("completed"), F.col("total")).alias("completed_pct"))


def plan_end(product: F.Column, start: F.Column, plan_days: dict | None = None) -> F.Column:
    """``start + N days`` for a product with a fixed plan length, else NULL (unlimited)."""
    days = None
    for name, n in (plan_days or PLAN_DAYS).items():
        cond = product == F.lit(name)
        days = F.when(cond, F.lit(n)) if days is None else days.when(cond, F.lit(n))
    return start + F.make_dt_interval(days=days)


def subscription_page(orders: DataFrame, users: DataFrame, progress: DataFrame,
                      lessons: DataFrame, status=None, term=None, page_no: int = 1,
                      limit: int = 20, plan_days: dict | None = None, last_seen: tuple | None = None) -> DataFrame:
    """Item 8. One page of course subscriptions with progress and plan dates.

    The page is cut first (bounded top-k over orders, joined to buyers; the full join
    only when that drops rows), then only the page's users are looked up in
    ``course_progress``: the progress scan is filtered by a
    semi-join against at most ``limit`` ids before it is aggregated.  ``last_seen``, the
    (created_at, id) of the row before the page, pages by key instead of by number.
    """
    o = where(orders.filter(F.col("product") != F.lit(PARTNERSHIP_PRODUCT)),
              eq_if("status", status))
    u = users.select(F.col("id").alias("uid"), F.col("email").alias("buyer_email"),
                     F.col("name").alias("buyer_name"))

    def joiner(left: DataFrame) -> DataFrame:
        rows = where(left.join(u, left["user_id"] == u["uid"], "inner"),
                     search(term, "buyer_email", "buyer_name"))
        return rows.select("id", "product", "amount", "promo_code", "status", "created_at",
                           "paid_at", "buyer_email", "buyer_name", "user_id")

    if last_seen is not None:
        top = page_after(joiner(o.where(after(NEWEST, last_seen))), NEWEST, None, limit)
    else:
        top = page_joined(o, joiner, [F.col("created_at").desc(), F.col("id").desc()],
                          page_no, limit)

    page_users = top.select(F.col("user_id").alias("puid")).distinct()
    done = (progress.join(F.broadcast(page_users) if int(limit or 20) <= BROADCAST_KEYS else page_users, progress["user_id"] == page_users["puid"],
                          "left_semi")
            .groupBy(F.col("user_id").alias("cp_user"))
            .agg(F.count_if(F.col("completed")).alias("completed_count")))
    total = lessons.agg(F.count(F.lit(1)).alias("total_lessons"))
    start = F.coalesce(F.col("paid_at"), F.col("created_at"))
    return (top.join(done, top["user_id"] == done["cp_user"], "left").crossJoin(total)
            .select("id", "product", "amount", "promo_code", "status", "created_at", "paid_at",
                    "buyer_email", "buyer_name", "user_id",
                    F.coalesce(F.col("completed_count"), F.lit(0)).alias("completed_lessons"),
                    "total_lessons",
                    percent_of(F.coalesce(F.col("completed_count"), F.lit(0)),
                               F.col("total_lessons")).alias("progress_pct"),
                    start.alias("start_at"),
                    plan_end(F.col("product"), start, plan_days).alias("end_at")))
