"""Sales reports over orders: daily chart, dashboard, sales list and its totals, order history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHART_DEFAULT_DAYS, PARTNERSHIP_PRODUCT
from ..functions.filters import day_range, eq_if, page, page_joined, search, since, ts_lit, where
from ..functions.keyset import NEWEST, after, page_after
from ..functions.money import money_sum
from ..functions.trigrams import Index, indexed_search


def sales_daily(orders: DataFrame, as_of=None, start=None, end=None,
                days: int | None = None, product: str | None = None) -> DataFrame:
    """Item 1. Paid orders per calendar day of ``paid_at`` and product: count, revenue.

    With both ``start`` and ``end`` the range is ``[start, end + 1 day)``; otherwise it
    is the rolling ``paid_at >= as_of - days`` (``days`` missing or 0 means 14).  Without
    a product filter, 'Partnership' is left out; ``!=`` also drops NULL products.
    """
    if start and end:
        window = day_range("paid_at", start, end)
    else:
        window = since("paid_at", as_of, days or CHART_DEFAULT_DAYS)
    product_cond = (F.col("product") == F.lit(product)) if product else (
        F.col("product") != F.lit(PARTNERSHIP_PRODUCT))
    return (orders
            .filter((F.col("status") == "paid") & product_cond & window)
            .groupBy(F.to_date("paid_at").alias("day"), F.col("product"))
            .agg(F.count(F.lit(1)).cast("int").alias("count"),
                 money_sum(F.col("amount")).alias("revenue")))


def dashboard_stats(users: DataFrame, orders: DataFrame, partners: DataFrame,
                    applications: DataFrame, payouts: DataFrame, as_of) -> DataFrame:
    """Item 2. One row of headline numbers; one conditional aggregate per table.

    Each side is a global aggregate (partial per task, one merge row), so the final
    cross join is between five one-row frames.
    """
    lower = ts_lit(as_of) - F.make_dt_interval(days=F.lit(30))
    u = users.agg(F.count(F.lit(1)).alias("users_total"),
                  F.count_if(F.col("created_at") > lower).alias("users_last30d"))
    o = orders.agg(F.count(F.lit(1)).alias("orders_total"),
                   F.coalesce(money_sum(F.when(F.col("status") == "paid", F.col("amount"))),
                              F.lit(0).cast("decimal(18,2)")).alias("orders_revenue"),
                   F.count_if(F.col("status") == "paid").alias("orders_paid"))
    p = partners.agg(F.count(F.lit(1)).alias("partners_total"))
    a = applications.agg(F.count_if(F.col("status") == "pending").alias("pending_applications"))
    pay = payouts.agg(F.coalesce(money_sum(F.when(F.col("status") == "pending", F.col("amount"))),
                                 F.lit(0).cast("decimal(18,2)")).alias("pending_payouts"))
    return u.crossJoin(o).crossJoin(p).crossJoin(a).crossJoin(pay)


def _sales_filter(orders: DataFrame, users: DataFrame, status=None, product=None, start=None,
                  end=None, term=None) -> DataFrame:
    """Orders inner-joined to their buyer, with the optional sales-list filters."""
    o = where(orders, eq_if("status", status), eq_if("product", product),
              day_range("created_at", start, None) if start else None,
              day_range("created_at", None, end) if end else None)
    u = users.select(F.col("id").alias("buyer_id"), F.col("email").alias("buyer_email"),
                     F.col("name").alias("buyer_name"))
    joined = o.join(u, o["user_id"] == u["buyer_id"], "inner")
    return where(joined, search(term, "buyer_email", "buyer_name"))


def sales_totals(orders: DataFrame, users: DataFrame, status=None, product=None, start=None,
                 end=None, term=None) -> DataFrame:
    """Item 3. Count of the filtered sales and their paid revenue (0 when none)."""
    f = _sales_filter(orders, users, status, product, start, end, term)
    return f.agg(F.count(F.lit(1)).alias("total"),
                 F.coalesce(money_sum(F.when(F.col("status") == "paid", F.col("amount"))),
                            F.lit(0).cast("decimal(18,2)")).alias("revenue"))


def sales_page(orders: DataFrame, users: DataFrame, partners: DataFrame, status=None,
               product=None, start=None, end=None, term=None, page_no: int = 1,
               limit: int = 20, last_seen: tuple | None = None, index: Index | None = None) -> DataFrame:
    """Item 4. One page of sales, newest first, with buyer and partner slug.

    The partner side is a left join, so orders attributed to a missing partner stay.
    Ties on ``created_at`` are broken by order id (descending).  The newest
    ``offset + limit`` orders are cut first and joined; only if the buyer join drops
    some of them (missing user, search term) is the full join paged.

    ``last_seen``, the (created_at, id) of the row before the page, pages by key: a predicate on the
    orders, no job while the plan is made and no offset.  ``index`` is a trigram index of the
    users' e-mail and name: the matching buyers are found first and only their orders joined.
    """
    o = where(orders, eq_if("status", status), eq_if("product", product),
              day_range("created_at", start, None) if start else None,
              day_range("created_at", None, end) if end else None)
    u = users.select(F.col("id").alias("buyer_id"), F.col("email").alias("buyer_email"),
                     F.col("name").alias("buyer_name"))
    p = partners.select(F.col("id").alias("p_id"), F.col("slug").alias("partner_slug"))

    if index is not None:
        u = indexed_search(u, "buyer_id", ["buyer_email", "buyer_name"], term, index)

    def joiner(left: DataFrame) -> DataFrame:
        j = left.join(u, left["user_id"] == u["buyer_id"], "inner")
        j = j if index is not None else where(j, search(term, "buyer_email", "buyer_name"))
        return (j.join(p, j["referral_partner_id"] == p["p_id"], "left")
                .select("id", "product", "amount", "promo_code", "status", "created_at",
                        "paid_at", "buyer_email", "buyer_name", "partner_slug"))

    if last_seen is not None or (index is not None and term):
        seen = o if last_seen is None else o.where(after(NEWEST, last_seen))
        if last_seen is None and page_no > 1:
            return page(joiner(seen), [F.col("created_at").desc(), F.col("id").desc()], page_no, limit)
        return page_after(joiner(seen), NEWEST, None, limit)
    # Exact early cut: the page is taken from the newest orders when none of them is
    # dropped by the buyer join (see functions.filters.page_joined).
    return page_joined(o, joiner, [F.col("created_at").desc(), F.col("id").desc()],
                       page_no, limit)


def order_history(orders: DataFrame, user_id=None) -> DataFrame:
    """Item 21. Orders of one user, or of every user, with the listed columns.

    The original lists one user's orders newest first; here the key is kept in the
    output and, when a user is given, rows are ordered by (created_at desc, id desc).
    Over all users the result is left unsorted (a global sort of every order would be
    a full range shuffle that nothing downstream needs).
    """
    cols = ["user_id", "id", "product", "amount", "status", "promo_code", "created_at", "paid_at"]
    rows = where(orders, eq_if("user_id", user_id)).select(*cols)
    if user_id is not None:
        rows = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows

