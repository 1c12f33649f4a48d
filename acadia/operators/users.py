"""User-facing reports: user directory, application queue and detail, partner profile,
entitlements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import eq_if, page, search, ts_lit, where
from ..functions.keys import latest_per_key
from ..functions.keyset import NEWEST, page_after
from ..functions.trigrams import Index, indexed_search

USER_PUBLIC_COLUMNS = ["id", "email", "name", "role", "email_verified", "created_at"]


def user_directory(users: DataFrame, role=None, term=None, page_no: int = 1,
                   limit: int = 20, last_seen: tuple | None = None, index: Index | None = None) -> DataFrame:
    """Item 6. Filtered users, newest first, without credentials (id breaks ties).

    ``last_seen``, the (created_at, id) of the row before the page, pages by key instead of by
    number.  ``index`` is a trigram index of e-mail and name (``functions.trigrams``).
    """
    rows = where(users, eq_if("role", role))
    rows = where(rows, search(term, "email", "name")) if index is None else indexed_search(rows, "id", ["email", "name"], term, index)
    rows = rows.select(*USER_PUBLIC_COLUMNS)
    if last_seen is not None:
        return page_after(rows, NEWEST, last_seen, limit)
    return page(rows, [F.col("created_at").desc(), F.col("id").desc()], page_no, limit)


def application_queue(applications: DataFrame, status=None, term=None, page_no: int = 1,
                      limit: int = 20, last_seen: tuple | None = None) -> DataFrame:
    """Item 9. Applications, pending first then newest, searched on name/email/telegram.

    Each row also carries ``total``, the number of applications matching the filters.
    ``last_seen``: (0 if pending else 1, created_at, id) of the row before the page.
    """
    rows = where(applications, eq_if("status", status),
                 search(term, "name", "email", "telegram"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    place = F.when(F.col("status") == "pending", 0).otherwise(1)
    if last_seen is not None:
        return page_after(rows, [(place, True), *NEWEST], last_seen, limit).crossJoin(total)
    order = [place, F.col("created_at").desc(), F.col("id").desc()]
    return page(rows, order, page_no, limit).crossJoin(total)


def application_detail(applications: DataFrame, users: DataFrame, app_id=None) -> DataFrame:
    """Item 10. Applications left-joined to their user's email and name."""
    a = where(applications, eq_if("id", app_id))
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("user_email"),
                     F.col("name").alias("user_name"))
    return a.join(u, a["user_id"] == u["_uid"], "left").drop("_uid")


def partner_profile(partners: DataFrame, users: DataFrame,
                    applications: DataFrame) -> DataFrame:
    """Item 15. Per user: the partner profile if any, else their latest application status.

    Users with neither get a row with NULLs (``application_status`` NULL), as the
    original answers "not found" with a NULL status.
    """
    extra = ([F.col("created_at").alias("partner_created_at")]
             if "created_at" in partners.columns else [])
    prof = partners.select(F.col("user_id").alias("p_user"), F.col("id").alias("partner_id"),
                           "slug", "promo_code", "balance", "total_earned", *extra)
    latest = latest_per_key(applications.where(F.col("user_id").isNotNull()), ["user_id"],
                            [F.col("created_at").desc(), F.col("id").desc()]) \
        .select(F.col("user_id").alias("a_user"), F.col("status").alias("last_status"))
    u = users.select(F.col("id").alias("user_id"), "name", "email")
    return (u.join(prof, u["user_id"] == prof["p_user"], "left")
            .join(latest, u["user_id"] == latest["a_user"], "left")
            .select("user_id", "name", "email", "partner_id", "slug", "promo_code",
                    "balance", "total_earned", *(["partner_created_at"] if extra else []),
                    F.col("partner_id").isNotNull().alias("has_profile"),
                    F.when(F.col("partner_id").isNull(), F.col("last_status"))
                    .alias("application_status")))


def user_entitlements(users: DataFrame, orders: DataFrame, subscriptions: DataFrame,
                      as_of, user_ids: DataFrame | None = None) -> DataFrame:
    """Item 24. Per user: latest paid product, chosen active subscription, access flags.

    - ``course_plan``: product of the newest paid order (may be NULL).
    - subscription: among rows with status 'active', the latest ``expires_at`` where NULL
      (unlimited) wins, then plan; its plan/status/expiry are reported.
    - flags: ``has_paid_order``; ``course_access`` (paid order or admin, server rule);
      ``course_plan_access`` (course_plan not NULL, page rule); ``sub_active_any`` (any
      active row); ``sub_active_server`` (active and expiry NULL or after ``as_of``);
      ``sub_active_page`` (chosen row's expiry set and after ``as_of``);
      ``materials_access`` (admin or ``sub_active_server``).

    ``user_ids`` (column ``user_id``) restricts the result to those users; orders and
    subscriptions are semi-joined to them before ranking.
    """
    now = ts_lit(as_of)
    if user_ids is not None:
        wanted = user_ids.select(F.col("user_id").alias("_want")).distinct()
        users = users.join(wanted, users["id"] == wanted["_want"], "left_semi")
        orders = orders.join(wanted, orders["user_id"] == wanted["_want"], "left_semi")
        subscriptions = subscriptions.join(wanted, subscriptions["user_id"] == wanted["_want"],
                                           "left_semi")
    paid = orders.filter(F.col("status") == "paid")
    latest = latest_per_key(paid, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()]) \
        .select(F.col("user_id").alias("o_user"), F.col("product").alias("course_plan"),
                F.lit(True).alias("_paid"))
    active = subscriptions.filter(F.col("status") == "active")
    sub_flags = active.groupBy(F.col("user_id").alias("s_user")).agg(
        F.lit(True).alias("_any_active"),
        F.bool_or(F.col("expires_at").isNull() | (F.col("expires_at") > now))
        .alias("_server_active"))
    chosen = latest_per_key(active, ["user_id"],
                            [F.col("expires_at").desc_nulls_first(), F.col("plan").asc()]) \
        .select(F.col("user_id").alias("c_user"), F.col("plan").alias("subscription_plan"),
                F.col("status").alias("subscription_status"), "expires_at")
    u = users.select(F.col("id").alias("user_id"), "name", "email", "role", "email_verified",
                     "created_at")
    j = (u.join(latest, u["user_id"] == latest["o_user"], "left")
         .join(sub_flags, u["user_id"] == sub_flags["s_user"], "left")
         .join(chosen, u["user_id"] == chosen["c_user"], "left"))
    is_admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    has_paid = F.coalesce(F.col("_paid"), F.lit(False))
    server = F.coalesce(F.col("_server_active"), F.lit(False))
    return j.select(
        "user_id", "name", "email", "role", "email_verified", "created_at",
        "course_plan", "subscription_plan", "subscription_status",
        "expires_at",
        has_paid.alias("has_paid_order"),
        (has_paid | is_admin).alias("course_access"),
        F.col("course_plan").isNotNull().alias("course_plan_access"),
        F.coalesce(F.col("_any_active"), F.lit(False)).alias("sub_active_any"),
        server.alias("sub_active_server"),
        F.coalesce(F.col("expires_at") > now, F.lit(False)).alias("sub_active_page"),
        (is_admin | server).alias("materials_access"))
