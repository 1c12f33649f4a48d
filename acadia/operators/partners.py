"""Partner-programme reports: payout queue, purchases, referrals, payout history, stats,
revenue series (items 5, 16-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (PARTNER_COMMISSION_RATE, PRODUCT_CLASS_OTHER, PRODUCT_CLASSES,
                         REVENUE_PERIOD_OTHER, REVENUE_PERIODS)
from ..functions.filters import eq_if, page_joined, since, where
from ..functions.keyset import after, page_after
from ..functions.money import money, money_sum

# Shown when an attributed order has neither promo code nor buyer e-mail.
SOURCE_MISSING = "—"


def payout_queue(payouts: DataFrame, partners: DataFrame, users: DataFrame, status=None,
                 page_no: int = 1, limit: int = 20, tie_break: list[str] | None = None,
                 last_seen: tuple | None = None) -> DataFrame:
    """Item 5. Payouts with partner slug and e-mail, newest first.

    Both joins are inner, so payouts of a missing partner (or a partner without a user)
    are not listed.  ``tie_break`` columns (default ``id``) order rows equal on
    ``created_at``, all descending.  The page is cut from the newest payouts first when
    the joins drop none of them (``functions.filters.page_joined``).  ``last_seen``, the
    created_at and tie-break values of the row before the page, pages by key instead.
    """
    pp = where(payouts, eq_if("status", status))
    p = partners.select(F.col("id").alias("_pid"), F.col("user_id").alias("_puser"),
                        F.col("slug").alias("partner_slug"))
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("partner_email"))

    def joiner(left: DataFrame) -> DataFrame:
        return (left.join(p, left["partner_id"] == p["_pid"], "inner")
                .join(u, F.col("_puser") == u["_uid"], "inner")
                .drop("_pid", "_puser", "_uid"))

    if last_seen is not None:
        key = [(c, False) for c in ("created_at", *(tie_break or ["id"]))]
        return page_after(joiner(pp.where(after(key, last_seen))), key, None, limit)
    ties = [F.col(c).desc() for c in (tie_break or ["id"])]
    return page_joined(pp, joiner, [F.col("created_at").desc(), *ties], page_no, limit)


def product_class(product: F.Column) -> F.Column:
    """First of essential/extra/deluxe contained in the lower-cased name, else other."""
    low = F.lower(product)
    out = None
    for name in PRODUCT_CLASSES:
        cond = low.contains(name)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(PRODUCT_CLASS_OTHER))


def partner_purchases(orders: DataFrame, users: DataFrame, partners: DataFrame,
                      rate=PARTNER_COMMISSION_RATE) -> DataFrame:
    """Item 16. Orders attributed to an existing partner, with buyer e-mail and derivations.

    ``commission`` = amount x 20 % rounded half-up to cents (every status, as on the
    page); ``product_class`` by substring; ``source`` = promo code, else buyer e-mail
    (empty strings count as missing), else a dash.
    """
    o = orders.where(F.col("referral_partner_id").isNotNull())
    known = partners.select(F.col("id").alias("_pid"))
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("buyer_email"))
    rows = (o.join(known, o["referral_partner_id"] == known["_pid"], "left_semi")
            .join(u, o["user_id"] == u["_uid"], "inner"))
    return rows.select(
        F.col("referral_partner_id").alias("partner_id"), "id", "product", "amount",
        "promo_code", "status", "created_at", "paid_at", "buyer_email",
        money(F.col("amount") * F.lit(rate)).alias("commission"),
        product_class(F.col("product")).alias("product_class"),
        F.coalesce(F.nullif(F.col("promo_code"), F.lit("")),
                   F.nullif(F.col("buyer_email"), F.lit("")),
                   F.lit(SOURCE_MISSING)).alias("source"))


def partner_referrals(referrals: DataFrame, users: DataFrame, partners: DataFrame) -> DataFrame:
    """Item 17. Sign-ups per existing partner with the referred user, plus per-partner total.

    The total is a grouped count joined back on partner id (partial aggregation, no
    window), so one partner with most of the rows does not land in a single task.
    """
    known = partners.select(F.col("id").alias("_pid"))
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("referred_email"),
                     F.col("name").alias("referred_name"))
    r = referrals.join(known, referrals["partner_id"] == known["_pid"], "left_semi")
    rows = r.join(u, r["referred_user_id"] == u["_uid"], "inner").drop("_uid")
    totals = rows.groupBy(F.col("partner_id").alias("_tp")).agg(F.count(F.lit(1)).alias("total"))
    extra = ["promo_code"] if "promo_code" in referrals.columns else []
    return (rows.join(totals, rows["partner_id"] == totals["_tp"], "inner")
            .select("partner_id", "id", *extra, "created_at", "referred_user_id",
                    "referred_email", "referred_name", "total"))


def partner_payout_history(payouts: DataFrame, partners: DataFrame) -> DataFrame:
    """Item 18. Every payout of an existing partner with that partner's current balance."""
    p = partners.select(F.col("id").alias("_pid"), F.col("balance").alias("partner_balance"))
    return payouts.join(p, payouts["partner_id"] == p["_pid"], "inner").drop("_pid")


def partner_stats(partners: DataFrame, referrals: DataFrame, orders: DataFrame,
                  as_of) -> DataFrame:
    """Item 19. Per partner: balance, earnings and six counters (total / last 30 days).

    Three grouped aggregates (referrals by partner, paid orders by partner, orders by
    promo code) replace the original's six counting queries; each is combined map-side
    before its shuffle and only the per-key results are joined to the partners.
    "Last 30 days" is ``>= as_of - 30 days`` here.
    """
    ref = referrals.groupBy(F.col("partner_id").alias("_r")).agg(
        F.count(F.lit(1)).alias("referrals_total"),
        F.count_if(since("created_at", as_of, 30)).alias("referrals_30d"))
    paid = (orders.where((F.col("status") == "paid") & F.col("referral_partner_id").isNotNull())
            .groupBy(F.col("referral_partner_id").alias("_o"))
            .agg(F.count(F.lit(1)).alias("purchases_total"),
                 F.count_if(since("paid_at", as_of, 30)).alias("purchases_30d")))
    promo = (orders.where(F.col("promo_code").isNotNull())
             .groupBy(F.col("promo_code").alias("_c"))
             .agg(F.count(F.lit(1)).alias("promo_total"),
                  F.count_if(since("created_at", as_of, 30)).alias("promo_30d")))
    j = (partners.join(ref, partners["id"] == ref["_r"], "left")
         .join(paid, partners["id"] == paid["_o"], "left")
         .join(promo, partners["promo_code"] == promo["_c"], "left"))
    zero = F.lit(0).cast("long")
    return j.select(
        F.col("id").alias("partner_id"), "balance", "total_earned",
        *[F.coalesce(F.col(c), zero).alias(c) for c in
          ("referrals_total", "referrals_30d", "purchases_total", "purchases_30d",
           "promo_total", "promo_30d")])


def partner_revenue_series(orders: DataFrame, partners: DataFrame, period: str | None,
                           as_of) -> DataFrame:
    """Item 20. Paid revenue and sales per partner and time bucket.

    day -> hourly over the last day; week -> daily over 7 days; month (default) -> daily
    over 30 days; anything else -> monthly over all paid orders with a ``paid_at``.
    """
    unit, back = REVENUE_PERIODS.get(period or "month", REVENUE_PERIOD_OTHER)
    cond = (F.col("status") == "paid") & F.col("referral_partner_id").isNotNull()
    cond = cond & (since("paid_at", as_of, back) if back else F.col("paid_at").isNotNull())
    # Aggregate first (partial per task), then keep buckets of existing partners.
    series = (orders.where(cond)
              .groupBy(F.col("referral_partner_id").alias("partner_id"),
                       F.date_trunc(unit, F.col("paid_at")).alias("period"))
              .agg(F.coalesce(money_sum(F.col("amount")), F.lit(0).cast("decimal(18,2)"))
                   .alias("revenue"),
                   F.count(F.lit(1)).cast("int").alias("sales")))
    known = partners.select(F.col("id").alias("_pid"))
    return series.join(known, series["partner_id"] == known["_pid"], "left_semi")
