"""Payout jobs: admission of payout requests against the running balance (29) and batched
status updates with guarded refunds (30)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PAYOUT_COMMISSION, PAYOUT_MIN_AMOUNT, PAYOUT_UPDATE_STATUSES
from ..functions.budget import admit
from ..functions.filters import ts_lit
from ..functions.money import money
from ..functions.text import trimmed

RATE = "decimal(5,4)"


def commission_rate(method: F.Column, rates: dict | None = None) -> F.Column:
    out = None
    for name, rate in (rates or PAYOUT_COMMISSION).items():
        cond = method == F.lit(name)
        val = F.lit(Decimal(rate)).cast(RATE)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def payout_checks(requests: DataFrame, partners: DataFrame, rates: dict | None = None,
                  min_amount=PAYOUT_MIN_AMOUNT) -> DataFrame:
    """Item 29 (stateless part). Static checks in the original order and commission.

    Adds ``static_reason`` (partner_not_found, min_amount, bad_method, no_requisites or
    NULL), ``start_balance``, ``commission_rate``, ``commission_amount`` (half-up to
    cents) and ``amount_to_receive``.
    """
    rates = rates or PAYOUT_COMMISSION
    p = partners.select(F.col("id").alias("_pid"), F.col("balance").alias("start_balance"))
    r = requests.join(p, requests["partner_id"] == p["_pid"], "left")
    reason = (F.when(F.col("_pid").isNull(), F.lit("partner_not_found"))
              .when(F.col("amount").isNull() | (F.col("amount") < F.lit(Decimal(min_amount))),
                    F.lit("min_amount"))
              .when(~F.coalesce(F.col("method").isin(*rates), F.lit(False)), F.lit("bad_method"))
              .when(F.coalesce(trimmed(F.col("requisites")), F.lit("")) == "",
                    F.lit("no_requisites")))
    rate = commission_rate(F.col("method"), rates)
    fee = money(F.col("amount") * rate)
    return (r.withColumn("static_reason", reason).drop("_pid")
            .withColumn("commission_rate", rate)
            .withColumn("commission_amount", fee)
            .withColumn("amount_to_receive", (F.col("amount") - fee).cast("decimal(12,2)")))


def payout_admission(requests: DataFrame, partners: DataFrame, order: list[str],
                     rates: dict | None = None, min_amount=PAYOUT_MIN_AMOUNT,
                     partitions: int | None = None) -> DataFrame:
    """Item 29. Admit payout requests per partner, in ``order``, against the balance.

    A request that passes the static checks is admitted when its amount is at most the
    partner's balance left by the requests admitted before it; an admitted request
    lowers the balance, a rejected one (``insufficient_balance``) does not.  Returns every
    request with ``reason`` (NULL when admitted), the commission fields and, for
    admitted rows, ``balance_after``.

    Plan: requests that fail a check, or exceed even the starting balance, are decided
    without ordering.  The others are laid out once by (partner, order) and judged in a
    stream; a partner whose requests cross partitions is carried over by run summaries
    (``functions.budget``), in at most log2(balance / min_amount) + 1 small jobs.
    """
    checked = payout_checks(requests, partners, rates, min_amount)
    is_cand = F.coalesce(F.col("static_reason").isNull() & (F.col("amount") <= F.col("start_balance")), F.lit(False))
    fees = ["commission_rate", "commission_amount", "amount_to_receive"]
    decided = checked.where(~is_cand).select(
        *requests.columns,
        F.coalesce(F.col("static_reason"), F.lit("insufficient_balance")).alias("reason"),
        *fees, F.lit(None).cast("decimal(12,2)").alias("balance_after"))
    cents = {"_cents": (F.col("amount") * 100).cast("long"), "_from": (F.col("start_balance") * 100).cast("long")}
    judged = admit(checked.where(is_cand).select(*requests.columns, *fees, "start_balance").withColumns(cents).drop("start_balance"),
                   "partner_id", order, "_cents", "_from", partitions)
    return decided.unionByName(judged.select(
        *requests.columns,
        F.when(F.col("_left").isNull(), F.lit("insufficient_balance")).alias("reason"), *fees,
        (F.col("_left") / F.lit(Decimal(100))).cast("decimal(12,2)").alias("balance_after")))


def payout_status_batch(updates: DataFrame, payouts: DataFrame, partners: DataFrame, as_of,
                        key: list[str], allowed=PAYOUT_UPDATE_STATUSES):
    """Item 30. Apply payout status updates; returns (payouts, partners, rejects).

    ``updates``: key columns + status, reject_reason, ts.  Updates with a status outside
    processing/paid/rejected are rejected (``bad_status``), as are updates of unknown
    payouts (``not_found``).  The valid updates of a payout apply in order (ts, status): the
    last one gives status and ``reject_reason`` (empty becomes NULL); ``processed_at`` is
    ``as_of`` if any of them is paid or rejected, and kept otherwise; each step into
    'rejected' from another status refunds the amount to the partner's balance.
    """
    # Updates of unknown payouts meet no row in the join below, so only the rejects look keys up.
    u = updates.withColumn("_valid", F.coalesce(F.col("status").isin(*allowed), F.lit(False)))
    known = payouts.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    on = None
    for k in key:
        c = u[k] == known[f"_k_{k}"]
        on = c if on is None else on & c
    found = F.col(f"_k_{key[0]}").isNotNull()
    rejects = u.join(known, on, "left").where(~F.col("_valid") | ~found).select(
        *updates.columns, F.when(~F.col("_valid"), F.lit("bad_status"))
        .otherwise(F.lit("not_found")).alias("reason"))
    ok = u.where("_valid")
    ok = ok.withColumn("_prev", F.lag("status").over(Window.partitionBy(*key).orderBy("ts", "status")))
    place = F.struct("ts", "status")
    last = ok.groupBy(*key).agg(
        F.max_by("status", place).alias("_new"),
        F.max_by(F.struct(F.nullif(F.col("reject_reason"), F.lit("")).alias("t")), place).alias("_w"),
        F.min_by("status", place).alias("_one"),
        F.bool_or(F.col("status").isin("paid", "rejected")).alias("_stamped"),
        F.count_if((F.col("status") == "rejected") & (F.col("_prev") != "rejected")).alias("_later"))
    last = last.select(*[F.col(k).alias(f"_u_{k}") for k in key], "_new", F.col("_w.t").alias("_why"),
                       "_one", "_stamped", "_later")
    on = None
    for k in key:
        c = payouts[k] == last[f"_u_{k}"]
        on = c if on is None else on & c
    j = payouts.join(last, on, "left")
    hit = F.col("_new").isNotNull()
    if "processed_at" not in payouts.columns:
        j = j.withColumn("processed_at", F.lit(None).cast("timestamp"))
    if "reject_reason" not in payouts.columns:
        j = j.withColumn("reject_reason", F.lit(None).cast("string"))
    stamped = F.when(hit & F.col("_stamped"), ts_lit(as_of)).otherwise(F.col("processed_at"))
    entered = F.when((F.col("_one") == "rejected") & (F.col("status") != "rejected"), 1).otherwise(0) + F.col("_later")
    refund = F.when(hit & (entered > 0), (F.col("amount") * entered.cast("int")).cast(payouts.schema["amount"].dataType))
    j = j.withColumn("_refund", refund)
    cols = [c for c in payouts.columns if c not in ("status", "processed_at", "reject_reason")]
    new_payouts = j.select(*cols, F.when(hit, F.col("_new")).otherwise(F.col("status")).alias("status"),
                           F.when(hit, F.col("_why")).otherwise(F.col("reject_reason")).alias("reject_reason"),
                           stamped.alias("processed_at"))
    refunds = j.where(F.col("_refund").isNotNull()).groupBy(F.col("partner_id").alias("_rp")) \
        .agg(F.sum("_refund").alias("_add"))
    new_partners = (partners.join(refunds, partners["id"] == refunds["_rp"], "left")
                    .withColumn("balance", (F.col("balance") + F.coalesce(F.col("_add"), F.lit(0)))
                                .cast("decimal(12,2)"))
                    .drop("_rp", "_add"))
    return new_payouts, new_partners, rejects
