"""Promo codes: usage report (item 11), code resolution (item 25), code load (item 43)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import ts_lit
from ..functions.keys import flag_first, latest_per_key
from ..functions.money import money_sum
from ..functions.text import trimmed


def code_status(is_active: F.Column, expires_at: F.Column, as_of) -> F.Column:
    """disabled > expired (``expires_at < as_of``) > active."""
    return (F.when(~is_active, F.lit("disabled"))
            .when(expires_at.isNotNull() & (expires_at < ts_lit(as_of)), F.lit("expired"))
            .otherwise(F.lit("active")))


def promo_code_usage(promo_codes: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    """Item 11. Every promo code with uses (orders of any status), paid revenue, status.

    Orders are aggregated per code first (map-side combine, so a code used by a third of
    all orders is pre-summed in every task before the shuffle); the per-code result is
    then left-joined to the codes.
    """
    used = (orders.where(F.col("promo_code").isNotNull())
            .groupBy(F.col("promo_code").alias("_code"))
            .agg(F.count(F.col("id")).alias("use_count"),
                 money_sum(F.when(F.col("status") == "paid", F.col("amount"))).alias("_rev")))
    return (promo_codes.join(used, promo_codes["code"] == used["_code"], "left")
            .select(*[promo_codes[c] for c in promo_codes.columns],
                    F.coalesce(F.col("use_count"), F.lit(0).cast("long")).alias("use_count"),
                    F.coalesce(F.col("_rev"), F.lit(0).cast("decimal(18,2)")).alias("revenue"),
                    code_status(F.col("is_active"), F.col("expires_at"), as_of).alias("code_status")))


def promo_resolution(requests: DataFrame, promo_codes: DataFrame, partners: DataFrame,
                     users: DataFrame, as_of) -> DataFrame:
    """Item 25. Resolve typed codes: (request_id, code) -> outcome and discount.

    The code is trimmed and upper-cased; an empty one is ``missing``.  A discount code
    matches on ``upper(code)`` (lowest id if several do): ``inactive``, then ``expired``
    (``expires_at < as_of``), else ``discount`` with its percentage.  Otherwise a
    partner promo code whose partner has a user gives ``partner`` with 0 %.  Else
    ``not_found``.

    The distinct codes are resolved (a hot code is one row after map-side combine), and the
    answers joined back.  An empty code joins on a key of the request's own that matches nothing.
    """
    req = requests.withColumn("code", F.upper(trimmed(F.coalesce(F.col("code"), F.lit("")))))
    asked = req.where(F.col("code") != "").select(F.col("code").alias("_code")).distinct()
    disc = (latest_per_key(promo_codes.withColumn("_k", F.upper(F.col("code"))), ["_k"],
                           [F.col("id").asc()])
            .select("_k", "discount_percent", "is_active", "expires_at"))
    part = (partners.join(users.select(F.col("id").alias("_uid")),
                          partners["user_id"] == F.col("_uid"), "left_semi")
            .select(F.col("promo_code").alias("_pk")).distinct())
    answers = asked.join(disc, F.col("_code") == F.col("_k"), "left").join(part, F.col("_code") == F.col("_pk"), "left")
    own = F.when(F.col("code") != "", F.col("code")).otherwise(F.concat(F.lit("\0"), F.col("request_id").cast("string")))
    j = req.withColumn("_own", own).join(answers, F.col("_own") == F.col("_code"), "left")
    outcome = (F.when(F.col("code") == "", F.lit("missing"))
               .when(F.col("_k").isNotNull() & ~F.col("is_active"), F.lit("inactive"))
               .when(F.col("_k").isNotNull() & F.col("expires_at").isNotNull()
                     & (F.col("expires_at") < ts_lit(as_of)), F.lit("expired"))
               .when(F.col("_k").isNotNull(), F.lit("discount"))
               .when(F.col("_pk").isNotNull(), F.lit("partner"))
               .otherwise(F.lit("not_found")))
    return j.select("request_id", "code", outcome.alias("outcome"),
                    F.when(outcome == "discount", F.col("discount_percent"))
                    .when(outcome == "partner", F.lit(0)).alias("discount"))


def promo_code_load(batch: DataFrame, promo_codes: DataFrame, as_of=None) -> DataFrame:
    """Item 43. Admit new promo codes: (request_id, code, discount, expires_at, ts).

    code = trim + upper, required; discount = integer part of the input, where missing,
    unparsable or 0 becomes the default 10; it must lie in 1..100; a code that already
    exists, or an earlier request in the batch (by ts, request_id) with the same code,
    is a ``duplicate``.  Returns every request with its normalised values and ``reason``
    (NULL when admitted).
    """
    from ..constants import PROMO_DEFAULT_DISCOUNT, PROMO_DISCOUNT_RANGE
    lo, hi = PROMO_DISCOUNT_RANGE
    parsed = F.regexp_extract(trimmed(F.col("discount").cast("string")), r"^([+-]?\d+)", 1)
    # Any number of digits parses (as decimal, no overflow error under ANSI); values that
    # do not fit an integer are simply out of range.
    num = F.when(parsed == "", F.lit(None)).otherwise(parsed.try_cast("decimal(38,0)"))
    b = (batch.withColumn("code", F.upper(trimmed(F.coalesce(F.col("code"), F.lit("")))))
         .withColumn("_num", F.coalesce(F.nullif(num, F.lit(0)), F.lit(PROMO_DEFAULT_DISCOUNT)))
         .withColumn("discount", F.col("_num").try_cast("int")))
    valid_code = F.col("code") != ""
    in_range = (F.col("_num") >= lo) & (F.col("_num") <= hi)
    # First arrival per code among requests that pass the static checks.
    b = flag_first(b, ["code"], ["ts", "request_id"], "_first", when=valid_code & in_range)
    existing = promo_codes.select(F.col("code").alias("_ex")).distinct()
    j = b.join(existing, b["code"] == existing["_ex"], "left")
    reason = (F.when(~valid_code, F.lit("code_required"))
              .when(~in_range, F.lit("discount_range"))
              .when(F.col("_ex").isNotNull() | ~F.col("_first"), F.lit("duplicate")))
    return j.select("request_id", "code", "discount", "expires_at", reason.alias("reason"))
