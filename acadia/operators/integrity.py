"""Integrity report over the domain tables (item 44): UNIQUE, NOT NULL, FK, length, enums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (APPLICATION_STATUSES, CHANGE_EMAIL_PREFIX, MATERIAL_CATEGORIES, ORDER_STATUSES,
                         OTP_PURPOSES, PAYOUT_STATUSES, USER_ROLES)

# Declared constraints of the original schema (fixed values).
UNIQUE_KEYS = [
    ("users", ("email",)), ("refresh_tokens", ("token_hash",)),
    ("course_progress", ("user_id", "lesson_id")), ("partner_applications", ("slug",)),
    ("partners", ("user_id",)), ("partners", ("slug",)), ("partners", ("promo_code",)),
    ("promo_codes", ("code",)),
]
NOT_NULL = [(table, column) for table, columns in {
    "users": "email role email_verified created_at updated_at",
    "otp_codes": "email code purpose expires_at used created_at",
    "refresh_tokens": "token_hash expires_at created_at",
    "lessons": "title sort_order is_free created_at",
    "lesson_topics": "text sort_order created_at",
    "lesson_videos": "title is_main sort_order created_at",
    "course_progress": "viewed completed",
    "partner_applications": "status created_at",
    "partners": "slug promo_code balance total_earned created_at",
    "referrals": "created_at",
    "orders": "amount status created_at",
    "partner_payouts": "amount method requisites commission_rate commission_amount amount_to_receive status created_at",
    "promo_codes": "code discount_percent is_active created_at",
    "materials": "category title sort_order created_at",
}.items() for column in columns.split()]
FOREIGN_KEYS = [
    ("refresh_tokens", "user_id", "users", "id"), ("lesson_topics", "lesson_id", "lessons", "id"),
    ("lesson_videos", "lesson_id", "lessons", "id"), ("course_progress", "user_id", "users", "id"),
    ("course_progress", "lesson_id", "lessons", "id"),
    ("partner_applications", "user_id", "users", "id"),
    ("partner_applications", "reviewed_by", "users", "id"), ("partners", "user_id", "users", "id"),
    ("referrals", "partner_id", "partners", "id"), ("referrals", "referred_user_id", "users", "id"),
    ("orders", "user_id", "users", "id"), ("orders", "referral_partner_id", "partners", "id"),
    ("partner_payouts", "partner_id", "partners", "id"),
]
MAX_LENGTH = [
    ("users", "email", 255), ("users", "name", 255), ("users", "role", 50),
    ("otp_codes", "email", 255), ("otp_codes", "code", 6), ("otp_codes", "purpose", 50),
    ("refresh_tokens", "token_hash", 255), ("lessons", "title", 255),
    ("lesson_videos", "title", 255), ("lesson_videos", "video_url", 500),
    ("lesson_videos", "preview_url", 500), ("partner_applications", "name", 255),
    ("partner_applications", "email", 255), ("partner_applications", "telegram", 255),
    ("partner_applications", "cooperation_type", 50), ("referrals", "promo_code", 64),
    ("orders", "payment_id", 255), ("materials", "preview_url", 500), ("materials", "download_url", 500),
    ("partner_applications", "slug", 64), ("partner_applications", "status", 50),
    ("partners", "slug", 64), ("partners", "promo_code", 64), ("orders", "product", 255),
    ("orders", "promo_code", 64), ("orders", "status", 50), ("partner_payouts", "method", 50),
    ("partner_payouts", "status", 50), ("promo_codes", "code", 64),
    ("materials", "category", 64), ("materials", "title", 255),
]
ENUMS = [
    ("otp_codes", "purpose", OTP_PURPOSES),
    ("partner_applications", "cooperation_type", ("partner", "ambassador", "affiliate")),
    ("users", "role", USER_ROLES), ("partner_applications", "status", APPLICATION_STATUSES),
    ("orders", "status", ORDER_STATUSES), ("partner_payouts", "method", ("card", "usdt", "sbp")),
    ("partner_payouts", "status", PAYOUT_STATUSES), ("materials", "category", MATERIAL_CATEGORIES),
]


NAMES = ["check", "table_name", "column_name"]


def _constants(rows: list[tuple], names: list[str]) -> Column:
    """``rows`` of plain values as an array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])


def _stacked(df: DataFrame, rows: list[tuple], names: list[str], keep: str) -> DataFrame:
    """One output row per input row and element of ``rows`` (tuples of columns), where ``keep`` holds."""
    each = F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]))
    return df.select(each.alias("_r")).select("_r.*").where(keep)


def _row_checks(tables: dict[str, DataFrame], checks: dict[str, list]) -> list[DataFrame]:
    """NOT NULL, LENGTH and ENUM: one aggregate of counts per table, unpivoted."""
    parts = []
    for t, conditions in checks.items():
        counts = tables[t].agg(*[F.count_if(cond).alias(f"_c{i}") for i, (_, _, cond) in enumerate(conditions)])
        args = ", ".join(f"'{kind}', '{col}', _c{i}" for i, (kind, col, _) in enumerate(conditions))
        parts.append(counts.selectExpr(f"stack({len(conditions)}, {args}) AS (check, column_name, violations)")
                     .select("check", F.lit(t).alias("table_name"), "column_name", "violations"))
    return parts


def _key_checks(spark, tables: dict[str, DataFrame], checks: list[tuple]) -> DataFrame:
    """UNIQUE and FK: ``checks`` holds (check id, table, columns, parent table or '').

    One scan per child table gives a row per check and non-NULL key; one grouped count over
    all of them, combined map-side, reduces a key to one row per check, however many rows
    hold it; one left join tells which references exist.
    """
    keys = []
    for t in dict.fromkeys(c[1] for c in checks):
        rows = []
        for check, table, cols, parent in checks:
            if table == t:
                key = F.col(cols[0]).cast("string") if len(cols) == 1 else F.when(
                    reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]), F.to_json(F.struct(*cols)))
                rows.append((F.lit(check), F.lit(parent), key))
        keys.append(_stacked(tables[t], rows, ["check_id", "parent", "key"], "key IS NOT NULL"))
    counted = reduce(DataFrame.unionAll, keys).groupBy("check_id", "parent", "key").agg(F.count(F.lit(1)).alias("n"))
    # A check without any key still gets its row.
    empty = spark.range(0, 1, 1, 1).select(F.inline(_constants(
        [(c[0], c[3], "", 0) for c in checks], ["check_id", "parent", "key", "n"])))
    parents = [tables[p].select(F.lit(p).alias("_p"), F.col("id").cast("string").alias("_id"))
               for p in dict.fromkeys(c[3] for c in checks if c[3])]
    counted = counted.unionByName(empty)
    if parents:
        known = reduce(DataFrame.unionAll, parents).where("_id IS NOT NULL")
        counted = counted.join(known, (F.col("parent") == F.col("_p")) & (F.col("key") == F.col("_id")), "left")
    else:
        counted = counted.withColumn("_p", F.lit(None).cast("string"))
    # A reference that exists is no violation, so a parent id that occurs twice does no harm.
    bad = (F.when(F.col("parent") == "", F.greatest(F.col("n") - 1, F.lit(0)))
           .when(F.col("_p").isNull(), F.col("n")).otherwise(F.lit(0)))
    return counted.groupBy("check_id").agg(F.sum(bad).cast("long").alias("violations"))


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Item 44. One row per declared check: (check, table_name, column_name, violations).

    UNIQUE counts rows beyond the first per duplicated key (a key with a NULL never
    conflicts); FK counts non-NULL references without a parent; NOT NULL counts NULLs in
    the declared columns (generated keys apart); LENGTH counts values longer than the
    declared VARCHAR; ENUM counts non-NULL values outside the commented domain (a code's
    purpose may also be ``change_email:<address>``).  ``violations`` is NULL for a check
    whose table or column is absent.  A table is read once for its row checks and once for
    its keys; see ``_key_checks`` for hot keys.
    """
    spark = next(iter(tables.values())).sparkSession
    absent: list[tuple] = []
    local: dict[str, list] = {}
    keyed: list[tuple] = []
    labels: list[tuple] = []

    def has(t, *cols):
        return t in tables and all(c in tables[t].columns for c in cols)

    def key_check(kind, t, cols, label, parent=""):
        if has(t, *cols) and (not parent or has(parent, "id")):
            keyed.append((len(keyed), t, cols, parent))
            labels.append((kind, t, label))
        else:
            absent.append((kind, t, label))

    def row_check(kind, t, c, violated):
        if has(t, c):
            local.setdefault(t, []).append((kind, c, violated))
        else:
            absent.append((kind, t, c))

    for t, cols in UNIQUE_KEYS:
        key_check("unique", t, cols, ",".join(cols))
    for t, c, pt, pc in FOREIGN_KEYS:
        key_check("foreign_key", t, (c,), f"{c}->{pt}.{pc}", pt)
    for t, c in NOT_NULL:
        row_check("not_null", t, c, F.col(c).isNull())
    for t, c, n_max in MAX_LENGTH:
        row_check("length", t, c, F.length(F.col(c)) > n_max)
    for t, c, domain in ENUMS:
        odd = F.col(c).isNotNull() & ~F.col(c).isin(*domain)
        if c == "purpose":
            odd = odd & ~F.col(c).startswith(CHANGE_EMAIL_PREFIX)
        row_check("enum", t, c, odd)

    parts = _row_checks(tables, local)
    if keyed:
        label = F.get(_constants(labels, NAMES), F.col("check_id"))
        parts.append(_key_checks(spark, tables, keyed).select(label.alias("_l"), "violations")
                     .select("_l.*", "violations"))
    if absent:
        parts.append(spark.range(0, 1, 1, 1).select(F.inline(_constants(absent, NAMES)))
                     .withColumn("violations", F.lit(None).cast("long")))
    return reduce(DataFrame.unionByName, parts)
