"""Domain tables as parquet: explicit schemas, reader and writer.

A deployment exports its tables (for example with the built-in ``spark.read.jdbc``) to
parquet once; the operators then run on these files.  Reading with the declared schema
means no footer inference, and a plan that uses two columns reads two columns
(``ReadSchema``) with its predicates pushed into the scan (``PushedFilters``).

Job outputs (new table states) are written to a new folder per version and published
together (``sources.versions``): readers see either all tables of a job or none of them, and
a failed job never leaves a half-written table behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .versions import has_versions, publish_on, read_version, snapshot

L, I, S, B, TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()
MONEY, RATE = T.DecimalType(12, 2), T.DecimalType(5, 4)


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Columns and types of the original schema (fixed values); password hashes are left out.
DOMAIN_SCHEMAS: dict[str, T.StructType] = {
    "users": _s(("id", L, False), ("email", S, False), ("name", S, True), ("role", S, False),
                ("email_verified", B, False), ("created_at", TS, False), ("updated_at", TS, True)),
    "otp_codes": _s(("id", L, False), ("email", S, False), ("code", S, False), ("purpose", S, False),
                    ("expires_at", TS, False), ("used", B, False), ("created_at", TS, False)),
    "refresh_tokens": _s(("id", L, False), ("user_id", L, True), ("token_hash", S, False),
                         ("expires_at", TS, False), ("created_at", TS, False)),
    "subscriptions": _s(("user_id", L, True), ("plan", S, True), ("status", S, True),
                        ("expires_at", TS, True)),
    "lessons": _s(("id", I, False), ("title", S, False), ("sort_order", I, False),
                  ("is_free", B, False), ("created_at", TS, True)),
    "lesson_topics": _s(("id", L, False), ("lesson_id", I, True), ("text", S, False),
                        ("sort_order", I, False), ("created_at", TS, True)),
    "lesson_videos": _s(("id", L, False), ("lesson_id", I, True), ("title", S, False),
                        ("description", S, True), ("video_url", S, True), ("preview_url", S, True),
                        ("is_main", B, False), ("sort_order", I, False), ("created_at", TS, True)),
    "course_progress": _s(("user_id", L, True), ("lesson_id", I, True), ("viewed", B, False),
                          ("completed", B, False), ("viewed_at", TS, True),
                          ("completed_at", TS, True)),
    "partner_applications": _s(
        ("id", L, False), ("user_id", L, True), ("name", S, True), ("email", S, True),
        ("telegram", S, True), ("cooperation_type", S, True), ("audience", S, True),
        ("about", S, True), ("experience", S, True), ("social_links", S, True),
        ("traffic_source", S, True), ("motivation", S, True), ("comment", S, True),
        ("slug", S, True), ("status", S, False), ("reject_reason", S, True),
        ("created_at", TS, False), ("reviewed_at", TS, True), ("reviewed_by", L, True)),
    "partners": _s(("id", L, False), ("user_id", L, True), ("slug", S, False),
                   ("promo_code", S, False), ("balance", MONEY, False),
                   ("total_earned", MONEY, False), ("created_at", TS, True)),
    "referrals": _s(("id", L, False), ("partner_id", L, True), ("referred_user_id", L, True),
                    ("promo_code", S, True), ("created_at", TS, False)),
    "orders": _s(("id", L, False), ("user_id", L, True), ("product", S, True),
                 ("amount", MONEY, False), ("referral_partner_id", L, True),
                 ("promo_code", S, True), ("payment_id", S, True), ("status", S, False),
                 ("created_at", TS, False), ("paid_at", TS, True)),
    "partner_payouts": _s(("id", L, False), ("partner_id", L, True), ("amount", MONEY, False),
                          ("method", S, False), ("requisites", S, False),
                          ("commission_rate", RATE, False), ("commission_amount", MONEY, False),
                          ("amount_to_receive", MONEY, False), ("status", S, False),
                          ("reject_reason", S, True), ("created_at", TS, False),
                          ("processed_at", TS, True)),
    "promo_codes": _s(("id", I, False), ("code", S, False), ("discount_percent", I, False),
                      ("expires_at", TS, True), ("is_active", B, False), ("created_at", TS, True)),
    "materials": _s(("id", L, False), ("category", S, False), ("title", S, False),
                    ("description", S, True), ("preview_url", S, True), ("download_url", S, True),
                    ("sort_order", I, False), ("created_at", TS, True)),
}


def current_versions(spark: SparkSession, base: str) -> dict[str, str]:
    """The published version of each table; one entry per table, so small by nature."""
    return snapshot(spark, base).versions


def publish(spark: SparkSession, base: str, versions: dict[str, str]) -> None:
    """Make ``versions`` (table name -> version) the current ones, all at once.

    To be called after the versions are written, by a job that read no published table; one
    that did publishes with ``versions.publish_on``, which notices other writers.  Earlier
    versions stay readable by name.
    """
    publish_on(spark, base, snapshot(spark, base), versions)


def read_domain(spark: SparkSession, base: str, name: str, version: str | None = None) -> DataFrame:
    """One state of a table, read with the declared schema: the ``version`` asked for, else
    the published one, else (a plain export without versions) ``{base}/{name}`` itself.

    Written but unpublished versions are never read by default; a table that has only such
    versions raises ``FileNotFoundError``.
    """
    version = version or current_versions(spark, base).get(name)
    if version is not None:
        return read_version(spark, base, name, version, DOMAIN_SCHEMAS[name])
    path = f"{base.rstrip('/')}/{name}"
    if has_versions(spark, base, name):
        raise FileNotFoundError(f"{path} has versions, none of them published")
    return spark.read.schema(DOMAIN_SCHEMAS[name]).parquet(path)


def read_domain_tables(spark: SparkSession, base: str, names=None) -> dict[str, DataFrame]:
    """``read_domain`` of several tables, all as of one publication."""
    now = current_versions(spark, base)
    return {n: read_domain(spark, base, n, now.get(n)) for n in (names or DOMAIN_SCHEMAS)}


def write_version(df: DataFrame, base: str, name: str, version: str,
                  partition_by: list[str] | None = None) -> str:
    """Write a new table state to ``{base}/{name}/v={version}`` and return the path.

    The folder belongs to this version only, so the write never touches the state being
    read; ``publish`` switches readers to it after the job commits.  A retried job overwrites
    whatever a failed attempt left in its own folder.  ``partition_by`` (e.g. a month
    column for orders) lets later date filters prune whole folders.
    """
    path = f"{base.rstrip('/')}/{name}/v={version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
