"""Partner applications: slug availability (26), admission of new applications (27),
partner provisioning from role changes and approvals (28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (COOPERATION_TYPE_DEFAULT, GENERATED_SLUG_FALLBACK, GENERATED_SLUG_MAX,
                         SLUG_PATTERN)
from ..functions.keys import flag_first, latest_per_key
from ..functions.text import trimmed

OPTIONAL_TEXT = ("telegram", "audience", "about", "experience", "social_links",
                 "traffic_source", "motivation", "comment")


def taken_slugs(applications: DataFrame, partners: DataFrame) -> DataFrame:
    """Distinct slugs held by an application or a partner (UNION, not UNION ALL)."""
    return (applications.select(F.col("slug").alias("taken_slug"))
            .union(partners.select(F.col("slug").alias("taken_slug")))
            .where(F.col("taken_slug").isNotNull()).distinct())


def slug_availability(requests: DataFrame, applications: DataFrame,
                      partners: DataFrame) -> DataFrame:
    """Item 26. (request_id, slug) -> normalised slug, ``valid``, ``available``.

    The slug is lower-cased and trimmed; it must match ``^[a-z0-9-]{3,32}$``; it is
    available when valid and held by no application and no partner.
    """
    r = requests.withColumn("slug", trimmed(F.lower(F.coalesce(F.col("slug"), F.lit("")))))
    taken = taken_slugs(applications, partners)
    j = r.join(taken, r["slug"] == taken["taken_slug"], "left")
    valid = F.col("slug").rlike(SLUG_PATTERN)
    return j.select("request_id", "slug", valid.alias("valid"),
                    (valid & F.col("taken_slug").isNull()).alias("available"))


def _blank_to_null(c: F.Column) -> F.Column:
    return F.nullif(trimmed(c), F.lit(""))


def application_admission(batch: DataFrame, applications: DataFrame,
                          partners: DataFrame) -> DataFrame:
    """Item 27. Admit a batch of partner applications.

    Batch columns: request_id, ts, user_id, name, email, slug and optional texts.
    Checks, first failure is the reason: ``required`` (name, email or slug missing or
    empty), ``invalid_slug`` (after lower+trim), ``slug_taken`` (held by an application
    or partner), ``pending_exists`` (the newest application with this e-mail is
    pending).  In the batch, the first arrival (ts, request_id) per slug wins among rows
    passing the earlier checks (later ones are ``slug_taken``); then per e-mail among
    the survivors (later ones are ``pending_exists``, since the earlier one is now a
    pending application).  Admitted rows carry the values that would be stored: name
    and e-mail trimmed (e-mail lower-cased), blank optional text as NULL,
    cooperation_type defaulting to 'partner', status 'pending'.
    """
    present = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    b = (batch
         .withColumn("_required", present("name") & present("email") & present("slug"))
         .withColumn("slug", trimmed(F.lower(F.col("slug"))))
         .withColumn("email", F.lower(trimmed(F.col("email"))))
         .withColumn("name", trimmed(F.col("name"))))
    for c in OPTIONAL_TEXT:
        if c in b.columns:
            b = b.withColumn(c, _blank_to_null(F.col(c)))
    ctype = (F.coalesce(F.nullif(F.col("cooperation_type"), F.lit("")),
                        F.lit(COOPERATION_TYPE_DEFAULT))
             if "cooperation_type" in b.columns else F.lit(COOPERATION_TYPE_DEFAULT))
    b = b.withColumn("cooperation_type", ctype)

    taken = taken_slugs(applications, partners)
    last = latest_per_key(applications.where(F.col("email").isNotNull()), ["email"],
                          [F.col("created_at").desc(), F.col("id").desc()]) \
        .select(F.col("email").alias("_le"), (F.col("status") == "pending").alias("_pending"))
    b = (b.join(taken, b["slug"] == taken["taken_slug"], "left")
         .join(last, b["email"] == last["_le"], "left"))
    valid = F.coalesce(F.col("slug").rlike(SLUG_PATTERN), F.lit(False))
    static_ok = F.col("_required") & valid & F.col("taken_slug").isNull()
    b = flag_first(b, ["slug"], ["ts", "request_id"], "_slug_first", when=static_ok)
    survivor = static_ok & F.col("_slug_first") & ~F.coalesce(F.col("_pending"), F.lit(False))
    b = flag_first(b, ["email"], ["ts", "request_id"], "_email_first", when=survivor)
    reason = (F.when(~F.col("_required"), F.lit("required"))
              .when(~valid, F.lit("invalid_slug"))
              .when(F.col("taken_slug").isNotNull() | ~F.col("_slug_first"), F.lit("slug_taken"))
              .when(F.coalesce(F.col("_pending"), F.lit(False)) | ~F.col("_email_first"),
                    F.lit("pending_exists")))
    keep = [c for c in batch.columns if c not in ("request_id", "ts")]
    return b.select("request_id", "ts", *keep,
                    *(["cooperation_type"] if "cooperation_type" not in keep else []),
                    F.when(reason.isNull(), F.lit("pending")).alias("status"),
                    reason.alias("reason"))


def base_slug(name: F.Column, email: F.Column) -> F.Column:
    """Slug from the name, else the e-mail local part: lower case, only [a-z0-9],
    at most 28 characters, 'partner' when nothing is left."""
    src = F.coalesce(F.nullif(name, F.lit("")), F.substring_index(email, "@", 1))
    cleaned = F.substring(F.regexp_replace(F.lower(src), "[^a-z0-9]", ""), 1, GENERATED_SLUG_MAX)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(GENERATED_SLUG_FALLBACK))


def partner_provisioning(promoted: DataFrame, users: DataFrame, partners: DataFrame,
                         applications: DataFrame) -> DataFrame:
    """Item 28 (role path). Partner rows for users whose role is set to 'partner'.

    ``promoted``: (user_id, ts).  Users that already have a partner row are skipped
    (``skipped``).  The slug is ``base_slug``; if the base is held by a partner or
    application - or by an earlier promoted user of the batch with the same base - the
    user id is appended.  Unlike the original, the final slug is checked as well: if it,
    or its promo code, is still held, the row is reported as ``slug_conflict`` and not created.
    promo_code = upper(slug).  Returns every promoted user with slug, promo_code and
    ``outcome`` (created / skipped / slug_conflict / unknown_user), one row per promoted
    user (a user promoted twice counts once, at the first ``ts``); two users reaching
    the same final slug: the first (ts, user_id) keeps it, the other is ``slug_conflict``.
    """
    u = users.select(F.col("id").alias("_uid"), "name", "email")
    # A user promoted twice in the batch gets one partner row (ON CONFLICT (user_id)):
    # one command per user, at its first arrival.
    once = promoted.groupBy("user_id").agg(F.min("ts").alias("ts"))
    p = once.join(u, once["user_id"] == u["_uid"], "left")
    existing = partners.select(F.col("user_id").alias("_puser")).distinct()
    p = p.join(existing, p["user_id"] == existing["_puser"], "left")
    p = p.withColumn("_first_user", F.col("_uid").isNotNull() & F.col("_puser").isNull())
    p = p.withColumn("_base", base_slug(F.col("name"), F.col("email")))
    taken = taken_slugs(applications, partners)
    p = p.join(taken.select(F.col("taken_slug").alias("_tb")),
               F.col("_base") == F.col("_tb"), "left")
    eligible = F.col("_first_user")
    p = flag_first(p, ["_base"], ["ts", "user_id"], "_first_base", when=eligible)
    slug = F.when(F.col("_tb").isNull() & F.col("_first_base"), F.col("_base")) \
        .otherwise(F.concat(F.col("_base"), F.col("user_id").cast("string")))
    p = p.withColumn("slug", F.when(eligible, slug))
    p = p.join(taken.select(F.col("taken_slug").alias("_tf")),
               F.col("slug") == F.col("_tf"), "left")
    held = partners.select(F.col("promo_code").alias("_hc")).where("promo_code IS NOT NULL").distinct()
    p = p.join(held, F.upper(F.col("slug")) == F.col("_hc"), "left")
    p = p.withColumn("_tf", F.coalesce("_tf", "_hc")).drop("_hc")
    # Two promoted users can still arrive at the same final slug: the first keeps it.
    p = flag_first(p, ["slug"], ["ts", "user_id"], "_first_slug",
                   when=eligible & F.col("_tf").isNull())
    outcome = (F.when(F.col("_uid").isNull(), F.lit("unknown_user"))
               .when(F.col("_puser").isNotNull() | ~F.col("_first_user"), F.lit("skipped"))
               .when(F.col("_tf").isNotNull() | ~F.col("_first_slug"), F.lit("slug_conflict"))
               .otherwise(F.lit("created")))
    return p.select("user_id", "slug", F.upper(F.col("slug")).alias("promo_code"),
                    outcome.alias("outcome"))


def partners_from_approvals(approved: DataFrame, partners: DataFrame) -> DataFrame:
    """Item 28 (approval path). Partner rows for approved applications.

    Needs user_id and slug; a user that already has a partner row is skipped (ON
    CONFLICT (user_id) DO NOTHING); a slug or promo code already held by another
    partner, or by an earlier approval in the batch, makes the insert fail
    (``slug_conflict``).  Several approvals of one user: the first (by reviewed order
    ``ts``, id) is used, the rest are ``skipped``.
    """
    a = approved.withColumn("_ok", F.col("user_id").isNotNull() & F.col("slug").isNotNull()
                            & (F.col("slug") != ""))
    existing = partners.select(F.col("user_id").alias("_puser")).distinct()
    held_slug = partners.select(F.col("slug").alias("_hs")).distinct()
    held_code = partners.select(F.col("promo_code").alias("_hc")).distinct()
    a = (a.join(existing, a["user_id"] == existing["_puser"], "left")
         .join(held_slug, a["slug"] == held_slug["_hs"], "left")
         .join(held_code, F.upper(a["slug"]) == held_code["_hc"], "left")
         .withColumn("_held", F.coalesce(F.col("_hs"), F.col("_hc"))))
    fresh = F.col("_ok") & F.col("_puser").isNull()
    a = flag_first(a, ["user_id"], ["ts", "id"], "_first_user", when=fresh)
    a = flag_first(a, ["slug"], ["ts", "id"], "_first_slug",
                   when=fresh & F.col("_first_user") & F.col("_held").isNull())
    outcome = (F.when(~F.col("_ok"), F.lit("missing_user_or_slug"))
               .when(F.col("_puser").isNotNull() | ~F.col("_first_user"), F.lit("skipped"))
               .when(F.col("_held").isNotNull() | ~F.col("_first_slug"), F.lit("slug_conflict"))
               .otherwise(F.lit("created")))
    return a.select(F.col("id").alias("application_id"), "user_id", "slug",
                    F.upper(F.col("slug")).alias("promo_code"), outcome.alias("outcome"))
