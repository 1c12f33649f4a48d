"""User purge with per-table removal counts and blockers (item 34)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.filters import sized
from ..session import checkpoint_dir
from ..sources.rewrite import Rewrite, delete_rows
from ..sources.versions import Snapshot, publish_on, read_version, snapshot

# Per table, the columns that tie a row to a purged user or to one of the user's partners.
LINKS = {
    "users": [("id", "user")], "referrals": [("referred_user_id", "user"), ("partner_id", "partner")], "orders": [("user_id", "user")],
    "partner_payouts": [("partner_id", "partner")], "partners": [("user_id", "user")], "partner_applications": [("user_id", "user")],
    "course_progress": [("user_id", "user")], "refresh_tokens": [("user_id", "user")],
}
CHECKED = ("users", "orders", "partners", "partner_applications")

def purge_report(user_ids: DataFrame, actor_id, users: DataFrame, orders: DataFrame,
                 partners: DataFrame, applications: DataFrame) -> DataFrame:
    """Item 34 (checks). Each requested user with ``outcome``: ``self`` (the acting
    admin), ``not_found``, ``blocked_orders`` (an order of another user is attributed to
    one of this user's partner rows: FK without cascade), ``blocked_reviewer`` (the user
    reviewed another user's application, when ``reviewed_by`` is present), else
    ``deleted``.
    """
    req = user_ids.select(F.col("user_id")).where(F.col("user_id").isNotNull()).distinct()
    known = users.select(F.col("id").alias("_u"))
    r = req.join(known, req["user_id"] == known["_u"], "left")
    owned = partners.select(F.col("id").alias("_pid"), F.col("user_id").alias("_owner"))
    foreign = (orders.join(owned, orders["referral_partner_id"] == owned["_pid"], "inner")
               .where(F.col("user_id").isNull() | (F.col("user_id") != F.col("_owner")))
               .select(F.col("_owner").alias("_bo")).distinct())
    r = r.join(foreign, r["user_id"] == foreign["_bo"], "left")
    outcome = (F.when(F.col("user_id") == F.lit(actor_id), F.lit("self"))
               .when(F.col("_u").isNull(), F.lit("not_found"))
               .when(F.col("_bo").isNotNull(), F.lit("blocked_orders")))
    if "reviewed_by" in applications.columns:
        rev = (applications.where(F.col("reviewed_by").isNotNull()
                                  & (F.col("user_id").isNull()
                                     | (F.col("user_id") != F.col("reviewed_by"))))
               .select(F.col("reviewed_by").alias("_rv")).distinct())
        r = r.join(rev, r["user_id"] == rev["_rv"], "left")
        outcome = outcome.when(F.col("_rv").isNotNull(), F.lit("blocked_reviewer"))
    return r.select("user_id", outcome.otherwise(F.lit("deleted")).alias("outcome"))


def _purged_keys(user_ids: DataFrame, actor_id, t: dict[str, DataFrame]):
    """Deletable users and their partner ids, materialised once.

    Both are bounded by the size of the request batch; checkpointing them (session
    checkpoint folder) lets the eight table rewrites reuse them instead of re-running
    the blocker checks eight times, and cuts lineage.
    """
    checkpoint_dir(user_ids.sparkSession)
    report = purge_report(user_ids, actor_id, t["users"], t["orders"], t["partners"],
                          t["partner_applications"]).checkpoint(eager=True)
    gone = report.where(F.col("outcome") == "deleted").select(F.col("user_id").alias("_g"))
    gone_partners = (t["partners"].join(gone, t["partners"]["user_id"] == gone["_g"], "left_semi")
                     .select(F.col("id").alias("_gp")).checkpoint(eager=True))
    return gone, gone_partners, report


def user_purge(user_ids: DataFrame, actor_id, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Item 34. New state of every table after purging the deletable users.

    ``tables``: users, referrals, orders, partner_payouts, partners,
    partner_applications, course_progress, refresh_tokens.  Removed: referrals of the
    user (as referred user or through their partner), their orders, their partners'
    payouts, their partner rows and applications, the user; progress and refresh
    tokens cascade.  The result also holds ``report`` (see ``purge_report``).
    """
    t = tables
    gone, gone_partners, report = _purged_keys(user_ids, actor_id, t)

    def drop(df: DataFrame, col: str, ids: DataFrame, idcol: str) -> DataFrame:
        return df.join(ids, df[col] == ids[idcol], "left_anti")

    out = {
        "users": drop(t["users"], "id", gone, "_g"),
        "referrals": drop(drop(t["referrals"], "referred_user_id", gone, "_g"),
                          "partner_id", gone_partners, "_gp"),
        "orders": drop(t["orders"], "user_id", gone, "_g"),
        "partner_payouts": drop(t["partner_payouts"], "partner_id", gone_partners, "_gp"),
        "partners": drop(t["partners"], "user_id", gone, "_g"),
        "partner_applications": drop(t["partner_applications"], "user_id", gone, "_g"),
        "course_progress": drop(t["course_progress"], "user_id", gone, "_g"),
        "refresh_tokens": drop(t["refresh_tokens"], "user_id", gone, "_g"),
    }
    out["report"] = report
    return out


def user_purge_counts(user_ids: DataFrame, actor_id, tables: dict[str, DataFrame]) -> DataFrame:
    """Item 34. Rows removed per table, plus the number of requests per outcome.

    Each count is a semi join of one table against the materialised purge keys, which are
    broadcast if they are few.
    """
    t = tables
    gone, gone_partners, report = _purged_keys(user_ids, actor_id, t)
    gone, gone_partners = sized(gone), sized(gone_partners)

    def removed(name: str, *links: tuple[str, DataFrame, str]) -> DataFrame:
        # Left joins against distinct key sets never multiply rows; a row counts once
        # even when it matches through several links.
        df = t[name]
        hit = None
        for i, (col, ids, idcol) in enumerate(links):
            k = ids.select(F.col(idcol).alias(f"_m{i}"))
            df = df.join(k, df[col] == k[f"_m{i}"], "left")
            h = F.col(f"_m{i}").isNotNull()
            hit = h if hit is None else hit | h
        return df.agg(F.count_if(hit).alias("n")).select(F.lit(name).alias("item"), "n")

    parts = [
        removed("users", ("id", gone, "_g")),
        removed("referrals", ("referred_user_id", gone, "_g"), ("partner_id", gone_partners, "_gp")),
        removed("orders", ("user_id", gone, "_g")),
        removed("partner_payouts", ("partner_id", gone_partners, "_gp")),
        removed("partners", ("user_id", gone, "_g")),
        removed("partner_applications", ("user_id", gone, "_g")),
        removed("course_progress", ("user_id", gone, "_g")),
        removed("refresh_tokens", ("user_id", gone, "_g")),
        report.groupBy(F.concat(F.lit("outcome:"), F.col("outcome")).alias("item"))
        .agg(F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge_stored(spark: SparkSession, base: str, user_ids: DataFrame, actor_id, schemas: dict[str, StructType], version: str,
                 others: dict[str, DataFrame] | None = None) -> tuple[Snapshot, dict[str, Rewrite], DataFrame]:
    """Item 34 on stored tables: the state published after the purge, what it did to each table of
    ``schemas``, and ``purge_report``.

    Only files that hold a purged key are rewritten; of the others the key column alone is
    read.  All tables are published at once, or none: if another writer changed one that the
    purge read, it raises ``Conflict``.  ``others`` gives tables of ``CHECKED`` that are not stored here.
    """
    now = snapshot(spark, base)
    tables = {n: read_version(spark, base, n, now.versions[n], s) for n, s in schemas.items()}
    gone, gone_partners, report = _purged_keys(user_ids, actor_id, {**(others or {}), **tables})
    ids = {"user": gone, "partner": gone_partners}
    done = {n: delete_rows(spark, base, n, now.versions[n], s, [(c, ids[kind]) for c, kind in LINKS[n]], version) for n, s in schemas.items()}
    after = publish_on(spark, base, now, {n: r.version for n, r in done.items() if r.version}, [n for n in CHECKED if n in schemas])
    return after, done, report
