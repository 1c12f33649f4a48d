"""Course progress jobs: batched upsert of progress events (31) and progress reset (35)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import flag_exists

PROGRESS_COLUMNS = ["user_id", "lesson_id", "viewed", "completed", "viewed_at", "completed_at"]


def progress_admission(events: DataFrame, lessons: DataFrame, orders: DataFrame,
                       users: DataFrame) -> DataFrame:
    """Item 31 (checks). Each event with ``reason`` (NULL when admitted), in order:
    ``lesson_not_found``, ``no_access`` (lesson not free, user not admin, no paid
    order), ``no_data`` (neither flag supplied).  Flags are normalised: completed
    implies viewed; a missing flag is false.
    """
    l = lessons.select(F.col("id").alias("_lid"), F.col("is_free").alias("_free"))
    admins = users.where(F.col("role") == "admin").select(F.col("id").alias("_aid"))
    e = events.join(l, events["lesson_id"] == l["_lid"], "left")
    e = flag_exists(e, orders.where(F.col("status") == "paid"), "user_id", "user_id", "_paid")
    e = flag_exists(e, admins, "user_id", "_aid", "_admin")
    reason = (F.when(F.col("_lid").isNull(), F.lit("lesson_not_found"))
              .when(~(F.coalesce(F.col("_free"), F.lit(False)) | F.col("_admin") | F.col("_paid")),
                    F.lit("no_access"))
              .when(F.col("viewed").isNull() & F.col("completed").isNull(), F.lit("no_data")))
    completed = F.coalesce(F.col("completed"), F.lit(False))
    return e.select("event_id", "user_id", "lesson_id", "ts",
                    (completed | F.coalesce(F.col("viewed"), F.lit(False))).alias("viewed"),
                    completed.alias("completed"), reason.alias("reason"))


def fold_progress(admitted: DataFrame) -> DataFrame:
    """Order-free fold of admitted events per (user, lesson): flags only rise, each
    timestamp is the first event that set its flag.  Commutative and idempotent, so
    replays and late events converge (it is also the streaming fold of item 48)."""
    return admitted.groupBy("user_id", "lesson_id").agg(
        F.bool_or("viewed").alias("viewed"),
        F.bool_or("completed").alias("completed"),
        F.min(F.when(F.col("viewed"), F.col("ts"))).alias("viewed_at"),
        F.min(F.when(F.col("completed"), F.col("ts"))).alias("completed_at"))


def merge_progress(state: DataFrame, folded: DataFrame) -> DataFrame:
    """Full outer merge on (user_id, lesson_id): flags OR-ed, first timestamps kept."""
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in PROGRESS_COLUMNS])
    n = folded.select(*[F.col(c).alias(f"n_{c}") for c in PROGRESS_COLUMNS])
    j = s.join(n, (s["s_user_id"] == n["n_user_id"]) & (s["s_lesson_id"] == n["n_lesson_id"]),
               "full_outer")

    def first(c):  # existing value wins; otherwise the batch's first occurrence
        return F.coalesce(F.col(f"s_{c}"), F.col(f"n_{c}")).alias(c)

    def rise(c):
        return (F.coalesce(F.col(f"s_{c}"), F.lit(False)) |
                F.coalesce(F.col(f"n_{c}"), F.lit(False))).alias(c)

    return j.select(F.coalesce("s_user_id", "n_user_id").alias("user_id"),
                    F.coalesce("s_lesson_id", "n_lesson_id").alias("lesson_id"),
                    rise("viewed"), rise("completed"), first("viewed_at"), first("completed_at"))


def fold_events(events: DataFrame) -> DataFrame:
    """Raw events folded per (user, lesson), those without a flag left out: admission depends on
    user and lesson alone, so it can wait until a hot user is one row per lesson."""
    completed = F.coalesce(F.col("completed"), F.lit(False))
    return fold_progress(events.where(F.col("viewed").isNotNull() | F.col("completed").isNotNull()).select(
        "user_id", "lesson_id", "ts", (completed | F.coalesce(F.col("viewed"), F.lit(False))).alias("viewed"),
        completed.alias("completed")))


def admitted_keys(folded: DataFrame, lessons: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of ``fold_events`` whose user may work on the lesson (see ``progress_admission``)."""
    free = lessons.select(F.col("id").alias("_lid"), F.coalesce(F.col("is_free"), F.lit(False)).alias("_free"))
    admins = users.where(F.col("role") == "admin").select(F.col("id").alias("_aid"))
    folded = folded.join(free, F.col("lesson_id") == F.col("_lid"))
    folded = flag_exists(folded, orders.where(F.col("status") == "paid"), "user_id", "user_id", "_paid")
    folded = flag_exists(folded, admins, "user_id", "_aid", "_admin")
    return folded.where("_free OR _paid OR _admin").select(*PROGRESS_COLUMNS)


def progress_upsert(events: DataFrame, progress: DataFrame, lessons: DataFrame,
                    orders: DataFrame, users: DataFrame) -> DataFrame:
    """Item 31. New ``course_progress`` state after applying a batch of progress events.

    Events: (event_id, user_id, lesson_id, viewed, completed, ts).  Rejected events
    (see ``progress_admission``) change nothing.  The raw events are folded per (user,
    lesson) first, with map-side combine, and only folded rows meet the access tables.
    """
    return merge_progress(progress, admitted_keys(fold_events(events), lessons, orders, users))


def progress_reset(requests: DataFrame, progress: DataFrame, users: DataFrame) -> DataFrame:
    """Item 35. Progress left after reset requests (actor_id, target_user_id).

    An admin resets ``target_user_id`` when given; everyone else (and an admin without
    a target) resets their own progress.
    """
    roles = users.select(F.col("id").alias("_uid"), "role")
    r = requests.join(roles, requests["actor_id"] == roles["_uid"], "left")
    target = F.when((F.col("role") == "admin") & F.col("target_user_id").isNotNull(),
                    F.col("target_user_id")).otherwise(F.col("actor_id"))
    targets = r.select(target.alias("_t")).where(F.col("_t").isNotNull()).distinct()
    return progress.join(targets, progress["user_id"] == targets["_t"], "left_anti")
