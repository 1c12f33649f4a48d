"""Course reports: lesson engagement and outline, materials, catalogue counts, the per-user
lesson catalogue and progress summary (items 12-14, 22, 23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PUBLIC_MATERIAL_CATEGORIES
from ..functions.filters import eq_if, where
from ..functions.money import percent_of


def lesson_engagement(lessons: DataFrame, progress: DataFrame, lesson_id=None) -> DataFrame:
    """Item 12. Per lesson: completed_count and viewed_count (= number of progress rows).

    Progress is aggregated per lesson before the join (map-side combine), so a lesson
    with most of the progress rows costs no single task more than its partial counts.
    """
    l = where(lessons, eq_if("id", lesson_id))
    p = progress if lesson_id is None else progress.where(F.col("lesson_id") == F.lit(lesson_id))
    agg = p.groupBy(F.col("lesson_id").alias("_lid")).agg(
        F.count_if(F.col("completed")).alias("completed_count"),
        F.count(F.col("user_id")).alias("viewed_count"))
    return (l.join(agg, l["id"] == agg["_lid"], "left").drop("_lid")
            .withColumn("completed_count", F.coalesce(F.col("completed_count"), F.lit(0)))
            .withColumn("viewed_count", F.coalesce(F.col("viewed_count"), F.lit(0))))


def lesson_outline(lessons: DataFrame, topics: DataFrame, videos: DataFrame,
                   lesson_id=None) -> DataFrame:
    """Item 12 (detail) / 22: the topics and videos of each lesson as ordered rows.

    One row per item: ``lesson_id, kind ('topic'|'video'), item_id, sort_order, text``
    (topic text or video title) and the video fields; ``(kind, sort_order, item_id)``
    gives the display order within a lesson (the frame itself is not sorted).  Items of
    unknown lessons are dropped.  This is the relational form of the nested
    ``topics[]``/``videos[]`` lists: nothing is collected per lesson, so a lesson with
    many items spreads over tasks like any other rows.
    """
    keep = where(lessons, eq_if("id", lesson_id)).select(F.col("id").alias("_lid"))
    t = topics.select("lesson_id", F.lit("topic").alias("kind"), F.col("id").alias("item_id"),
                      "sort_order", F.col("text").alias("text"),
                      F.lit(None).cast("string").alias("video_url"),
                      F.lit(None).cast("boolean").alias("is_main"))
    v = videos.select("lesson_id", F.lit("video").alias("kind"), F.col("id").alias("item_id"),
                      "sort_order", F.col("title").alias("text"), "video_url", "is_main")
    items = t.unionByName(v)
    return items.join(keep, items["lesson_id"] == keep["_lid"], "left_semi")


def material_listing(materials: DataFrame, category=None, public: bool = False) -> DataFrame:
    """Item 13. Materials by category then sort_order.

    ``public=True`` is the subscriber view: only the four public categories are served
    (an unknown or missing category gives no rows) and the columns shown there.  Who may
    see it is a per-user flag (``user_entitlements.materials_access``), not a join here.
    """
    if public:
        cols = [c for c in ("id", "title", "description", "preview_url", "download_url")
                if c in materials.columns]
        if category not in PUBLIC_MATERIAL_CATEGORIES:
            return materials.select(*cols).limit(0)
        return materials.where(F.col("category") == F.lit(category)) \
            .orderBy(F.col("sort_order").asc(), F.col("id").asc()).select(*cols)
    return where(materials, eq_if("category", category)) \
        .orderBy(F.col("category").asc(), F.col("sort_order").asc(), F.col("id").asc())


def catalog_counts(materials: DataFrame) -> DataFrame:
    """Item 14. Number of materials per category."""
    return materials.groupBy("category").agg(F.count(F.lit(1)).cast("int").alias("cnt"))


LESSON_BLOCKS = 16


def _wanted(df: DataFrame, user_ids: DataFrame | None) -> DataFrame:
    if user_ids is None:
        return df
    wanted = user_ids.select(F.col("user_id").alias("_want")).distinct()
    return df.join(wanted, df["user_id"] == wanted["_want"], "left_semi")


def lesson_access(users: DataFrame, orders: DataFrame, user_ids: DataFrame | None = None) -> DataFrame:
    """Item 22, sparse. ``user_id, has_access``: whether lessons that are not free are open to the
    user (an admin, or any paid order).  With ``progress_details`` this is the whole catalogue
    but for the lessons themselves: what is not listed there is neither viewed nor completed."""
    buyers = (orders.where(F.col("status") == "paid").select(F.col("user_id").alias("_b"))
              .distinct().withColumn("_paid", F.lit(True)))
    u = _wanted(users.select(F.col("id").alias("user_id"), "role"), user_ids)
    return u.join(buyers, u["user_id"] == buyers["_b"], "left").select(
        "user_id", (F.coalesce(F.col("_paid"), F.lit(False)) |
                    F.coalesce(F.col("role") == "admin", F.lit(False))).alias("has_access"))


def progress_details(progress: DataFrame, lessons: DataFrame, user_ids: DataFrame | None = None) -> DataFrame:
    """Item 23. The progress rows themselves, with the lesson's title and place; the original lists
    them by ``sort_order``.  Rows of unknown lessons are dropped."""
    l = lessons.select(F.col("id").alias("_lid"), "title", "sort_order")
    p = _wanted(progress, user_ids)
    return p.join(l, p["lesson_id"] == l["_lid"]).select(
        "user_id", "lesson_id", "title", "sort_order", "viewed", "completed", "viewed_at", "completed_at")


def progress_overview(users: DataFrame, progress: DataFrame, lessons: DataFrame, user_ids: DataFrame | None = None) -> DataFrame:
    """Item 23. ``progress_summary`` of every user; one without progress has zeros and no last
    activity.  Progress of users that do not exist is left out."""
    u = _wanted(users.select(F.col("id").alias("user_id")), user_ids)
    s = progress_summary(progress, lessons, user_ids).drop("total_lessons").withColumnRenamed("user_id", "_su")
    total = lessons.agg(F.count(F.lit(1)).alias("total_lessons"))
    none = F.lit(0).cast("long")
    return u.join(s, u["user_id"] == s["_su"], "left").crossJoin(total).select(
        "user_id", *[F.coalesce(c, none).alias(c) for c in ("completed_count", "viewed_count")], "total_lessons",
        F.coalesce("percentage", F.lit(0)).cast(s.schema["percentage"].dataType).alias("percentage"), "last_activity")


def lesson_catalog(users: DataFrame, lessons: DataFrame, topics: DataFrame,
                   videos: DataFrame, progress: DataFrame, orders: DataFrame,
                   user_ids: DataFrame | None = None) -> DataFrame:
    """Item 22. For every user and every lesson: unlocked, viewed, completed, item counts.

    unlocked = lesson is free, or the user is an admin, or has any paid order; viewed
    and completed come from the user's progress row (false when absent).

    The result is users x lessons by definition.  The lesson side is first reduced to one row
    per lesson (with topic/video counts) and cut into ``LESSON_BLOCKS`` blocks; every user is
    listed once per block and joined on it, a hash or sort-merge join like any other, then
    progress on the (user, lesson) key.  ``user_ids`` (column ``user_id``) restricts the
    catalogue to those users, as for one request; for all users ``lesson_access`` and
    ``progress_details`` hold the same in as many rows as there are users and progress rows.
    """
    tc = topics.groupBy(F.col("lesson_id").alias("_t")).agg(F.count(F.lit(1)).alias("topic_count"))
    vc = videos.groupBy(F.col("lesson_id").alias("_v")).agg(F.count(F.lit(1)).alias("video_count"))
    l = (lessons.select(F.col("id").alias("lesson_id"), "title", "sort_order", "is_free")
         .join(tc, F.col("lesson_id") == tc["_t"], "left")
         .join(vc, F.col("lesson_id") == vc["_v"], "left")
         .select("lesson_id", "title", "sort_order", "is_free",
                 F.coalesce(F.col("topic_count"), F.lit(0)).alias("topic_count"),
                 F.coalesce(F.col("video_count"), F.lit(0)).alias("video_count")))
    u = lesson_access(users, orders, user_ids)
    pr = progress.select(F.col("user_id").alias("_pu"), F.col("lesson_id").alias("_pl"),
                         F.col("viewed").alias("_viewed"), F.col("completed").alias("_completed"))
    l = l.withColumn("_lb", F.pmod(F.xxhash64("lesson_id"), F.lit(LESSON_BLOCKS)))
    pairs = u.withColumn("_ub", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LESSON_BLOCKS - 1).cast("long"))))
    pairs = pairs.join(l, F.col("_ub") == F.col("_lb")).drop("_ub", "_lb")
    return (pairs.join(pr, (pairs["user_id"] == pr["_pu"]) & (pairs["lesson_id"] == pr["_pl"]),
                       "left")
            .select("user_id", "lesson_id", "title", "sort_order", "is_free",
                    (F.col("is_free") | F.col("has_access")).alias("unlocked"),
                    F.coalesce(F.col("_viewed"), F.lit(False)).alias("viewed"),
                    F.coalesce(F.col("_completed"), F.lit(False)).alias("completed"),
                    "topic_count", "video_count", "has_access"))


def progress_summary(progress: DataFrame, lessons: DataFrame,
                     user_ids: DataFrame | None = None) -> DataFrame:
    """Item 23. Per user with progress: completed, viewed, total lessons, %, last activity.

    Progress rows of unknown lessons are dropped (inner join in the original, a
    semi-join here).  Last activity is the latest ``coalesce(completed_at, viewed_at)``.
    ``user_ids`` (column ``user_id``) restricts the summary to those users before any
    aggregation.
    """
    known = lessons.select(F.col("id").alias("_lid"))
    total = lessons.agg(F.count(F.lit(1)).alias("total_lessons"))
    progress = _wanted(progress, user_ids)
    p = progress.join(known, progress["lesson_id"] == known["_lid"], "left_semi")
    agg = p.groupBy("user_id").agg(
        F.count_if(F.col("completed")).alias("completed_count"),
        F.count_if(F.col("viewed")).alias("viewed_count"),
        F.max(F.coalesce(F.col("completed_at"), F.col("viewed_at"))).alias("last_activity"))
    return agg.crossJoin(total).select(
        "user_id", "completed_count", "viewed_count", "total_lessons",
        percent_of(F.col("completed_count"), F.col("total_lessons")).alias("percentage"),
        "last_activity")
