"""Course access jobs: grant (32) and revoke (33)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GRANT_PRODUCT
from ..functions.filters import ts_lit
from ..functions.sequence import sequence_number


def access_grants(user_ids: DataFrame, orders: DataFrame, accounts: DataFrame, as_of,
                  product: str = GRANT_PRODUCT) -> DataFrame:
    """Item 32. Zero-amount paid orders for users without any paid order.

    ``user_ids``: (user_id).  Duplicates in the batch grant once; ids that are not in
    ``accounts`` (the users) get nothing.  New ids follow the highest one without gaps, in
    order of user id.
    """
    users = user_ids.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    users = users.join(accounts.select(F.col("id").alias("_a")), F.col("user_id") == F.col("_a"), "left_semi")
    paid = orders.where(F.col("status") == "paid").select(F.col("user_id").alias("_p"))
    todo = users.join(paid, users["user_id"] == paid["_p"], "left_anti")
    top = orders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    now = ts_lit(as_of)
    return sequence_number(todo, [], ["user_id"], "_n").crossJoin(top).select(
        (F.col("_max") + F.col("_n")).alias("id"), "user_id",
        F.lit(product).alias("product"), F.lit(0).cast("decimal(12,2)").alias("amount"),
        F.lit(None).cast("long").alias("referral_partner_id"),
        F.lit(None).cast("string").alias("promo_code"), F.lit("paid").alias("status"),
        now.alias("created_at"), now.alias("paid_at"))


def access_grant(user_ids: DataFrame, orders: DataFrame, accounts: DataFrame, as_of,
                 product: str = GRANT_PRODUCT) -> DataFrame:
    """Item 32. The orders table with the grants appended."""
    grants = access_grants(user_ids, orders, accounts, as_of, product)
    return orders.unionByName(grants.select(*orders.columns))


def access_revoke(user_ids: DataFrame, orders: DataFrame) -> DataFrame:
    """Item 33. The orders table without the paid orders of the given users."""
    users = user_ids.select(F.col("user_id").alias("_u")).distinct()
    return orders.join(users, (orders["user_id"] == users["_u"]) & (orders["status"] == "paid"),
                       "left_anti")
