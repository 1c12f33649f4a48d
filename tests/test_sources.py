"""Domain tables on parquet: declared schemas, pushdown and pruning reach the scan."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from acadia.operators import sales
from acadia.sources.domain import DOMAIN_SCHEMAS, publish, read_domain, read_domain_tables, write_version


def _orders_table(fx):
    cols = DOMAIN_SCHEMAS["orders"].fieldNames()
    o = fx.orders
    return o.select(*[o[c] if c in o.columns else F.lit(None).cast(DOMAIN_SCHEMAS["orders"][c].dataType).alias(c)
                      for c in cols])


def test_filters_and_pruning_reach_the_parquet_scan(spark, fx, tmp_path):
    base = str(tmp_path / "domain")
    path = write_version(_orders_table(fx), base, "orders", "1")
    orders = spark.read.schema(DOMAIN_SCHEMAS["orders"]).parquet(path)
    q = sales.sales_daily(orders, start="1996-01-01", end="1996-12-31")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), IsNotNull(product), IsNotNull(paid_at), EqualTo(status,paid)" in plan
    assert "ReadSchema: struct<product:string,amount:decimal(12,2),status:string,paid_at:timestamp>" in plan
    assert q.count() > 0


def test_read_domain_uses_declared_schema(spark, fx, tmp_path):
    base = str(tmp_path / "domain")
    write_version(_orders_table(fx), base, "orders", "7")
    df = spark.read.schema(DOMAIN_SCHEMAS["orders"]).parquet(base + "/orders/v=7")
    assert df.schema.fieldNames() == DOMAIN_SCHEMAS["orders"].fieldNames()
    assert df.where(F.col("paid_at") < dt.datetime(1996, 1, 1)).count() > 0
    write_version(_orders_table(fx).limit(5), base, "orders", "8")
    assert read_domain(spark, base, "orders", version="8").count() == 5


def test_partitioned_version_prunes_folders(spark, fx, tmp_path):
    base = str(tmp_path / "domain")
    path = write_version(_orders_table(fx), base, "orders", "p1", partition_by=["status"])
    orders = spark.read.parquet(path)
    assert orders.count() == fx.orders.count()
    q = orders.where(F.col("status") == "paid")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan and "(status" in plan
    assert q.count() == fx.orders.where("status = 'paid'").count()


def test_readers_follow_the_published_version(spark, fx, tmp_path):
    base = str(tmp_path / "domain")
    orders = _orders_table(fx).limit(9)
    write_version(orders, base, "orders", "a")
    with pytest.raises(FileNotFoundError):
        read_domain(spark, base, "orders")
    publish(spark, base, {"orders": "a"})
    assert read_domain(spark, base, "orders").count() == 9
    write_version(orders.limit(4), base, "orders", "b")
    users = spark.createDataFrame([], DOMAIN_SCHEMAS["users"])
    write_version(users, base, "users", "b")
    assert read_domain(spark, base, "orders").count() == 9  # written, not published
    publish(spark, base, {"orders": "b", "users": "b"})
    both = read_domain_tables(spark, base, ["orders", "users"])
    assert both["orders"].count() == 4 and both["users"].count() == 0
    assert both["orders"].columns == DOMAIN_SCHEMAS["orders"].fieldNames()
    assert read_domain(spark, base, "orders", version="a").count() == 9


def test_read_domain_of_a_plain_export(spark, fx, tmp_path):
    base = str(tmp_path / "export")
    _orders_table(fx).limit(3).write.parquet(base + "/orders")
    assert read_domain(spark, base, "orders").count() == 3
