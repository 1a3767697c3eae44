"""Shard union, coercion to numbers, required columns, partitioned writes."""

import tempfile

import pytest
from pyspark.sql import functions as F

from valuescope.sources.tables import coerce_numeric, read_table, require_columns, shard_union, write_partitioned

from .conftest import SMALL


def test_shard_union_fills_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="vs-shards-", dir="/tmp")
    o = read_table(spark, SMALL, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    o.where("o_orderkey % 2 = 0").write.option("header", "true").csv(f"{d}/a")
    o.where("o_orderkey % 2 = 1").drop("o_totalprice").write.option("header", "true").csv(f"{d}/b")
    u = shard_union(spark, [f"{d}/a", f"{d}/b"], fmt="csv")
    assert u.count() == o.count()
    assert u.where(F.col("o_totalprice").isNull()).count() == o.where("o_orderkey % 2 = 1").count()


def test_coerce_numeric_bad_values_become_null(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,)], "v string")
    got = [r["v"] for r in coerce_numeric(df, ["v"]).collect()]
    assert got == [1.0, 2.5, None, None]


def test_require_columns(spark):
    df = read_table(spark, SMALL, "customer", ["c_custkey"])
    require_columns(df, ["c_custkey"])
    with pytest.raises(ValueError, match="c_name"):
        require_columns(df, ["c_custkey", "c_name"])


def test_reader_prunes_columns(spark):
    df = read_table(spark, SMALL, "lineitem", ["l_orderkey", "l_quantity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_orderkey" in plan


def test_write_partitioned_one_folder_per_role(spark):
    d = tempfile.mkdtemp(prefix="vs-roles-", dir="/tmp")
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "recent")], "vopenid long, role string")
    write_partitioned(df, f"{d}/out", "role")
    back = spark.read.parquet(f"{d}/out")
    assert sorted(r["role"] for r in back.select("role").distinct().collect()) == ["recent", "test", "train"]
    assert back.where("role = 'test'").count() == 1
