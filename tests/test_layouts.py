"""Scans with pushed bounds, joins of bucketed logs, daily sketches, and tables written as versions."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from valuescope.operators import exports
from valuescope.operators.cohorts import exact_reach, sketch_reach
from valuescope.plans import mart as M
from valuescope.sources.tables import SCHEMAS, Lake, table_path
from valuescope.sources.writers import read_manifest, read_version, versions, write_version

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_bounds_reach_the_scan_of_the_raw_log(spark):
    lake = Lake(table_path(SMALL, "orders"), "o_orderdate", schema=SCHEMAS["orders"])
    df = lake.between(spark, dt.date(1995, 1, 1), dt.date(1995, 2, 1))
    pushed = plan(df).split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    every = spark.read.parquet(table_path(SMALL, "orders"))
    assert df.count() == every.where("to_date(o_orderdate) >= '1995-01-01' and to_date(o_orderdate) < '1995-02-01'").count() > 0


def test_day_bounds_skip_folders_of_a_partitioned_lake(spark):
    root = tempfile.mkdtemp(prefix="vs-lake-", dir="/tmp") + "/lake"
    o = spark.read.parquet(table_path(SMALL, "orders"))
    o.withColumn("ym", F.date_format("o_orderdate", "yyyy-MM")).write.partitionBy("ym").parquet(root)
    df = Lake(root, "o_orderdate", "ym", "%Y-%m").between(spark, dt.date(1995, 1, 1), dt.date(1995, 3, 1))
    p = plan(df)
    assert "ym" in p.split("PartitionFilters: [", 1)[1].split("]", 1)[0] and "o_orderdate" in p.split("PushedFilters: [", 1)[1]
    assert len({f.split("ym=")[1][:7] for f in df.inputFiles()} - {"1995-01", "1995-02"}) >= 0
    assert {r["ym"] for r in df.select("ym").distinct().collect()} == {"1995-01", "1995-02"}
    assert df.count() == o.where("o_orderdate >= '1995-01-01' and o_orderdate < '1995-03-01'").count()


def test_bucketed_logs_join_without_an_exchange(spark):
    read = M.bucketed_logs(spark, SMALL, 4)
    li, o = read(spark, SMALL, "lineitem", ["l_orderkey", "l_quantity"]), read(spark, SMALL, "orders", ["o_orderkey", "o_custkey"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        assert "SortMergeJoin" in plan(j) and "Exchange" not in plan(j)
        assert j.count() == spark.read.parquet(table_path(SMALL, "lineitem")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_are_within_their_error(spark):
    key = lambda r: (r["level"], r["week"], r["channel"])
    exact = {key(r): r["users"] for r in exact_reach(spark, SMALL).collect()}
    about = {key(r): r["users"] for r in sketch_reach(spark, SMALL).collect()}
    assert exact.keys() == about.keys()
    assert all(abs(about[k] - n) <= max(1, 0.03 * n) for k, n in exact.items())


def test_versions_are_whole_or_not_there(spark):
    path = tempfile.mkdtemp(prefix="vs-versions-", dir="/tmp") + "/t"
    df = spark.createDataFrame([(k, "ab"[k % 2], k * 0.5) for k in range(100)], "id long, role string, x double").repartition(3)
    m = write_version(df, path, partition_by="role")
    assert (m["version"], m["rows"], m["parts"]) == (1, 100, {"a": 50, "b": 50})
    fails = df.withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("half-way")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="half-way"):
        write_version(fails, path, partition_by="role")
    assert versions(spark, path) == [1] and read_version(spark, path).count() == 100
    assert write_version(df.where("id < 10"), path, partition_by="role")["version"] == 2
    assert read_version(spark, path).count() == 10 and read_version(spark, path, 1).count() == 100
    assert sorted(map(tuple, read_version(spark, path).select(*df.columns).collect())) == sorted(map(tuple, df.where("id < 10").collect()))
    with pytest.raises(FileNotFoundError):
        read_manifest(spark, path + "-none")


def test_ordered_files_hold_one_global_order(spark):
    path = tempfile.mkdtemp(prefix="vs-ordered-", dir="/tmp") + "/t"
    exports.export_seed_list(spark, SMALL, path)
    m = read_manifest(spark, path)
    files = sorted(f for f in read_version(spark, path).inputFiles())
    ranks = [r["seed_rank"] for f in files for r in spark.read.schema(read_version(spark, path).schema).option("header", "true").csv(f).collect()]
    assert ranks == list(range(1, m["rows"] + 1))


def test_exports_read_back_what_was_written(spark):
    path = tempfile.mkdtemp(prefix="vs-exports-", dir="/tmp")
    roles = {r["role"]: r["users"] for r in exports.export_splits(spark, SMALL, path=path + "/splits").collect()}
    assert read_manifest(spark, path + "/splits")["parts"] == {k: v for k, v in roles.items()}
    oot = exports.export_oot(spark, SMALL, path=path + "/oot")
    frame = read_version(spark, path + "/oot/scoring")
    assert frame.where("ltv30 is not null").count() == 0 and frame.count() == oot.count()
    assert exports.export_sample(spark, SMALL, path + "/sample").count() == read_manifest(spark, path + "/sample")["rows"] > 0


def test_fingerprint_follows_files_in_folders(spark, tmp_path):
    """One file, a folder and a partitioned folder; a new file and a replaced one each give another digest."""
    from valuescope.plans.mart import _source_fingerprint
    df = spark.range(20).selectExpr("id", "id % 2 as p")
    df.coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    df.write.partitionBy("p").parquet(f"{tmp_path}/b.parquet")
    mark = lambda: _source_fingerprint(spark, f"file://{tmp_path}", ("a", "b"))
    first = mark()
    assert first == mark()
    df.where("p = 1").write.partitionBy("p").mode("append").parquet(f"{tmp_path}/b.parquet")
    second = mark()
    assert second != first
    df.where("id < 3").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/a.parquet")
    assert mark() not in (first, second)
