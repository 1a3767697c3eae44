"""The mart shuffles lineitem once; written tables have files of bounded rows; training rows are dealt over the cores."""

import datetime as dt
import re
import tempfile

import pytest

from valuescope.operators import ml
from valuescope.plans import mart as M
from valuescope.sources.tables import SCHEMAS

DAY = dt.datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def logs(spark):
    """Orders with a repeated key, a null key, a null user and null days; lineitem at both ends of the window."""
    at = lambda d: None if d is None else DAY + dt.timedelta(days=d)
    orders = [(1, 7, 0), (2, 7, 30), (2, 8, 100), (3, 9, None), (None, 7, 5), (4, None, 1), (5, 10, 3), (6, 11, 400)]
    lines = [(1, 0), (1, 179), (1, 180), (1, -1), (2, 90), (2, 279), (2, 280), (3, 5), (4, 2), (5, None), (5, 3), (None, 9), (6, 100), (1, 0)]
    folder = tempfile.mkdtemp(prefix="vs-logs-", dir="/tmp")
    spark.createDataFrame([(k, u, "F", 10.0, at(d), "1-URGENT") for k, u, d in orders], SCHEMAS["orders"]).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, 1, 1, i % 7 + 1, float(i), 1.5 * i, 0.0, 0.0, "R" if i % 2 else "N", "O", at(d)) for i, (k, d) in enumerate(lines)],
                          SCHEMAS["lineitem"]).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_game_sums_equal_the_sums_over_days(spark, logs):
    cols = ["vopenid", "g_games", "g_wins", "g_qty", "g_score", "g_lines", "g_maxline"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    got = rows(M.game_sums(spark, logs))
    assert got == rows(M.game_features(spark, logs, M.order_features(spark, logs))) and {r[0] for r in got} == {"7", "8", "10"}


def test_the_mart_shuffles_games_once(spark, logs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = M.build_user_mart(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\([^\n]*_groupingexpression[^\n]*\n[^\n]*l_quantity", p)
    assert len(re.findall(r"partial_sum\([^\n]*l_quantity", p)) == 1  # one aggregate, of what is inside the window


def test_written_tables_have_files_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "FILE_ROWS", 100)
    out = M.materialized(spark, "bounded", "/root/testdata/sf0.001", ("orders",), ("bounded",), lambda: spark.range(1000).coalesce(1))
    assert out.count() == 1000 and len(out.inputFiles()) == 10


def test_training_rows_are_dealt_over_tasks(spark):
    df = spark.range(30_000).withColumnRenamed("id", "vopenid").coalesce(1)
    assert ml.spread(df, ml.KEPT_ROWS).rdd.getNumPartitions() == 1
    sizes = ml.spread(df, 30_000).rdd.glom().map(len).collect()
    assert sum(sizes) == 30_000 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * 30_000 / len(sizes)
    assert ml.spread(df, 100 * ml.TASK_ROWS).rdd.getNumPartitions() >= 100


def test_shuffles_of_a_written_table_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "SHUFFLE_ROWS", 10)
    n, seen = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count(), {}
    before = {k: spark.conf.get(k, None) for k in (M.PARTITIONS, *M.TASK_BYTES)}

    def build():
        seen.update({k: spark.conf.get(k) for k in before})
        return spark.range(5)

    M.materialized(spark, "sized", "/root/testdata/sf0.001", ("orders",), ("sized",), build)
    assert int(seen[M.PARTITIONS]) == -(-n // 10) > int(before[M.PARTITIONS]) and all(seen[k] == (before[k] or v) for k, v in M.TASK_BYTES.items())
    assert {k: spark.conf.get(k, None) for k in before} == before
    with pytest.raises(ZeroDivisionError):
        M.materialized(spark, "fails", "/root/testdata/sf0.001", ("orders",), ("fails",), lambda: 1 // 0)
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_the_joins_of_the_logs_do_not_change_with_the_size(spark):
    kinds = lambda: re.findall(r"(\w+Join) ", M.game_sums(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    small = kinds()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert small == kinds() == ["SortMergeJoin", "SortMergeJoin"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
