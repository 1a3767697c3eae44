"""Answers do not change with size, nulls, id type or file layout."""

import random

import pytest
from pyspark.sql import functions as F

from valuescope.functions.ranking import global_rank, group_quantiles, mid_ranks
from valuescope.operators.splits import user_hash
from valuescope.streaming import streams

from .conftest import SMALL


def _rows(ids):
    rnd = random.Random(3)
    return [(i, rnd.choice([None, "a", "b"]), rnd.choice([0.0, 0.0, 0.0, 1.5, float(rnd.randint(2, 90))])) for i in ids]


@pytest.mark.parametrize("ids, kind", [(range(4_000_000_000, 4_000_000_900), "bigint"), ([f"player-{k:05d}" for k in range(900)], "string")])
@pytest.mark.parametrize("desc", [True, False])
def test_grouped_rank_keeps_null_group_and_any_id(spark, ids, kind, desc):
    rows = _rows(ids)
    df = spark.createDataFrame(rows, f"vopenid {kind}, g string, v double").repartition(5)
    expect = {}
    for g in (None, "a", "b"):
        cum = 0.0
        for k, (i, _, v) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2] if desc else r[2], r[0])), start=1):
            cum += v
            expect[i] = (k, cum)
    for target in (10_000, 40):
        got = global_rank(df, "v", desc=desc, group="g", measure="v", target=target).df.collect()
        assert {r["vopenid"]: (r["rn"], r["cum"]) for r in got} == expect


@pytest.mark.parametrize("desc", [True, False])
def test_rank_of_string_ids(spark, desc):
    rows = _rows([f"player-{k:05d}" for k in range(900)])
    df = spark.createDataFrame(rows, "vopenid string, g string, v double").repartition(5)
    order = sorted(rows, key=lambda r: (-r[2] if desc else r[2], r[0]))
    got = {r["vopenid"]: r["rn"] for r in global_rank(df, "v", desc=desc, target=30).df.collect()}
    assert [got[r[0]] for r in order] == list(range(1, 901))


def test_group_quantiles_and_mid_ranks_keep_the_null_group(spark):
    df = spark.createDataFrame(_rows(range(900)), "vopenid bigint, g string, v double")
    few, many = ({r["g"]: r for r in group_quantiles(df, "g", "v", {"q": 0.7, "r": 0.31}, target=t).collect()} for t in (5, 10_000))
    assert set(few) == set(many) == {None, "a", "b"}
    for g, r in many.items():
        assert few[g]["q"] == pytest.approx(r["q"]) and few[g]["r"] == pytest.approx(r["r"])
    m = mid_ranks(df, "v", "rk", group="g")
    assert m.count() == 900 and m.where("rk is null").count() == 0


def test_user_hash_of_any_id(spark):
    ids = [0, 7, 4_000_000_000, 2**62]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "vopenid bigint").select(user_hash()).collect()]
    assert got == [i * 2654435761 % 2**32 for i in ids]
    assert spark.createDataFrame([("x-1",)], "vopenid string").where(user_hash().between(0, 2**32 - 1)).count() == 1


def test_streams_read_a_folder_of_files(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for job in (streams.stream_daily_kpis, streams.stream_dedup):
        a, b = job(spark, str(tmp_path)), job(spark, SMALL)
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
