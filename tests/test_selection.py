"""Exact selection, p-values and the key filter against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from valuescope.functions.bloom import KEYS_A_BLOCK, filtered_semi_join, key_filter
from valuescope.functions.selection import exact_quantiles, values_at
from valuescope.functions.tails import ln_gamma, t_two_sided


@pytest.mark.parametrize("kind", ["ties", "spread", "one", "edges"])
def test_values_at_every_kind_of_column(spark, kind):
    rng = random.Random(3)
    v = {"ties": [float(min(int(rng.paretovariate(0.6)), 50)) for _ in range(5000)], "spread": [rng.gauss(0, 1e6) for _ in range(5000)],
         "one": [7.0], "edges": [0.0] * 3000 + [-1.5] + [2.25] * 10}[kind]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 5, "v double").repartition(5)
    s, n = sorted(v), len(v)
    ranks = sorted({0, n - 1, n // 2, n // 3, (99 * n) // 100, min(1, n - 1)})
    for target in (1, 50, 10**6):
        assert values_at(df, "v", ranks, n, target) == {r: s[r] for r in ranks}
    qs = {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0, "e": 0.123}
    got = exact_quantiles(df, "v", qs, n, 50)
    for a, q in qs.items():
        p = (n - 1) * q
        want = s[math.floor(p)] + (s[math.ceil(p)] - s[math.floor(p)]) * (p - math.floor(p))
        assert got[a] == want


def test_selection_recovers_from_a_poor_sketch(spark, monkeypatch):
    from valuescope.functions import selection
    monkeypatch.setattr(selection, "LEAST_ACCURACY", 2)
    monkeypatch.setattr(selection, "WIDTH", 0.001)  # brackets that hold next to nothing: widened until every rank is met
    v = [float(x * 37 % 4001) for x in range(4001)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert values_at(df, "v", [0, 17, 2000, 4000], 4001, 4001) == {0: 0.0, 17: 17.0, 2000: 2000.0, 4000: 4000.0}


def tail(t, df):
    """P(|T| >= t) by the closed sums for whole degrees of freedom."""
    a = math.atan2(abs(t), math.sqrt(df))
    s, c = math.sin(a), math.cos(a)
    if df % 2:
        total, term = 0.0, c
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * (2 * k) / (2 * k + 1)
        return 1 - 2 / math.pi * (a + s * total)
    total, term = 0.0, 1.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 1 - s * total


def test_t_tail_on_a_grid(spark):
    rows = [(t, df) for df in (1, 2, 3, 5, 10, 28, 29, 100, 1001, 20000) for t in (0.0, 0.01, -0.5, 1.0, 1.96, -2.7, 5.0, 12.0, 60.0)]
    got = spark.createDataFrame(rows, "t double, df int").withColumn("p", t_two_sided(F.col("t"), F.col("df"))).collect()
    for r in got:
        assert abs(r["p"] - tail(r["t"], r["df"])) < 1e-9, r
    none = spark.createDataFrame([(None, 5), (1.0, 0)], "t double, df int").select(t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r["p"] for r in none] == [None, None]


def test_ln_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ln_gamma(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - math.lgamma(r["x"])) < 1e-12 * max(1, abs(r["y"])) for r in got)


@pytest.mark.parametrize("most", [0, 1 << 28])
def test_filtered_semi_join_equals_the_plain_one(spark, most):
    df = spark.range(30000).select((F.col("id") * 7).alias("k"), "id").union(spark.sql("select cast(null as long), 1L"))
    keys = spark.range(5000).select((F.col("id") * 21).alias("k")).union(spark.sql("select cast(null as long)"))
    got = filtered_semi_join(df, keys, "k", most)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.join(keys, "k", "left_semi").collect()))
    assert ("bitmap_construct_agg" in got._jdf.queryExecution().toString()) == bool(most)
    assert filtered_semi_join(df, keys.limit(0), "k", most).count() == 0


def test_filter_lets_few_other_keys_pass(spark):
    n = 2 * KEYS_A_BLOCK
    keys = spark.range(n).select(F.col("id").alias("k"))
    bits = key_filter(keys, "k", 2)
    from valuescope.functions import bloom
    probe = spark.range(10**6, 10**6 + 20000).select(F.col("id").alias("k"))
    at = probe.withColumn("block", bloom._block(F.col("k"), 2)).join(F.broadcast(bits), "block")
    passed = at.where(F.forall(bloom._bits(F.col("k")), lambda b: bloom._is_set(F.col("bits"), b))).count()
    assert passed < 20000 * 0.02
