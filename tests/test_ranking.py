"""Bucketed global rank / quantiles equal a single ordered window (brute force)."""

from pyspark.sql import functions as F

from valuescope.functions.ranking import cutoff_values, global_rank, mid_rank_values, mid_ranks, quantiles, rank_correlation, rank_sums
from valuescope.operators.evaluation import rank_agreement
from valuescope.plans.mart import user_mart

from .conftest import MEDIUM


def _mart(spark):
    return user_mart(spark, MEDIUM).select("vopenid", "ltv30", "rev_d7")


def test_global_rank_matches_window_with_heavy_ties(spark):
    m = _mart(spark)
    # tiny buckets force the multi-bucket path and the tie (ltv = 0) split
    r = global_rank(m, "ltv30", desc=True, measure="ltv30", target=50)
    got = {row["vopenid"]: (row["rn"], round(row["cum"], 2)) for row in r.df.collect()}
    assert r.n == 1500 and len(got) == 1500
    rows = sorted(m.collect(), key=lambda x: (-x["ltv30"], x["vopenid"]))
    cum = 0.0
    for i, row in enumerate(rows, start=1):
        cum = round(cum + row["ltv30"], 2)
        assert got[row["vopenid"]] == (i, cum)


def test_ascending_rank_and_quantiles(spark):
    m = _mart(spark)
    r = global_rank(m, "rev_d7", desc=False, target=37)
    rows = sorted(m.collect(), key=lambda x: (x["rev_d7"], x["vopenid"]))
    got = {row["vopenid"]: row["rn"] for row in r.df.collect()}
    assert [got[x["vopenid"]] for x in rows] == list(range(1, len(rows) + 1))
    qs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    big = quantiles(m, "ltv30", qs, target=40).first().asDict()
    small = m.agg(*[F.percentile("ltv30", q).alias(a) for a, q in qs.items()]).first().asDict()
    for a in qs:
        assert abs(big[a] - small[a]) < 1e-6 * max(1.0, abs(small[a])), a


def test_cutoffs_with_filter(spark):
    m = _mart(spark)
    c = cutoff_values(m, "ltv30", {"med": 0.5}, where=F.col("ltv30") > 0)
    exp = m.where("ltv30 > 0").agg(F.median("ltv30")).first()[0]
    assert abs(c["med"] - exp) < 1e-6


def test_grouped_rank_restarts_per_group(spark):
    m = _mart(spark)
    long = m.select("vopenid", F.lit("a").alias("g"), F.col("ltv30").alias("v")).unionByName(
        m.select("vopenid", F.lit("b").alias("g"), F.col("rev_d7").alias("v")))
    r = global_rank(long, "v", desc=True, group="g", measure="v", target=60)
    got = {(row["g"], row["vopenid"]): row["rn"] for row in r.df.collect()}
    for g, c in (("a", "ltv30"), ("b", "rev_d7")):
        rows = sorted(m.collect(), key=lambda x: (-x[c], x["vopenid"]))
        assert [got[(g, x["vopenid"])] for x in rows] == list(range(1, len(rows) + 1))


def _ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def _rho(x, y):
    a, b = _ranks(x), _ranks(y)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True))
    va, vb = sum((p - ma) ** 2 for p in a), sum((q - mb) ** 2 for q in b)
    return None if va * vb == 0 else cov / (va * vb) ** 0.5


def test_rank_statistics_of_distinct_values_match_brute_force(spark):
    """Hot ties, a null group, a constant score, a constant label, one row; below and beyond one bucket."""
    groups = {"hot": [(float(k % 7 == 0) * k, float(k * 37 % 11)) for k in range(200)], "flat": [(3.0, float(k)) for k in range(30)],
              None: [(float(-k), float(k * k % 17)) for k in range(50)], "still": [(float(k), 1.0) for k in range(30)], "one": [(1.0, 2.0)]}
    rows = [(g, i, x, y) for g, xs in groups.items() for i, (x, y) in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, vopenid long, score double, actual double")
    before = spark.conf.get("valuescope.rank.bucketRows", "2000000")
    for rows_per_bucket in ("2000000", "9"):
        spark.conf.set("valuescope.rank.bucketRows", rows_per_bucket)
        try:
            got = {r["g"]: r for r in rank_agreement(df, "g").collect()}
            ranked = {r["g"]: r for r in mid_rank_values(mid_ranks(df, "actual", "ra", group="g", centred=True), "score", "rs", group="g", **rank_sums("ra"))
                      .groupBy("g").agg(F.sum("_c").alias("n"), rank_correlation("rs").alias("rho")).collect()}
        finally:
            spark.conf.set("valuescope.rank.bucketRows", before)
        assert set(got) == set(groups)
        for g, xs in groups.items():
            want = _rho([x for x, _ in xs], [y for _, y in xs])
            for have in (got[g]["spearman"], ranked[g]["rho"]):
                assert have is None if want is None else abs(have - want) < 1e-12, g
            assert ranked[g]["n"] == len(xs)
            pos, neg = [x for x, y in xs if y > 0], [x for x, y in xs if y <= 0]
            auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
            assert got[g]["auc"] is None if auc is None else abs(got[g]["auc"] - auc) < 1e-12, g
    assert rank_agreement(df.limit(0), "g").count() == 0
