"""Model jobs: feature groups, splits by class, seeds and lift against the scored frame."""

import pytest
from pyspark.sql import functions as F

from valuescope.operators import ml

from .conftest import MEDIUM, SMALL


@pytest.fixture(scope="module", autouse=True)
def small_models():
    """Few trees: the tests look at what is done with scores, not at their quality."""
    keep = ml.GBT_TREES, ml.CHURN_TREES, ml.pltv_pipeline.__defaults__
    ml.CHURN_TREES = 5
    ml.pltv_pipeline.__defaults__ = (5, *keep[2][1:])
    ml._MODELS.clear()
    ml._CHURN.clear()
    yield
    ml.GBT_TREES, ml.CHURN_TREES, ml.pltv_pipeline.__defaults__ = keep
    ml._MODELS.clear()
    ml._CHURN.clear()


def test_feature_groups():
    numeric, categories = ml.feature_columns(("login", "attribution"))
    assert numeric == ml.LOGIN and categories == ml.ATTRIBUTION
    with pytest.raises(ValueError, match="music"):
        ml.feature_columns(("music",))


def test_a_model_uses_only_its_groups(spark):
    _, model = ml._train(spark, MEDIUM, groups=("login",))
    assert model.stages[-1].numFeatures == len(ml.LOGIN)


def test_no_mature_cohort_raises(spark):
    with pytest.raises(ValueError, match="no train cohort"):
        ml._train(spark, MEDIUM, maturity_days=100_000)


@pytest.mark.parametrize("name", ["pltv_train_score", "pltv_top_users", "model_incremental_late", "seed_strategies_model", "seed_weekly_model",
                                  "feature_importance", "model_scorecard", "model_vs_heuristics", "model_metadata"])
def test_jobs_are_empty_without_a_mature_cohort(spark, registry, name):
    few, some = registry[name].fn(spark, SMALL), registry[name].fn(spark, MEDIUM)
    assert few.count() == 0 and some.count() > 0
    assert few.dtypes == some.dtypes


def test_each_class_is_split_alike(spark):
    s = ml._churn_model(spark, MEDIUM)
    got = {r["low_growth"]: (r["n"], r["t"]) for r in s.groupBy("low_growth").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == n * 20 // 100 for n, t in got.values()) and len(got) == 2
    fitted = len(ml._CHURN)
    ml.churn_revenue_at_risk(spark, MEDIUM).count()
    ml.churn_train_score(spark, MEDIUM).count()
    assert len(ml._CHURN) == fitted == 1


def test_top_users_are_the_best_scores(spark):
    x, model = ml._train(spark, MEDIUM)
    scores = sorted(((-r["pred"], r["vopenid"]) for r in ml._predicted(model, x).select("pred", "vopenid").collect()))
    got = [r["vopenid"] for r in ml.pltv_top_users(spark, MEDIUM, 10).orderBy("rank").collect()]
    assert got == [u for _, u in scores[:max(1, len(scores) * 10 // 100)]]


def test_model_seeds_agree_with_the_scored_frame(spark):
    import numpy as np
    x, model = ml._train(spark, MEDIUM)
    p = ml._predicted(model, x).select("rev_d7", "ltv30", "pred", F.date_trunc("week", "install_date").cast("date").alias("week")).toPandas()
    p["rev_d7"] = p.rev_d7.astype(float)
    zero = p[p.rev_d7 == 0]
    got = {r["strategy"]: r for r in ml.seed_strategies_model(spark, MEDIUM).collect()}
    assert len(got) == len(ml.MODEL_TOP)
    for k in ml.MODEL_TOP:
        own = p[(p.rev_d7 > 0) | (p.pred >= zero.pred.quantile(1 - k / 100))]
        r = got[f"+ Top {k}% pLTV"]
        assert r["seed_size"] == len(own) and abs(r["total_revenue"] - own.ltv30.sum()) < 1e-3
        t = p.ltv30.quantile(0.9)
        whales = p[(p.ltv30 > 0) & (p.ltv30 >= t)]
        assert abs(r["whale_capture"] - len(own[(own.ltv30 > 0) & (own.ltv30 >= t)]) / len(whales)) < 1e-6
    weekly = {r["week"]: r["seed_size"] for r in ml.seed_weekly_model(spark, MEDIUM, 2).collect()}
    for week, w in p.groupby("week"):
        if len(w) < 2:
            continue
        z = w[w.rev_d7 == 0].pred
        cut = z.quantile(0.95) if len(z) else np.inf
        assert weekly.get(week, 0) == len(w[(w.rev_d7 > 0) | ((w.rev_d7 == 0) & (w.pred >= cut))])


def test_model_lift_in_the_segment_without_early_revenue(spark):
    got = ml.model_incremental_late(spark, MEDIUM).collect()
    assert {r["strategy"] for r in got} == {"model"} and len(got) == 15
    assert all(abs(r["lift_pct"] - (r["capture_pct"] - r["heuristic_pct"])) < 1e-4 for r in got)
    assert {r["verdict"] for r in got} <= {"meaningful", "moderate", "limited"}
