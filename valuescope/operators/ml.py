"""Model jobs as Spark ML pipelines.

Categorical columns are indexed once inside the pipeline
(``StringIndexer(handleInvalid="keep")``), so train and score share codes.
The target is log1p(ltv) with squared error and predictions are always
mapped back with expm1. Splits are the hash splits of ``splits.py``.
Tree models are not bit-comparable with another library, so these jobs are
checked by row count and invariants (tests), not by a SQL twin.
"""

from __future__ import annotations

import functools
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, money_sum, round_doubles
from ..functions.ranking import cutoff_values, global_rank, group_quantiles
from ..plans.mart import FILE_ROWS, _source_fingerprint, user_mart
from ..plans.windows import WINDOW_FEATURES, WINDOWS, window_mart
from ..session import ensure_checkpoint_dir
from .splits import MATURITY_DAYS, _dump, assign_roles, user_hash

# Feature groups of the reference (payment, gameplay, login, attribution),
# restricted to the columns these tables provide.
PAYMENT = ["rev_d7", "txn_cnt_d7", "first_charge_day_offset_d7"]
GAMEPLAY = ["games_d7", "win_rate_d7", "avg_game_duration_d7", "avg_score_d7", "kills_d7", "deaths_d7", "kd_d7",
            "max_level_game_d7"]
LOGIN = ["login_rows_d7", "active_days_d7", "loginchannel_variety_d7"]
ATTRIBUTION = ["media_source", "first_country_code", "first_os"]
NUMERIC = PAYMENT + GAMEPLAY + LOGIN
GROUPS = {"payment": PAYMENT, "gameplay": GAMEPLAY, "login": LOGIN, "attribution": ATTRIBUTION}

# Model sizes of the reference.
GBT_TREES, GBT_DEPTH, GBT_STEP = 200, 6, 0.05
CHURN_TREES, CHURN_DEPTH, CHURN_STEP = 100, 4, 0.1
WINDOW_TREES, WINDOW_DEPTH, WINDOW_STEP = 150, 5, 0.08
SUBSAMPLE = 0.8  # of the churn and window models
SEED = 42
BINS = 32        # of a continuous feature; more where a categorical column has more labels


def _prepared(m: DataFrame) -> DataFrame:
    """Numeric features with the −1 sentinel for the nullable offset (inside ML only), log1p label."""
    return m.withColumn("first_charge_day_offset_d7", F.coalesce(F.col("first_charge_day_offset_d7"), F.lit(-1))) \
        .withColumn("label", F.log1p(F.greatest(F.col("ltv30"), F.lit(0.0))))


def feature_columns(groups=tuple(GROUPS)) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of the chosen feature groups."""
    unknown = [g for g in groups if g not in GROUPS]
    if unknown or not groups:
        raise ValueError(f"feature groups are {sorted(GROUPS)}, not {unknown}")
    cols = [c for g in GROUPS if g in groups for c in GROUPS[g]]
    return [c for c in cols if c not in ATTRIBUTION], [c for c in cols if c in ATTRIBUTION]


def pltv_pipeline(trees: int = GBT_TREES, depth: int = GBT_DEPTH, step: float = GBT_STEP,
                  bins: int = BINS, groups=tuple(GROUPS)) -> Pipeline:
    numeric, categories = feature_columns(groups)
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categories]
    vec = VectorAssembler(inputCols=numeric + [f"{c}_idx" for c in categories], outputCol="features",
                          handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step,
                       seed=SEED, checkpointInterval=10, maxBins=bins)
    return Pipeline(stages=idx + [vec, gbt])


class NoCohort(ValueError):
    """No cohort is old enough to learn from."""


def or_empty(schema: str):
    """A job that gives an empty frame of ``schema`` where there is no mature cohort: no scores, rather than those of a
    model of another population."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, *a, **k) -> DataFrame:
            try:
                return fn(spark, *a, **k)
            except NoCohort:
                return spark.createDataFrame([], schema)
        return run
    return deco


_MODELS: dict = {}
#: Training rows up to which the layout of the scan is kept, and rows of a task beyond it.
KEPT_ROWS, TASK_ROWS = 20_000, 100_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt by user over tasks of at most about TASK_ROWS rows, at least one a core: a tree is grown in many
    short passes over the rows, each as slow as its largest task."""
    if rows <= KEPT_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), "vopenid")


def _saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: what several passes read is worked out once."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _train(spark, sf_dir, maturity_days=MATURITY_DAYS, groups=tuple(GROUPS)):
    """Fit the pLTV pipeline once per application, input and feature groups (reused by the scoring jobs).
    Without a mature cohort there is nothing to learn from: this raises, and no other population is taken."""
    m = user_mart(spark, sf_dir)
    x = _prepared(assign_roles(m, _dump(m), maturity_days))
    key = (spark.sparkContext.applicationId, _source_fingerprint(spark, sf_dir), maturity_days, tuple(sorted(groups)))
    if key not in _MODELS:
        train = x.where(F.col("role") == "train")
        if train.isEmpty():
            raise NoCohort(f"no train cohort is {maturity_days} days old")
        categories = feature_columns(groups)[1]
        labels = train.agg(F.lit(0), *[F.count_distinct(c) for c in categories]).first()
        pipeline = pltv_pipeline(bins=max(BINS, *labels) + 1, groups=groups)  # one more for unseen labels
        _MODELS[key] = pipeline.fit(spread(train, train.count()))
    return x, _MODELS[key]


def _predicted(model, x: DataFrame) -> DataFrame:
    return model.transform(x).withColumn("pred", F.greatest(F.expm1("prediction"), F.lit(0.0)))


@job("pltv_train_score", sql=None)
@or_empty("vopenid bigint, role string, predicted_ltv30 double, ltv30 double")
def pltv_train_score(spark: SparkSession, sf_dir: str, save: bool = True, groups=tuple(GROUPS)) -> DataFrame:
    """Train on the mature train split with the chosen feature groups, score every user (expm1 of the log
    prediction). The fitted PipelineModel is saved under the shared checkpoint folder (M6)."""
    x, model = _train(spark, sf_dir, groups=groups)
    if save:
        model.write().overwrite().save(f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/pltv_gbt")
    s = model.transform(x)
    return round_doubles(s.select("vopenid", "role", F.greatest(F.expm1(F.col("prediction")), F.lit(0.0)).alias("predicted_ltv30"), "ltv30"))


@job("pltv_top_users", sql=None)
@or_empty("rank bigint, vopenid bigint, role string, media_source string, rev_d7 double, predicted_ltv30 double, "
          "ltv30 double")
def pltv_top_users(spark: SparkSession, sf_dir: str, top_pct: int = 1) -> DataFrame:
    """L2: the top 1 % of all users by predicted value, ranked (the percentage is the feature)."""
    x, model = _train(spark, sf_dir)
    r = global_rank(_predicted(model, x).select("vopenid", "role", "media_source", "rev_d7", "ltv30", "pred"), "pred", desc=True)
    k = max(1, (r.n * top_pct) // 100)
    return round_doubles(r.df.where(F.col("rn") <= k).select(
        F.col("rn").alias("rank"), "vopenid", "role", "media_source", "rev_d7", F.col("pred").alias("predicted_ltv30"), "ltv30"))


@job("model_incremental_late", sql=None)
@or_empty("strategy string, heuristic string, k_pct double, capture_pct double, heuristic_pct double, "
          "lift_pct double, incremental_revenue double, verdict string")
def model_incremental_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with the trained model: among held-out users without D7 revenue, the model against each heuristic at 0.5, 1 and
    5 %, with the 3 % / 1 % verdict."""
    from .evaluation import evaluate_scores, incremental_lift, score_frame
    x, model = _train(spark, sf_dir)
    test = x.where((F.col("role") == "test") & (F.col("rev_d7") == 0))
    pred = _predicted(model, test).select(F.lit("model").alias("strategy"), "vopenid", F.col("pred").alias("score"), F.col("ltv30").alias("actual"))
    pred = _saved(pred, "late-scores")
    return round_doubles(incremental_lift(*evaluate_scores(score_frame(test).unionByName(pred)), ["model"]))


MODEL_TOP = [1, 5, 10]


def _seed_rows(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Size, value and whale capture of the seed rows (keys, ltv30, whale, whales)."""
    return seeds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seed_size"), money_avg("ltv30").alias("avg_ltv"),
        (count_if(F.col("ltv30") > 0).cast("double") / F.count(F.lit(1))).alias("payer_rate"), money_sum("ltv30").alias("total_revenue"),
        F.try_divide(count_if(F.col("whale")).cast("double"), F.nullif(F.max("whales").cast("double"), F.lit(0.0))).alias("whale_capture"))


@job("seed_strategies_model", sql=None)
@or_empty("strategy string, seed_size bigint, avg_ltv double, payer_rate double, total_revenue double, "
          "whale_capture double")
def seed_strategies_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with the model: D7 payers and the top 1, 5 and 10 % of the others by predicted value (whale = p90 of all users)."""
    x, model = _train(spark, sf_dir)
    s = _saved(_predicted(model, x).select("vopenid", "rev_d7", "ltv30", "pred"), "seed-scores")
    t = cutoff_values(s, "ltv30", {"t": 0.9})["t"]
    s = s.withColumn("whale", (F.col("ltv30") > 0) & (F.col("ltv30") >= F.lit(t)))
    cuts = cutoff_values(s, "pred", {str(k): 1 - k / 100 for k in MODEL_TOP}, where=F.col("rev_d7") == 0)
    whales = s.where("whale").count()
    chosen = F.array(*[F.when((F.col("rev_d7") > 0) | (F.col("pred") >= F.lit(cuts[str(k)])), F.lit(f"+ Top {k}% pLTV")) for k in MODEL_TOP])
    seeds = s.select("ltv30", "whale", F.lit(whales).alias("whales"), F.explode(F.array_compact(chosen)).alias("strategy"))
    return round_doubles(_seed_rows(seeds, ["strategy"]))


@job("seed_weekly_model", sql=None)
@or_empty("week date, strategy string, seed_size bigint, avg_ltv double, payer_rate double, total_revenue double, "
          "whale_capture double")
def seed_weekly_model(spark: SparkSession, sf_dir: str, min_users: int = 10) -> DataFrame:
    """G2 with the model: per install week, D7 payers and the top 5 % of the others by predicted value (whale = p90 of the week)."""
    x, model = _train(spark, sf_dir)
    s = _predicted(model, x).select("vopenid", "rev_d7", "ltv30", "pred", F.date_trunc("week", "install_date").cast("date").alias("week"))
    s = s.withColumn("pred_zero", F.when(F.col("rev_d7") == 0, F.col("pred")))
    wk = s.groupBy("week").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_users)
    wk = wk.join(group_quantiles(s, "week", "ltv30", {"wt": 0.9}), "week", "left") \
        .join(group_quantiles(s, "week", "pred_zero", {"pt": 0.95}), "week", "left")
    s = s.join(wk, "week").withColumn("whale", (F.col("ltv30") > 0) & (F.col("ltv30") >= F.col("wt")))
    whales = s.groupBy("week").agg(count_if(F.col("whale")).alias("whales"))
    seeds = s.where((F.col("rev_d7") > 0) | (F.col("pred_zero") >= F.col("pt"))).join(whales, "week").withColumn("strategy", F.lit("+ Top 5% pLTV"))
    return round_doubles(_seed_rows(seeds, ["week", "strategy"]))


@job("model_metadata", sql=None)
@or_empty("model_type string, dataset_size bigint, n_features int, features array<string>, numeric_features array<string>, "
          "categorical_features array<string>, feature_importances map<string,double>, hyperparameters map<string,string>")
def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: one metadata row for the fitted pLTV model (type, rows, features, importances, hyper-parameters)."""
    x, model = _train(spark, sf_dir)
    gbt = model.stages[-1]
    names = NUMERIC + [f"{c}_idx" for c in ATTRIBUTION]
    imp = {n: float(v) for n, v in zip(names, gbt.featureImportances.toArray())}
    hp = {"maxIter": str(gbt.getOrDefault("maxIter")), "maxDepth": str(gbt.getOrDefault("maxDepth")),
          "stepSize": str(gbt.getOrDefault("stepSize")), "seed": str(gbt.getOrDefault("seed"))}
    n_train = x.where(F.col("role") == "train").count()
    return spark.createDataFrame(
        [("GBTRegressor(log1p)", n_train, len(names), names, NUMERIC, ATTRIBUTION, imp, hp)],
        "model_type string, dataset_size bigint, n_features int, features array<string>, "
        "numeric_features array<string>, categorical_features array<string>, "
        "feature_importances map<string,double>, hyperparameters map<string,string>")


@job("feature_importance", sql=None)
@or_empty("feature string, importance double, rank int")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: ranked feature importances of the pLTV model."""
    _, model = _train(spark, sf_dir)
    gbt = model.stages[-1]
    names = NUMERIC + [f"{c}_idx" for c in ATTRIBUTION]
    rows = [(n, float(v)) for n, v in zip(names, gbt.featureImportances.toArray())]
    df = spark.createDataFrame(rows, "feature string, importance double")  # one row per feature
    return round_doubles(df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(),
                                                                                  "feature"))))


@job("model_scorecard", sql=None)
@or_empty("grp string, lift_at_10 double, users bigint, spearman double, rmse double, r2 double")
def model_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 for the trained model on the held-out test split: Spearman, Lift@10, RMSE, R²."""
    x, model = _train(spark, sf_dir)
    test = x.where(F.col("role") == "test")
    s = _saved(_predicted(model, test).select("vopenid", "pred", "ltv30"), "scorecard")
    return round_doubles(_regression_metrics(s, "pred", "ltv30"))


def _regression_metrics(s: DataFrame, pred: str, actual: str, group: str | None = None) -> DataFrame:
    from .evaluation import group_metrics
    g = [group] if group else []
    base = s.select(*g, "vopenid", F.col(pred).alias("score"), F.col(actual).alias("actual"))
    if not group:
        base = base.withColumn("grp", F.lit("all"))
        group = "grp"
    gm = group_metrics(base, group)
    err = base.groupBy(group).agg(
        F.sqrt(F.avg((F.col("score") - F.col("actual")) ** 2)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum((F.col("actual") - F.col("score")) ** 2),
                                   F.nullif(F.count(F.lit(1)) * F.var_pop("actual"), F.lit(0.0)))).alias("r2"))
    return gm.join(err, group)


# ---------------------------------------------------------------- L4 / A24

_CHURN: dict = {}


def stratified_test(x: DataFrame, label: str, share: int = 20) -> DataFrame:
    """With ``is_test``: exactly ``share`` percent (rounded down) of each class, by the order of the user hash."""
    r = global_rank(x.withColumn("_h", user_hash().cast("double")), "_h", desc=False, group=label)
    most = r.counts.select(F.col(label).alias("_l"), F.floor(F.col("c") * share / 100).alias("_k"))  # a row a class
    return r.df.join(F.broadcast(most), F.col(label) == F.col("_l")).withColumn("is_test", F.col("rn") <= F.col("_k")).drop("_h", "_l", "_k", "rn")


def _churn_model(spark, sf_dir):
    """Scored D7 payers; the classifier is fitted once per application and input."""
    m = user_mart(spark, sf_dir).where(F.col("rev_d7") > 0)
    med = cutoff_values(m, "ltv30", {"m": 0.5})["m"]
    x = stratified_test(_prepared(m).withColumn("low_growth", (F.col("ltv30") <= F.lit(med)).cast("double")), "low_growth")
    key = (spark.sparkContext.applicationId, _source_fingerprint(spark, sf_dir))
    rows = m.count()
    if rows > KEPT_ROWS:
        x = _saved(x, "churn")  # the fit and the scores read it many times
    if key not in _CHURN:
        vec = VectorAssembler(inputCols=NUMERIC, outputCol="features", handleInvalid="keep")
        clf = GBTClassifier(featuresCol="features", labelCol="low_growth", maxIter=CHURN_TREES, maxDepth=CHURN_DEPTH,
                            stepSize=CHURN_STEP, subsamplingRate=SUBSAMPLE, seed=SEED, checkpointInterval=10)
        _CHURN[key] = Pipeline(stages=[vec, clf]).fit(spread(x.where(~F.col("is_test")), rows))
    return _CHURN[key].transform(x).withColumn("churn_score", vector_to_array("probability")[1])


@job("churn_train_score", sql=None)
def churn_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: low-growth classifier on D7 payers — AUC, precision, recall on the held-out users."""
    s = _churn_model(spark, sf_dir)
    t = s.where(F.col("is_test"))
    auc = BinaryClassificationEvaluator(labelCol="low_growth", rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC").evaluate(t)
    tp = count_if((F.col("prediction") == 1) & (F.col("low_growth") == 1))
    return round_doubles(t.agg(
        F.count(F.lit(1)).alias("test_users"), F.lit(auc).alias("auc"),
        F.try_divide(tp.cast("double"), F.nullif(count_if(F.col("prediction") == 1).cast("double"), F.lit(0.0)))
        .alias("precision"),
        F.try_divide(tp.cast("double"), F.nullif(count_if(F.col("low_growth") == 1).cast("double"), F.lit(0.0)))
        .alias("recall")))


@job("churn_revenue_at_risk", sql=None)
def churn_revenue_at_risk(spark: SparkSession, sf_dir: str, bins: int = 10) -> DataFrame:
    """D7 payers by churn-score bucket (10 equal-width bins on [0, 1]): users, revenue, share."""
    s = _churn_model(spark, sf_dir)
    b = F.least(F.floor(F.col("churn_score") * bins), F.lit(bins - 1)).cast("int")
    g = s.groupBy(b.alias("score_bin")).agg(F.count(F.lit(1)).alias("users"), money_sum("ltv30").alias("revenue"))
    return round_doubles(g.withColumn("revenue_share_pct", F.try_divide(
        F.col("revenue") * 100.0, F.nullif(F.sum("revenue").over(Window.partitionBy()), F.lit(0.0)))))


# ---------------------------------------------------------------- L5 / E14

@job("window_scores", sql=None)
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per window D1/D3/D5/D7 on the same hash-held-out users; Spearman, Lift@10, RMSE,
    R² and retention of each metric relative to D7."""
    w = window_mart(spark, sf_dir).withColumn("is_test", F.pmod(user_hash("user_id"), F.lit(100)) >= 80) \
        .withColumn("label", F.log1p("ltv30"))
    def fit_score(d):
        part = w.where(F.col("window_days") == d)
        vec = VectorAssembler(inputCols=WINDOW_FEATURES, outputCol="features")
        gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=WINDOW_TREES, maxDepth=WINDOW_DEPTH,
                           stepSize=WINDOW_STEP, subsamplingRate=SUBSAMPLE, seed=SEED, checkpointInterval=10)
        model = Pipeline(stages=[vec, gbt]).fit(part.where(~F.col("is_test")))
        return model.transform(part.where(F.col("is_test"))).select(
            F.col("window_days").cast("string").alias("grp"), F.col("user_id").alias("vopenid"),
            F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("pred"), "ltv30")
    # four independent fits submitted from driver threads: Spark runs their jobs concurrently
    with ThreadPoolExecutor(max_workers=len(WINDOWS)) as pool:
        parts = list(pool.map(fit_score, WINDOWS))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    met = _regression_metrics(scored, "pred", "ltv30", group="grp")
    base = met.where(F.col("grp") == str(max(WINDOWS))).first()
    bl, bs = (base["lift_at_10"], base["spearman"]) if base else (None, None)
    return round_doubles(met.select(
        F.col("grp").cast("int").alias("window_days"), "users", "spearman", "lift_at_10", "rmse", "r2",
        (F.try_divide(F.col("spearman"), F.nullif(F.lit(bs).cast("double"), F.lit(0.0))) * 100.0)
        .alias("spearman_retention_pct"),
        (F.try_divide(F.col("lift_at_10"), F.nullif(F.lit(bl).cast("double"), F.lit(0.0))) * 100.0)
        .alias("lift_retention_pct")))


# ---------------------------------------------------------------- L6 / L7 / J8 / L8
CLUSTER_FEATS = ["games_d7", "active_days_d7", "win_rate_d7", "kd_d7", "login_rows_d7"]
K = 4


def _clustered(spark, sf_dir):
    m = user_mart(spark, sf_dir)
    vec = VectorAssembler(inputCols=CLUSTER_FEATS, outputCol="raw")
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    km = KMeans(k=K, seed=SEED, featuresCol="features", predictionCol="cluster", maxIter=50)
    model = Pipeline(stages=[vec, sc, km]).fit(m)
    return m, model.transform(m), model


@job("behaviour_clusters", sql=None)
def behaviour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means (k=4) on standardised engagement features; per-cluster value and rule-based labels
    relative to the median cluster."""
    m, s, _ = _clustered(spark, sf_dir)
    p95 = cutoff_values(m, "ltv30", {"p": 0.95})["p"]
    g = s.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("users"), money_avg("ltv30").alias("avg_ltv30"),
        F.avg((F.col("ltv30") > 0).cast("double")).alias("payer_rate"),
        F.avg(((F.col("ltv30") > 0) & (F.col("ltv30") >= F.lit(p95))).cast("double")).alias("whale_rate"),
        money_sum("ltv30").alias("total_ltv30"), *[F.avg(c).alias(f"avg_{c}") for c in CLUSTER_FEATS])
    w = Window.partitionBy()  # k = 4 cluster rows
    med = {c: F.percentile(c, 0.5).over(w) for c in ("avg_games_d7", "avg_win_rate_d7", "avg_active_days_d7",
                                                      "whale_rate")}
    traits = F.array_compact(F.array(
        F.when(F.col("avg_games_d7") > med["avg_games_d7"] * 1.3, F.lit("High-Activity"))
        .when(F.col("avg_games_d7") < med["avg_games_d7"] * 0.5, F.lit("Low-Activity")),
        F.when(F.col("avg_win_rate_d7") > med["avg_win_rate_d7"] * 1.2, F.lit("Skilled")),
        F.when(F.col("avg_active_days_d7") > med["avg_active_days_d7"] * 1.3, F.lit("Engaged")),
        F.when(F.col("whale_rate") > med["whale_rate"] * 2, F.lit("Whale-Rich"))))
    label = F.when(F.size(traits) == 0, F.lit("Average")).otherwise(F.concat_ws(" / ", F.slice(traits, 1, 2)))
    g = g.withColumn("cluster_label", label).withColumn(
        "rev_share_pct", F.try_divide(F.col("total_ltv30") * 100.0, F.nullif(F.sum("total_ltv30").over(w), F.lit(0.0))))
    return round_doubles(g)


@job("pca_projection", sql=None)
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D PCA of the standardised engagement features for every user, with explained variance."""
    m = user_mart(spark, sf_dir)
    vec = VectorAssembler(inputCols=CLUSTER_FEATS, outputCol="raw")
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    pca = PCA(k=2, inputCol="features", outputCol="pc")
    model = Pipeline(stages=[vec, sc, pca]).fit(m)
    ev = model.stages[-1].explainedVariance.toArray()
    s = model.transform(m).withColumn("pc_arr", vector_to_array("pc"))
    return round_doubles(s.select("vopenid", F.col("pc_arr")[0].alias("pc1"), F.col("pc_arr")[1].alias("pc2"),
                                  F.lit(float(ev[0])).alias("explained_var_pc1"),
                                  F.lit(float(ev[1])).alias("explained_var_pc2"), "ltv30"))


MODEL_K10 = [10, 30, 50, 100]  # 1 %, 3 %, 5 %, 10 %


@job("model_vs_heuristics", sql=None)
@or_empty("strategy string, k_pct int, capture_pct double, model_gain_pct double, model_incremental_revenue double")
def model_vs_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2/E3 with the trained model: capture of the top K% on held-out users for the model, the five
    heuristics, random and the oracle, plus each strategy's capture and revenue gap to the model."""
    from .evaluation import _at_positions, evaluate_scores, score_frame
    x, model = _train(spark, sf_dir)
    test = x.where(F.col("role") == "test")
    pred = model.transform(test).select(
        F.lit("model").alias("strategy"), "vopenid",
        F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("score"), F.col("ltv30").alias("actual"))
    sc = score_frame(test).unionByName(pred)
    r, st = evaluate_scores(sc)
    cap = _at_positions(r, st, MODEL_K10).select(
        "strategy", "k10", F.col("cum").alias("rev"),
        F.try_divide(F.col("cum") * 100.0, F.nullif("total", F.lit(0.0))).alias("capture_pct"))
    mdl = cap.where(F.col("strategy") == "model").select("k10", F.col("rev").alias("mrev"),
                                                         F.col("capture_pct").alias("mcap"))
    j = cap.join(mdl, "k10")  # ≤ #K rows on the model side
    return round_doubles(j.select(
        "strategy", (F.col("k10") / 10).cast("int").alias("k_pct"), "capture_pct",
        (F.col("mcap") - F.col("capture_pct")).alias("model_gain_pct"),
        (F.col("mrev") - F.col("rev")).alias("model_incremental_revenue")))
