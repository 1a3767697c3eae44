"""Two-group contrasts, engagement lift, churn segments, drift.

Every contrast is a conditional mean in one aggregate over the mart
(``avg(when(group_a, x))``), unpivoted to long form — no per-feature loop of
jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, round_doubles
from ..functions.ranking import cutoff_values
from ..plans.mart import user_mart
from ..twins import with_mart
from .cohorts import _ma, _r
from .evaluation import group_metrics, score_frame, with_label_rank
from ..twins import pearson as sql_pearson
from .evaluation import _sql_scores
from .temporal import PERIOD_SQL, _periods

CONTRAST_FEATS = ["games_d7", "active_days_d7", "login_rows_d7", "loginchannel_variety_d7", "win_rate_d7", "kd_d7",
                  "kills_d7", "deaths_d7", "avg_game_duration_d7", "max_level_game_d7", "rev_d7", "txn_cnt_d7"]
MONEY_FEATS = {"rev_d7"}

# contrast name → (population filter, group A condition, group B condition), SQL and Spark forms
CONTRASTS_SQL = {
    "late_vs_non_payer": ("rev_d7 = 0", "ltv30 > 0", "ltv30 = 0"),
    "whale_vs_rest": ("TRUE", "ltv30 > 0 AND ltv30 >= q.p95", "NOT (ltv30 > 0 AND ltv30 >= q.p95)"),
    "payer_vs_non_payer": ("TRUE", "ltv30 > 0", "ltv30 <= 0"),
    "retained_vs_churned": ("rev_d7 > 0", "ltv30 > c.med", "ltv30 <= c.med"),
}


def _spark_contrasts(p95: float, med: float):
    v, r = F.col("ltv30"), F.col("rev_d7")
    whale = (v > 0) & (v >= F.lit(p95))
    return {
        "late_vs_non_payer": (r == 0, v > 0, v == 0),
        "whale_vs_rest": (F.lit(True), whale, ~whale),
        "payer_vs_non_payer": (F.lit(True), v > 0, v <= 0),
        "retained_vs_churned": (r > 0, v > F.lit(med), v <= F.lit(med)),
    }


def _mean_sql(f, cond):
    if f in MONEY_FEATS:
        return _ma(f"CASE WHEN {cond} THEN {f} END")
    return f"AVG(CASE WHEN {cond} THEN {f} END)"


def _contrast_sql():
    parts = []
    for name, (pop, a, b) in CONTRASTS_SQL.items():
        for f in CONTRAST_FEATS:
            ma, mb = _mean_sql(f, f"({pop}) AND ({a})"), _mean_sql(f, f"({pop}) AND ({b})")
            parts.append(f"SELECT '{name}' AS contrast, '{f}' AS feature, {_r(ma, 'mean_a')}, {_r(mb, 'mean_b')}, "
                         f"{_r(f'{ma} / NULLIF({mb}, 0.0)', 'ratio')}, {_r(f'{ma} - {mb}', 'diff')} FROM mart, q, c")
    return " UNION ALL ".join(parts)


Q_CTES = ("q AS (SELECT quantile_cont(ltv30, 0.95) AS p95 FROM mart), "
          "c AS (SELECT quantile_cont(ltv30, 0.5) AS med FROM mart WHERE rev_d7 > 0)")


@job("feature_contrast", sql=with_mart(_contrast_sql(), Q_CTES))
def feature_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature means of two groups, ratio and difference, for four contrasts (late vs non-payer among
    D7 non-payers, whale vs rest, payer vs non-payer, retained vs low-growth D7 payers)."""
    m = user_mart(spark, sf_dir)
    p95 = cutoff_values(m, "ltv30", {"p": 0.95})["p"]
    med = cutoff_values(m, "ltv30", {"m": 0.5}, where=F.col("rev_d7") > 0)["m"]
    aggs, items = [], []
    for name, (pop, a, b) in _spark_contrasts(p95, med).items():
        for f in CONTRAST_FEATS:
            ca, cb = f"{name}__{f}__a", f"{name}__{f}__b"
            xa, xb = F.when(pop & a, F.col(f)), F.when(pop & b, F.col(f))
            if f in MONEY_FEATS:
                aggs += [money_avg(xa).alias(ca), money_avg(xb).alias(cb)]
            else:
                aggs += [F.avg(xa).alias(ca), F.avg(xb).alias(cb)]
            items.append(F.struct(F.lit(name).alias("contrast"), F.lit(f).alias("feature"),
                                  F.col(ca).alias("mean_a"), F.col(cb).alias("mean_b")))
    wide = m.agg(*aggs)
    long = wide.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    return round_doubles(long.select(
        "contrast", "feature", "mean_a", "mean_b",
        F.try_divide(F.col("mean_a"), F.nullif("mean_b", F.lit(0.0))).alias("ratio"),
        (F.col("mean_a") - F.col("mean_b")).alias("diff")))


@job("engagement_lift", sql=with_mart("""
, z AS (SELECT * FROM mart WHERE rev_d7 = 0), md AS (SELECT quantile_cont(games_d7, 0.5) AS med FROM z),
g AS (SELECT AVG(CASE WHEN games_d7 > md.med THEN CASE WHEN ltv30 > 0 THEN 1.0 ELSE 0.0 END END) AS high_conv,
             AVG(CASE WHEN games_d7 <= md.med THEN CASE WHEN ltv30 > 0 THEN 1.0 ELSE 0.0 END END) AS low_conv,
             COUNT(CASE WHEN games_d7 > md.med THEN 1 END) AS high_users, COUNT(CASE WHEN games_d7 <= md.med THEN 1 END) AS low_users,
             MIN(md.med) AS median_games FROM z, md)
SELECT ROUND(median_games, 6) AS median_games, high_users, low_users, ROUND(high_conv, 6) AS high_conv,
  ROUND(low_conv, 6) AS low_conv, ROUND(high_conv / NULLIF(low_conv, 0.0), 6) AS lift FROM g"""))
def engagement_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late conversion of D7 non-payers above vs at-or-below the median games played."""
    z = user_mart(spark, sf_dir).where(F.col("rev_d7") == 0)
    med = cutoff_values(z, "games_d7", {"m": 0.5})["m"]
    conv = F.when(F.col("ltv30") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    hi = F.col("games_d7") > F.lit(med)
    lo = F.col("games_d7") <= F.lit(med)
    g = z.agg(F.avg(F.when(hi, conv)).alias("high_conv"), F.avg(F.when(lo, conv)).alias("low_conv"),
              count_if(hi).alias("high_users"), count_if(lo).alias("low_users"))
    return round_doubles(g.select(F.lit(med).cast("double").alias("median_games"), "high_users", "low_users",
                                  "high_conv", "low_conv",
                                  F.try_divide(F.col("high_conv"), F.nullif("low_conv", F.lit(0.0))).alias("lift")))


# ---------------------------------------------------------------- A23
CHURN_SEGS = ["Low Payer", "Mid Payer", "High Payer", "Whale"]
CHURN_SQL = ("q AS (SELECT quantile_cont(ltv30, 0.95) AS p95 FROM mart), "
             "c AS (SELECT quantile_cont(ltv30, 0.5) AS med FROM mart WHERE rev_d7 > 0), "
             "p AS (SELECT mart.*, CAST(ltv30 <= c.med AS INTEGER) AS low_growth, CASE WHEN ltv30 <= 0 THEN 'Low Payer' "
             "WHEN ltv30 <= c.med THEN 'Mid Payer' WHEN ltv30 <= q.p95 THEN 'High Payer' ELSE 'Whale' END AS payer_seg "
             "FROM mart, q, c WHERE rev_d7 > 0)")


def _churn_frame(spark, sf_dir):
    m = user_mart(spark, sf_dir)
    p95 = cutoff_values(m, "ltv30", {"p": 0.95})["p"]
    p = m.where(F.col("rev_d7") > 0)
    med = cutoff_values(p, "ltv30", {"m": 0.5})["m"]
    v = F.col("ltv30")
    seg = (F.when(v <= 0, "Low Payer").when(v <= F.lit(med), "Mid Payer").when(v <= F.lit(p95), "High Payer")
           .otherwise("Whale"))
    return p.withColumn("low_growth", (v <= F.lit(med)).cast("int")).withColumn("payer_seg", seg)


@job("churn_segments", sql=with_mart(f"""
SELECT payer_seg, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')}, {_r(_ma('rev_d7'), 'avg_rev_d7')},
  {_r('AVG(low_growth) * 100.0', 'low_growth_rate_pct')}
FROM p GROUP BY payer_seg""", CHURN_SQL))
def churn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 payers by value segment (explicit ladder on the payer median and the p95 of all users) with
    the low-growth ('churn') rate = share with ltv at or below the payer median."""
    p = _churn_frame(spark, sf_dir)
    return round_doubles(p.groupBy("payer_seg").agg(
        F.count(F.lit(1)).alias("users"), money_avg("ltv30").alias("avg_ltv"), money_avg("rev_d7").alias("avg_rev_d7"),
        (F.avg("low_growth") * 100.0).alias("low_growth_rate_pct")))


@job("churn_by_txn", sql=with_mart(f"""
SELECT txn_cnt_d7, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')}, {_r('AVG(low_growth) * 100.0', 'low_growth_rate_pct')}
FROM p GROUP BY txn_cnt_d7""", CHURN_SQL))
def churn_by_txn(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Low-growth rate of D7 payers by number of D7 transactions (up to ``most`` where given)."""
    p = _churn_frame(spark, sf_dir)
    if most is not None:
        p = p.where(F.col("txn_cnt_d7") <= most)
    return round_doubles(p.groupBy("txn_cnt_d7").agg(
        F.count(F.lit(1)).alias("users"), money_avg("ltv30").alias("avg_ltv"),
        (F.avg("low_growth") * 100.0).alias("low_growth_rate_pct")))


# ---------------------------------------------------------------- E12
DRIFT_TOL = 0.05


DRIFT_SQL = with_mart(f"""
, ps AS (SELECT sc.*, per.period FROM sc JOIN per ON per.vopenid = sc.vopenid),
r2 AS (SELECT period, strategy, ROW_NUMBER() OVER (PARTITION BY period, strategy ORDER BY score DESC, vopenid) AS rn,
         CAST(SUM(CAST(actual AS DECIMAL(18,2))) OVER (PARTITION BY period, strategy ORDER BY score DESC, vopenid
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum,
         COUNT(*) OVER (PARTITION BY period, strategy) AS n,
         CAST(SUM(CAST(actual AS DECIMAL(18,2))) OVER (PARTITION BY period, strategy) AS DOUBLE) AS total,
         RANK() OVER (PARTITION BY period, strategy ORDER BY score) + (COUNT(*) OVER (PARTITION BY period, strategy, score) - 1) / 2.0 AS rs,
         RANK() OVER (PARTITION BY period, strategy ORDER BY actual) + (COUNT(*) OVER (PARTITION BY period, strategy, actual) - 1) / 2.0 AS ra
       FROM ps),
g AS (SELECT period, strategy,
        MAX(CASE WHEN rn = GREATEST(1, CAST((n * 100) // 1000 AS BIGINT)) THEN cum END) * 100.0 / NULLIF(MAX(total), 0.0) / 100.0 AS lift,
        {sql_pearson('rs', 'ra')} AS sp FROM r2 GROUP BY period, strategy)
SELECT e.strategy, ROUND(e.lift, 6) AS lift_early, ROUND(l.lift, 6) AS lift_late, ROUND(l.lift - e.lift, 6) AS lift_delta,
  ROUND(e.sp, 6) AS spearman_early, ROUND(l.sp, 6) AS spearman_late, ROUND(l.sp - e.sp, 6) AS spearman_delta,
  CASE WHEN ABS(l.lift - e.lift) <= {DRIFT_TOL} AND ABS(l.sp - e.sp) <= {DRIFT_TOL} THEN 'stable' ELSE 'drift' END AS verdict
FROM g e JOIN g l ON l.strategy = e.strategy AND e.period = 'early' AND l.period = 'late'""",
                      PERIOD_SQL.strip() + "," + _sql_scores())


@job("metric_drift", sql=DRIFT_SQL)
def metric_drift(spark: SparkSession, sf_dir: str, tol: float = DRIFT_TOL) -> DataFrame:
    """Lift@10 (as a fraction) and Spearman per strategy for the early and late half of install dates;
    'stable' when both move by at most ±0.05."""
    x = with_label_rank(_periods(spark, sf_dir), group="period")
    sc = score_frame(x, keep=["period", "ra"]).withColumn("grp", F.concat_ws("|", "period", "strategy"))
    g = group_metrics(sc, "grp").select(F.split("grp", "[|]").getItem(0).alias("period"),
                                        F.split("grp", "[|]").getItem(1).alias("strategy"),
                                        (F.col("lift_at_10") / 100.0).alias("lift"), "spearman")
    e = g.where(F.col("period") == "early").select("strategy", F.col("lift").alias("lift_early"),
                                                   F.col("spearman").alias("spearman_early"))
    lt = g.where(F.col("period") == "late").select("strategy", F.col("lift").alias("lift_late"),
                                                   F.col("spearman").alias("spearman_late"))
    j = e.join(lt, "strategy")
    dl = F.col("lift_late") - F.col("lift_early")
    ds = F.col("spearman_late") - F.col("spearman_early")
    verdict = F.when((F.abs(dl) <= tol) & (F.abs(ds) <= tol), "stable").otherwise("drift")
    return round_doubles(j.select("strategy", "lift_early", "lift_late", dl.alias("lift_delta"), "spearman_early",
                                  "spearman_late", ds.alias("spearman_delta"), verdict.alias("verdict")))

