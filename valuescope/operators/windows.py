"""Multi-window mart jobs and early-window ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import round_doubles
from ..plans.windows import WINDOW_FEATURES, WINDOW_MART_SQL, WINDOWS, build_window_mart, window_mart
from .evaluation import group_metrics

SELECT_COLS = ", ".join(["user_id", "d0", "window_days"] + [f if f not in ("rev", "prop_k_sum") else
                                                           f"ROUND({f}, 6) AS {f}" for f in WINDOW_FEATURES]
                        + ["ROUND(ltv30, 6) AS ltv30"])


@job("mart_windows", sql=f"WITH {WINDOW_MART_SQL.strip()}\nSELECT {SELECT_COLS} FROM wm", family="windows")
def mart_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per (user, window_days ∈ {1,3,5,7}) with un-suffixed features and the 30-day label."""
    return round_doubles(build_window_mart(spark, sf_dir))


@job("window_purchasers", sql=f"""WITH {WINDOW_MART_SQL.strip()}
SELECT window_days, COUNT(*) AS users, COUNT(CASE WHEN n_purchase > 0 THEN 1 END) AS purchasers,
  ROUND(CAST(SUM(CAST(rev AS DECIMAL(18,2))) AS DOUBLE), 6) AS revenue,
  ROUND(CAST(SUM(CAST(rev AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE), 0.0), 6)
    AS share_of_label
FROM wm GROUP BY window_days""", family="windows")
def window_purchasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchasers and revenue visible at each checkpoint window, as a share of the 30-day label."""
    w = window_mart(spark, sf_dir)
    from ..functions.exprs import money_sum
    return round_doubles(w.groupBy("window_days").agg(
        F.count(F.lit(1)).alias("users"), F.count(F.when(F.col("n_purchase") > 0, 1)).alias("purchasers"),
        money_sum("rev").alias("revenue"),
        F.try_divide(money_sum("rev"), F.nullif(money_sum("ltv30"), F.lit(0.0))).alias("share_of_label")))


RET_SQL = f"""WITH {WINDOW_MART_SQL.strip()},
r2 AS (SELECT window_days, rev, ltv30, user_id,
         ROW_NUMBER() OVER (PARTITION BY window_days ORDER BY rev DESC, user_id) AS rn,
         CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) OVER (PARTITION BY window_days ORDER BY rev DESC, user_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum,
         COUNT(*) OVER (PARTITION BY window_days) AS n,
         CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) OVER (PARTITION BY window_days) AS DOUBLE) AS total,
         RANK() OVER (PARTITION BY window_days ORDER BY rev) + (COUNT(*) OVER (PARTITION BY window_days, rev) - 1) / 2.0 AS rs,
         RANK() OVER (PARTITION BY window_days ORDER BY ltv30) + (COUNT(*) OVER (PARTITION BY window_days, ltv30) - 1) / 2.0 AS ra
       FROM wm),
g AS (SELECT window_days, COUNT(*) AS users,
        MAX(CASE WHEN rn = GREATEST(1, CAST((n * 100) // 1000 AS BIGINT)) THEN cum END) * 100.0 / NULLIF(MAX(total), 0.0) AS lift,
        COVAR_POP(rs, ra) / NULLIF(STDDEV_POP(rs) * STDDEV_POP(ra), 0.0) AS sp FROM r2 GROUP BY window_days)
SELECT g.window_days, g.users, ROUND(g.lift, 6) AS lift_at_10, ROUND(g.sp, 6) AS spearman,
  ROUND(g.lift / NULLIF(b.lift, 0.0) * 100.0, 6) AS lift_retention_pct,
  ROUND(g.sp / NULLIF(b.sp, 0.0) * 100.0, 6) AS spearman_retention_pct
FROM g JOIN g b ON b.window_days = {max(WINDOWS)}"""


@job("window_retention", sql=RET_SQL, family="windows")
def window_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking quality of window revenue at D1/D3/D5/D7 (Lift@10, Spearman) and its share of the D7 value."""
    w = window_mart(spark, sf_dir)
    sc = w.select(F.col("window_days").cast("string").alias("grp"), F.col("user_id").alias("vopenid"),
                  F.col("rev").alias("score"), F.col("ltv30").alias("actual"))
    g = group_metrics(sc, "grp").withColumn("window_days", F.col("grp").cast("int"))
    b = g.where(F.col("window_days") == max(WINDOWS)).first()  # one row: the D7 baseline
    bl, bs = (b["lift_at_10"], b["spearman"]) if b else (None, None)
    return round_doubles(g.select(
        "window_days", "users", "lift_at_10", "spearman",
        F.try_divide(F.col("lift_at_10"), F.nullif(F.lit(bl).cast("double"), F.lit(0.0))) * 100.0,
        F.try_divide(F.col("spearman"), F.nullif(F.lit(bs).cast("double"), F.lit(0.0))) * 100.0)
        .toDF("window_days", "users", "lift_at_10", "spearman", "lift_retention_pct", "spearman_retention_pct"))


@job("event_props", sql="""
SELECT event_type, COUNT(*) AS events, COUNT(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS with_k,
  ROUND(AVG(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS avg_k,
  MIN(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS min_k,
  MAX(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k
FROM events GROUP BY event_type""", family="windows")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.14 JSON: typed event properties parsed with ``from_json`` (bad values become null)."""
    from pyspark.sql import types as T

    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "events", ["event_type", "props"])
    p = e.withColumn("p", F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]),
                                      {"mode": "PERMISSIVE"}))
    return round_doubles(p.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("p.k").alias("with_k"), F.avg("p.k").alias("avg_k"),
        F.min("p.k").alias("min_k"), F.max("p.k").alias("max_k")))
