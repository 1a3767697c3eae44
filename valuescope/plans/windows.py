"""the multi-window mart (one row per user and window D1/D3/D5/D7).

Stand-in (FIXTURES.md B3): user = events.user_id, d0 = day of the first
event, window w = events in [d0, d0 + w days), label = purchase value in
[d0, d0 + 30 days). Events are pre-aggregated to (user, day, type) first;
d0 is a window ``min`` over those bounded per-user rows; the four windows
are conditional aggregates of ONE grouped pass and are then stacked, so the
log is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import MONEY
from ..sources.tables import read_table

WINDOWS = [1, 3, 5, 7]
LABEL_DAYS_EVENTS = 30
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]
WINDOW_FEATURES = ["n_events", "active_days", "type_variety", "n_click", "n_view", "n_purchase", "n_signup",
                   "n_error", "rev", "prop_k_sum"]


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("double")
    return (e.groupBy(F.col("user_id"), F.to_date("ts").alias("d"), F.col("event_type"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast(MONEY)).alias("v"),
                 F.sum(k).alias("k")))


def build_window_mart(spark: SparkSession, sf_dir: str, windows=WINDOWS,
                      label_days: int = LABEL_DAYS_EVENTS) -> DataFrame:
    daily = events_daily(spark, sf_dir)
    x = daily.withColumn("d0", F.min("d").over(Window.partitionBy("user_id"))) \
        .withColumn("off", F.datediff("d", "d0"))
    aggs = []
    for w in windows:
        inw = F.col("off") < w
        aggs += [
            F.coalesce(F.sum(F.when(inw, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n_events_{w}"),
            F.size(F.collect_set(F.when(inw, F.col("d")))).cast("bigint").alias(f"active_days_{w}"),
            F.size(F.collect_set(F.when(inw, F.col("event_type")))).cast("bigint").alias(f"type_variety_{w}"),
            *[F.coalesce(F.sum(F.when(inw & (F.col("event_type") == t), F.col("n"))), F.lit(0)).cast("bigint")
              .alias(f"n_{t}_{w}") for t in EVENT_TYPES],
            F.coalesce(F.sum(F.when(inw & (F.col("event_type") == "purchase"), F.col("v"))), F.lit(0))
            .cast("double").alias(f"rev_{w}"),
            F.coalesce(F.sum(F.when(inw, F.col("k"))), F.lit(0.0)).alias(f"prop_k_sum_{w}"),
        ]
    lab = (F.col("off") < label_days) & (F.col("event_type") == "purchase")
    aggs.append(F.coalesce(F.sum(F.when(lab, F.col("v"))), F.lit(0)).cast("double").alias("ltv30"))
    wide = x.groupBy("user_id", "d0").agg(*aggs)
    rows = [F.struct(F.lit(w).alias("window_days"), *[F.col(f"{f}_{w}").alias(f) for f in WINDOW_FEATURES])
            for w in windows]
    return wide.select("user_id", "d0", "ltv30", F.explode(F.array(*rows)).alias("r")).select(
        "user_id", "d0", "r.window_days", *[f"r.{f}" for f in WINDOW_FEATURES], "ltv30")


WINDOW_MART_SQL = f"""
ed AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(18,2))) AS v,
         SUM(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k FROM events GROUP BY 1, 2, 3),
eo AS (SELECT ed.*, MIN(d) OVER (PARTITION BY user_id) AS d0,
         date_diff('day', MIN(d) OVER (PARTITION BY user_id), d) AS off FROM ed),
ww AS (SELECT unnest({WINDOWS}) AS window_days),
wm AS (SELECT eo.user_id, eo.d0, ww.window_days,
    CAST(COALESCE(SUM(CASE WHEN off < window_days THEN n END), 0) AS BIGINT) AS n_events,
    COUNT(DISTINCT CASE WHEN off < window_days THEN d END) AS active_days,
    COUNT(DISTINCT CASE WHEN off < window_days THEN event_type END) AS type_variety,
    {', '.join(f"CAST(COALESCE(SUM(CASE WHEN off < window_days AND event_type = '{t}' THEN n END), 0) AS BIGINT) AS n_{t}"
               for t in EVENT_TYPES)},
    CAST(COALESCE(SUM(CASE WHEN off < window_days AND event_type = 'purchase' THEN v END), 0) AS DOUBLE) AS rev,
    COALESCE(SUM(CASE WHEN off < window_days THEN k END), 0.0) AS prop_k_sum,
    CAST(COALESCE(SUM(CASE WHEN off < {LABEL_DAYS_EVENTS} AND event_type = 'purchase' THEN v END), 0) AS DOUBLE) AS ltv30
  FROM eo, ww GROUP BY eo.user_id, eo.d0, ww.window_days)"""


def window_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 mart, materialised once per application (see ``plans.mart.materialized``)."""
    from .mart import materialized
    return materialized(spark, "window_mart", sf_dir, ("events",), (LABEL_DAYS_EVENTS,),
                        lambda: build_window_mart(spark, sf_dir))
