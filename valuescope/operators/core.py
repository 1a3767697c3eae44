"""Minimum slice and mart-level jobs: late-payer segments (P1/A2), mart, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_sum, round_doubles
from ..plans import mart as M
from ..twins import with_mart

# Fixed values taken from the reference (chat analyses): a whale is a user
# with ltv30 >= 323000 (VND) in the fixed-cutoff flows.
WHALE_LTV_FIXED = 323000.0

SEGMENT_D7 = "D7 Payer"
SEGMENT_LATE = "Late Payer (D8-D30)"
SEGMENT_NON = "Non-Payer"


def payer_segment(rev="rev_d7", ltv="ltv30"):
    """Three-way segment."""
    r, l = F.col(rev), F.col(ltv)
    return (F.when(r > 0, F.lit(SEGMENT_D7))
            .when((r == 0) & (l > 0), F.lit(SEGMENT_LATE))
            .otherwise(F.lit(SEGMENT_NON)))


SEGMENT_SQL = (f"CASE WHEN rev_d7 > 0 THEN '{SEGMENT_D7}' WHEN rev_d7 = 0 AND ltv30 > 0 THEN '{SEGMENT_LATE}' "
               f"ELSE '{SEGMENT_NON}' END")


@job("late_payer_segments", sql=with_mart(f"""
SELECT {SEGMENT_SQL} AS segment, COUNT(*) AS users,
       ROUND(CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE), 6) AS total_revenue,
       ROUND(CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS avg_ltv,
       COUNT(CASE WHEN ltv30 >= {WHALE_LTV_FIXED} THEN 1 END) AS whale_count
FROM mart GROUP BY 1"""))
def late_payer_segments(spark: SparkSession, sf_dir: str, whale_cutoff: float = WHALE_LTV_FIXED) -> DataFrame:
    m = M.user_mart(spark, sf_dir)
    return round_doubles(m.groupBy(payer_segment().alias("segment")).agg(
        F.count(F.lit(1)).alias("users"),
        money_sum("ltv30").alias("total_revenue"),
        (money_sum("ltv30") / F.count(F.lit(1))).alias("avg_ltv"),
        count_if(F.col("ltv30") >= whale_cutoff).alias("whale_count")))


@job("late_payer_summary", sql=with_mart(f"""
SELECT
  COUNT(CASE WHEN seg = '{SEGMENT_LATE}' THEN 1 END) AS late_users,
  ROUND(CAST(COUNT(CASE WHEN seg = '{SEGMENT_LATE}' THEN 1 END) AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE), 6) AS late_user_pct,
  ROUND(COALESCE(CAST(SUM(CASE WHEN seg = '{SEGMENT_LATE}' THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0), 6) AS late_revenue,
  ROUND(COALESCE(CAST(SUM(CASE WHEN seg = '{SEGMENT_LATE}' THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) * 100.0
        / NULLIF(COALESCE(CAST(SUM(CASE WHEN seg <> '{SEGMENT_NON}' THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0), 0.0), 6) AS late_revenue_pct,
  COUNT(CASE WHEN seg = '{SEGMENT_LATE}' AND ltv30 > 0 AND ltv30 >= {WHALE_LTV_FIXED} THEN 1 END) AS late_whales,
  ROUND(CAST(COUNT(CASE WHEN seg = '{SEGMENT_LATE}' AND ltv30 > 0 AND ltv30 >= {WHALE_LTV_FIXED} THEN 1 END) AS DOUBLE) * 100.0
        / NULLIF(CAST(COUNT(CASE WHEN ltv30 > 0 AND ltv30 >= {WHALE_LTV_FIXED} THEN 1 END) AS DOUBLE), 0.0), 6) AS late_whale_pct,
  ROUND(COALESCE(CAST(SUM(CASE WHEN seg <> '{SEGMENT_NON}' THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0)
        / NULLIF(COALESCE(CAST(SUM(CASE WHEN seg = '{SEGMENT_D7}' THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0), 0.0), 6) AS d30_over_d7
FROM (SELECT *, {SEGMENT_SQL} AS seg FROM mart) t"""))
def late_payer_summary(spark: SparkSession, sf_dir: str, whale_cutoff: float = WHALE_LTV_FIXED) -> DataFrame:
    """A2: late-payer economics in one row (shares of users, revenue, whales)."""
    m = M.user_mart(spark, sf_dir).withColumn("seg", payer_segment())
    late = F.col("seg") == SEGMENT_LATE
    payer = F.col("seg") != SEGMENT_NON
    whale = (F.col("ltv30") > 0) & (F.col("ltv30") >= whale_cutoff)

    def rev(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("ltv30").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))

    def nz(c):
        return F.nullif(c, F.lit(0.0))

    late_users = count_if(late)
    late_whales = count_if(late & whale)
    return round_doubles(m.agg(
        late_users.alias("late_users"),
        F.try_divide(late_users.cast("double") * 100.0, F.count(F.lit(1)).cast("double")).alias("late_user_pct"),
        rev(late).alias("late_revenue"),
        F.try_divide(rev(late) * 100.0, nz(rev(payer))).alias("late_revenue_pct"),
        late_whales.alias("late_whales"),
        F.try_divide(late_whales.cast("double") * 100.0, nz(count_if(whale).cast("double"))).alias("late_whale_pct"),
        F.try_divide(rev(payer), nz(rev(F.col("seg") == SEGMENT_D7))).alias("d30_over_d7")))


MART_ROUNDED = ", ".join(
    f"ROUND({c}, 6) AS {c}" if c in {"win_rate_d7", "avg_game_duration_d7", "avg_score_d7", "kills_d7", "kd_d7",
                                     "rev_d7", "ltv30"} else c
    for c in M.MART_COLUMNS)


@job("user_mart", sql=with_mart(f"SELECT {MART_ROUNDED} FROM mart"), family="mart")
def user_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full feature mart, built from raw logs (not materialised)."""
    return M.user_mart_query(spark, sf_dir)


@job("derived_flags", sql=with_mart("""
SELECT vopenid, CAST(rev_d7 > 0 AS INTEGER) AS is_payer_d7,
       CAST(rev_d7 = 0 AND ltv30 > 0 AS INTEGER) AS is_late_payer,
       ROUND(ltv30 - rev_d7, 6) AS rev_after_d7,
       dayname(install_date) AS install_dayname,
       CAST(dayofmonth(install_date) AS INTEGER) AS install_day_of_month
FROM mart"""), family="mart")
def derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.derived_flags(spark, sf_dir)


@job("role_pairs", sql="SELECT DISTINCT o_custkey AS vopenid, o_orderkey AS roleid FROM orders", family="mart")
def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.role_pairs(spark, sf_dir)


@job("cohort_first_seen", sql="""
SELECT o_custkey AS vopenid, MIN(CAST(o_orderdate AS DATE)) AS install_date,
       arg_min(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS roleid
FROM orders GROUP BY o_custkey""", family="mart")
def cohort_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cohort_first_seen(spark, sf_dir)


@job("attrib_latest", sql="""
SELECT o_custkey AS vopenid, MAX(o_orderdate) AS last_seen_ts,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_orderkey,
       arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority
FROM orders GROUP BY o_custkey""", family="mart")
def attrib_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.attrib_latest(spark, sf_dir)


VIP = "1-URGENT"  # stand-in for the channel of VIP logins


@job("mart_login_v1", sql=with_mart(f"""
, lw AS (SELECT coh.vopenid, coh.install_date, MAX(od.d) AS last_d, COUNT(*) AS login_rows,
           MAX(CASE WHEN od.prio = '{VIP}' THEN 1 ELSE 0 END) AS has_vip
         FROM coh JOIN od ON od.vopenid = coh.vopenid AND od.d < coh.install_date + {M.FEAT_DAYS} GROUP BY 1, 2)
SELECT vopenid, CAST(install_date + {M.FEAT_DAYS - 1} AS DATE) AS asof_day,
  CAST({M.FEAT_DAYS - 1} - date_diff('day', install_date, last_d) AS INTEGER) AS days_since_last_login,
  CAST(date_diff('day', install_date, last_d) AS INTEGER) AS last_login_offset, login_rows, has_vip
FROM lw"""), family="mart")
def mart_login_v1(spark: SparkSession, sf_dir: str, feat_days: int = M.FEAT_DAYS) -> DataFrame:
    """v1 login extras — as-of day of the window, days since the last login inside it, a VIP login in the window."""
    daily = M.orders_daily(spark, sf_dir)
    from pyspark.sql import Window
    x = daily.withColumn("install_date", F.min("d").over(Window.partitionBy("vopenid"))) \
        .where(F.col("d") < F.date_add("install_date", feat_days))
    g = x.groupBy("vopenid", "install_date").agg(F.max("d").alias("last_d"), F.sum("n_rows").alias("login_rows"),
                                              F.max(F.when(F.col("prio") == VIP, 1).otherwise(0)).alias("has_vip"))
    off = F.datediff("last_d", "install_date")
    return g.select("vopenid", F.date_add("install_date", feat_days - 1).alias("asof_day"),
                    (F.lit(feat_days - 1) - off).cast("int").alias("days_since_last_login"),
                    off.cast("int").alias("last_login_offset"), F.col("login_rows").cast("bigint").alias("login_rows"), "has_vip")


LAKE_DAYS = 180


@job("lake_scan_bounds", sql=f"""
WITH b AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo FROM orders)
SELECT CAST(o_orderdate AS DATE) AS ds, COUNT(*) AS orders,
  ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS amount
FROM orders, b WHERE CAST(o_orderdate AS DATE) >= b.lo AND CAST(o_orderdate AS DATE) < b.lo + {LAKE_DAYS}
GROUP BY 1""", family="mart")
def lake_scan_bounds(spark: SparkSession, sf_dir: str, days: int = LAKE_DAYS) -> DataFrame:
    """The first days of the log by a range on its raw timestamp, compared with row-group statistics in the scan;
    on a log that is partitioned by time the same call also skips folders (``Lake``)."""
    import datetime as dt

    from ..sources.tables import SCHEMAS, Lake, read_table, table_path
    lo = read_table(spark, sf_dir, "orders", ["o_orderdate"]).agg(F.min("o_orderdate")).first()[0]
    log = Lake(table_path(sf_dir, "orders"), "o_orderdate", schema=SCHEMAS["orders"])
    lo = lo.date() if lo else dt.date(1970, 1, 1)
    x = log.between(spark, lo, lo + dt.timedelta(days=days)).select(F.to_date("o_orderdate").alias("ds"), "o_totalprice")
    return round_doubles(x.groupBy("ds").agg(F.count(F.lit(1)).alias("orders"),
                                             money_sum("o_totalprice").alias("amount")))


@job("game_features_bucketed", sql=with_mart("""
SELECT vopenid, CAST(g_games AS BIGINT) AS games, CAST(g_wins AS BIGINT) AS wins, ROUND(CAST(g_score AS DOUBLE), 6) AS score,
  g_lines AS lines, g_maxline AS maxline FROM gfe"""), family="mart")
def game_features_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gameplay features over logs that are bucketed by order key; the join of the two logs needs no exchange."""
    g = M.game_features(spark, sf_dir, M.order_features(spark, sf_dir), read=M.bucketed_logs(spark, sf_dir))
    return round_doubles(g.select("vopenid", F.col("g_games").alias("games"), F.col("g_wins").alias("wins"),
                                  F.col("g_score").cast("double").alias("score"), F.col("g_lines").alias("lines"), F.col("g_maxline").alias("maxline")))


@job("payer_orders_filtered", sql=with_mart("""
SELECT CAST(l.l_shipdate AS DATE) AS day, COUNT(*) AS games, COUNT(DISTINCT l.l_orderkey) AS orders
FROM lineitem l WHERE l.l_orderkey IN (SELECT roleid FROM mart WHERE rev_d7 > 0) GROUP BY 1"""), family="mart")
def payer_orders_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gameplay of the first orders of D7 payers: a semi-join on a long key list, with a Bloom filter of the keys before the shuffle."""
    from ..functions.bloom import filtered_semi_join
    from ..sources.tables import read_table
    keys = M.user_mart(spark, sf_dir).where("rev_d7 > 0").select(F.col("roleid").alias("l_orderkey"))
    li = filtered_semi_join(read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"]), keys, "l_orderkey")
    per = li.groupBy(F.to_date("l_shipdate").alias("day"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("day").agg(F.sum("n").alias("games"), F.count(F.lit(1)).alias("orders"))
