"""Install-day cohort series.

The daily frame has one row per install day, so every window over it
(running totals, trims, trends) is bounded by the calendar, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, money_sum, pct, round_doubles
from ..functions.ranking import cutoff_values, group_quantiles
from ..functions.tails import sql_t_two_sided, t_two_sided
from ..plans.mart import LABEL_DAYS, user_mart
from ..sources.tables import read_table
from ..twins import with_mart
from .cohorts import _ci, _ma, _ms, _pct, _r


def _n():
    return F.count(F.lit(1))


def as_of_date(spark: SparkSession, sf_dir: str):
    """Dump date = last order date in the data (explicit, not 'today')."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate"])
    return o.agg(F.max(F.to_date("o_orderdate"))).first()[0]


AS_OF_SQL = "dump AS (SELECT MAX(CAST(o_orderdate AS DATE)) AS as_of FROM orders)"

DAILY_SQL = f"""
, d0 AS (SELECT install_date, COUNT(*) AS users,
    CAST(COUNT(CASE WHEN is_payer_30 = 1 THEN 1 END) AS DOUBLE) / COUNT(*) AS payer_rate_d30,
    CAST(COUNT(CASE WHEN rev_d7 > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS payer_rate_d7,
    CAST(COUNT(CASE WHEN rev_d7 = 0 AND ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS late_payer_rate,
    {_ma('ltv30')} AS mean_ltv30, quantile_cont(ltv30, 0.5) AS median_ltv30,
    {_ms('ltv30')} AS total_ltv30, {_ms('rev_d7')} AS total_rev_d7,
    AVG(games_d7) AS mean_games, AVG(active_days_d7) AS mean_active_days, AVG(login_rows_d7) AS mean_logins,
    AVG(kd_d7) AS mean_kd
  FROM mart GROUP BY install_date),
daily AS (SELECT d0.*, total_ltv30 / users AS arpu_d30, total_rev_d7 / users AS arpu_d7,
    CASE WHEN total_ltv30 > 0 THEN total_rev_d7 / total_ltv30 ELSE 0.0 END AS d7_d30_ratio,
    dayname(install_date) AS install_dow,
    CAST(date_diff('day', install_date, dump.as_of) AS INTEGER) AS days_since_install
  FROM d0, dump)"""


def daily_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per install day (A6), before maturity masking."""
    m = user_mart(spark, sf_dir)
    as_of = as_of_date(spark, sf_dir)
    d = m.groupBy("install_date").agg(
        _n().alias("users"),
        (count_if(F.col("is_payer_30") == 1).cast("double") / _n()).alias("payer_rate_d30"),
        (count_if(F.col("rev_d7") > 0).cast("double") / _n()).alias("payer_rate_d7"),
        (count_if((F.col("rev_d7") == 0) & (F.col("ltv30") > 0)).cast("double") / _n()).alias("late_payer_rate"),
        money_avg("ltv30").alias("mean_ltv30"),
        money_sum("ltv30").alias("total_ltv30"), money_sum("rev_d7").alias("total_rev_d7"),
        F.avg("games_d7").alias("mean_games"), F.avg("active_days_d7").alias("mean_active_days"),
        F.avg("login_rows_d7").alias("mean_logins"), F.avg("kd_d7").alias("mean_kd"))
    # exact per-day median, one row per install day, joined on the day
    d = d.join(group_quantiles(m, "install_date", "ltv30", {"median_ltv30": 0.5}), "install_date", "left")
    return d.select(
        "*", (F.col("total_ltv30") / F.col("users")).alias("arpu_d30"),
        (F.col("total_rev_d7") / F.col("users")).alias("arpu_d7"),
        F.when(F.col("total_ltv30") > 0, F.col("total_rev_d7") / F.col("total_ltv30")).otherwise(0.0)
        .alias("d7_d30_ratio"),
        F.date_format("install_date", "EEEE").alias("install_dow"),
        F.datediff(F.lit(as_of), F.col("install_date")).alias("days_since_install"))


MATURE_NULLED = ["arpu_d30", "mean_ltv30", "median_ltv30", "total_ltv30", "payer_rate_d30", "late_payer_rate",
                 "d7_d30_ratio"]
DAILY_COLS = ["install_date", "users", "payer_rate_d30", "payer_rate_d7", "late_payer_rate", "mean_ltv30",
              "median_ltv30", "total_ltv30", "total_rev_d7", "mean_games", "mean_active_days", "mean_logins",
              "mean_kd", "arpu_d30", "arpu_d7", "d7_d30_ratio", "install_dow", "days_since_install"]


def _daily_out_sql(maturity):
    out = []
    for c in DAILY_COLS:
        if c in MATURE_NULLED:
            out.append(_r(f"CASE WHEN days_since_install >= {maturity} THEN {c} END", c))
        elif c in ("install_date", "users", "install_dow", "days_since_install"):
            out.append(c)
        else:
            out.append(_r(c, c))
    return ", ".join(out) + f", CAST(days_since_install >= {maturity} AS INTEGER) AS d30_mature"


@job("temporal_daily", sql=with_mart(f"SELECT {_daily_out_sql(LABEL_DAYS)} FROM daily", AS_OF_SQL + DAILY_SQL))
def temporal_daily(spark: SparkSession, sf_dir: str, maturity_days: int = LABEL_DAYS) -> DataFrame:
    """A6 + P18: daily cohort metrics; label metrics nulled for cohorts younger than the label window."""
    d = daily_frame(spark, sf_dir)
    mature = F.col("days_since_install") >= maturity_days
    d = d.withColumns({c: F.when(mature, F.col(c)) for c in MATURE_NULLED})
    return round_doubles(d.withColumn("d30_mature", mature.cast("int")))


@job("temporal_cumulative", sql=with_mart(f"""
SELECT install_date, CAST(SUM(users) OVER w AS BIGINT) AS cum_users,
  {_r('SUM(CAST(total_ltv30 AS DECIMAL(18,2))) OVER w', 'cum_ltv30')},
  {_r('SUM(CAST(total_rev_d7 AS DECIMAL(18,2))) OVER w', 'cum_rev_d7')}
FROM daily WINDOW w AS (ORDER BY install_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                                             AS_OF_SQL + DAILY_SQL))
def temporal_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by install day (window over ≤ #days rows)."""
    d = daily_frame(spark, sf_dir)
    w = Window.orderBy("install_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return round_doubles(d.select(
        "install_date", F.sum("users").over(w).cast("bigint").alias("cum_users"),
        F.sum(F.col("total_ltv30").cast("decimal(18,2)")).over(w).cast("double").alias("cum_ltv30"),
        F.sum(F.col("total_rev_d7").cast("decimal(18,2)")).over(w).cast("double").alias("cum_rev_d7")))


@job("dow_pattern", sql=with_mart(f"""
, ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY install_date) AS rn_up,
                   ROW_NUMBER() OVER (ORDER BY install_date DESC) AS rn_down FROM daily)
SELECT 'all' AS variant, install_dow, {_r('AVG(users)', 'avg_users')}, {_r('AVG(payer_rate_d30)', 'avg_payer_rate')},
  {_r('AVG(arpu_d30)', 'avg_arpu')} FROM ranked GROUP BY install_dow
UNION ALL
SELECT 'trimmed' AS variant, install_dow, {_r('AVG(users)', 'avg_users')}, {_r('AVG(payer_rate_d30)', 'avg_payer_rate')},
  {_r('AVG(arpu_d30)', 'avg_arpu')} FROM ranked WHERE rn_up > 1 AND rn_down > 1 GROUP BY install_dow""",
                                     AS_OF_SQL + DAILY_SQL))
def dow_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-of-week means of daily metrics; 'trimmed' drops the first and last day."""
    d = daily_frame(spark, sf_dir)
    d = d.withColumn("rn_up", F.row_number().over(Window.orderBy("install_date"))) \
        .withColumn("rn_down", F.row_number().over(Window.orderBy(F.col("install_date").desc())))

    def agg(x, name):
        return x.groupBy("install_dow").agg(F.avg("users").alias("avg_users"),
                                            F.avg("payer_rate_d30").alias("avg_payer_rate"),
                                            F.avg("arpu_d30").alias("avg_arpu")).select(F.lit(name).alias("variant"),
                                                                                         "*")
    out = agg(d, "all").unionByName(agg(d.where((F.col("rn_up") > 1) & (F.col("rn_down") > 1)), "trimmed"))
    return round_doubles(out)


TREND_METRICS = ["arpu_d30", "payer_rate_d30", "late_payer_rate", "mean_games", "d7_d30_ratio"]


@job("cohort_trend", sql=with_mart("SELECT metric, n, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("slope", "intercept", "r2")) + ", "
                                   "ROUND(t, 6) AS t_stat, ROUND(" + sql_t_two_sided("t", "(n - 2.0)") + ", 6) AS p_value FROM ("
                                   "SELECT *, SIGN(slope) * SQRT(r2 * (n - 2) / NULLIF(1.0 - r2, 0.0)) AS t FROM ("
                                   + " UNION ALL ".join(f"""
SELECT '{mt}' AS metric, COUNT({mt}) AS n, regr_slope({mt}, x) AS slope, regr_intercept({mt}, x) AS intercept, regr_r2({mt}, x) AS r2
FROM (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY install_date) - 1 AS DOUBLE) AS x FROM daily) t""" for mt in TREND_METRICS) + ") v) w",
                                   AS_OF_SQL + DAILY_SQL))
def cohort_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear trend of daily metrics over the cohort index: slope, intercept, R², t and two-sided p-value of the
    slope. ``n`` counts the days that have the metric."""
    d = daily_frame(spark, sf_dir).withColumn(
        "x", (F.row_number().over(Window.orderBy("install_date")) - 1).cast("double"))
    long = d.select("x", *[F.col(c).cast("double").alias(c) for c in TREND_METRICS]) \
        .unpivot(["x"], TREND_METRICS, "metric", "y")
    g = long.groupBy("metric").agg(
        F.count("y").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    t = F.sign("slope") * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2.0), F.nullif(1.0 - F.col("r2"), F.lit(0.0))))
    return round_doubles(g.withColumn("t_stat", t).withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("n") - 2)))


@job("temporal_stability", sql=with_mart(f"""
SELECT COUNT(*) AS n_days, {_r('AVG(payer_rate_d30)', 'payer_rate_mean')},
  {_r('STDDEV_SAMP(payer_rate_d30)', 'payer_rate_std')},
  {_r('STDDEV_SAMP(payer_rate_d30) / NULLIF(AVG(payer_rate_d30), 0.0)', 'payer_rate_cv')},
  {_r('AVG(late_payer_rate)', 'late_rate_mean')}, {_r('STDDEV_SAMP(late_payer_rate)', 'late_rate_std')},
  {_r('AVG(d7_d30_ratio)', 'avg_d7_d30_ratio')}
FROM daily""", AS_OF_SQL + DAILY_SQL))
def temporal_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, std and coefficient of variation of daily rates."""
    d = daily_frame(spark, sf_dir)
    return round_doubles(d.agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("payer_rate_d30").alias("payer_rate_mean"),
        F.stddev_samp("payer_rate_d30").alias("payer_rate_std"),
        F.try_divide(F.stddev_samp("payer_rate_d30"), F.nullif(F.avg("payer_rate_d30"), F.lit(0.0)))
        .alias("payer_rate_cv"),
        F.avg("late_payer_rate").alias("late_rate_mean"), F.stddev_samp("late_payer_rate").alias("late_rate_std"),
        F.avg("d7_d30_ratio").alias("avg_d7_d30_ratio")))


@job("temporal_extremes", sql=with_mart("""
SELECT MIN(install_date) AS first_day, MAX(install_date) AS last_day,
  arg_min(users, install_date) AS first_day_users, arg_max(users, install_date) AS last_day_users,
  ROUND(CAST(arg_max(users, install_date) - arg_min(users, install_date) AS DOUBLE)
        / NULLIF(CAST(arg_min(users, install_date) AS DOUBLE), 0.0), 6) AS volume_change,
  arg_max(install_date, (users, -epoch(install_date))) AS peak_users_day,
  arg_max(install_date, (payer_rate_d30, -epoch(install_date))) AS peak_payer_rate_day
FROM daily""", AS_OF_SQL + DAILY_SQL))
def temporal_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6/X11: first/last cohort, volume change, peak days (ties → earliest day)."""
    d = daily_frame(spark, sf_dir)
    first_users = F.min_by("users", "install_date")
    last_users = F.max_by("users", "install_date")
    neg_day = -F.unix_date("install_date")
    return round_doubles(d.agg(
        F.min("install_date").alias("first_day"), F.max("install_date").alias("last_day"),
        first_users.alias("first_day_users"), last_users.alias("last_day_users"),
        F.try_divide((last_users - first_users).cast("double"), F.nullif(first_users.cast("double"), F.lit(0.0)))
        .alias("volume_change"),
        F.max_by("install_date", F.struct("users", neg_day)).alias("peak_users_day"),
        F.max_by("install_date", F.struct("payer_rate_d30", neg_day)).alias("peak_payer_rate_day")))


# ---------------------------------------------------------------- A36
PERIOD_SQL = """
pm AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', install_date) AS DOUBLE), 0.5) AS med FROM mart),
per AS (SELECT mart.*, CASE WHEN CAST(date_diff('day', DATE '1970-01-01', install_date) AS DOUBLE) <= pm.med
        THEN 'early' ELSE 'late' END AS period FROM mart, pm)"""


def _periods(spark, sf_dir):
    m = user_mart(spark, sf_dir).withColumn("dnum", F.unix_date("install_date").cast("double"))
    med = cutoff_values(m, "dnum", {"med": 0.5})["med"]
    return m.withColumn("period", F.when(F.col("dnum") <= med, "early").otherwise("late"))


@job("period_compare", sql=with_mart(f"""
SELECT period, COUNT(*) AS users, MIN(install_date) AS first_day, MAX(install_date) AS last_day,
  {_r(_ma('ltv30'), 'mean_ltv')}, {_r('quantile_cont(ltv30, 0.5)', 'median_ltv')},
  {_r(_pct(_ci('ltv30 > 0'), 'COUNT(*)'), 'payer_rate')}, {_r(_ms('ltv30'), 'total_revenue')}
FROM per GROUP BY period""", PERIOD_SQL))
def period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early vs late half of install dates (split at the median date)."""
    x = _periods(spark, sf_dir)
    g = x.groupBy("period").agg(
        _n().alias("users"), F.min("install_date").alias("first_day"), F.max("install_date").alias("last_day"),
        money_avg("ltv30").alias("mean_ltv"),
        pct(count_if(F.col("ltv30") > 0), _n()).alias("payer_rate"), money_sum("ltv30").alias("total_revenue"))
    return round_doubles(g.join(group_quantiles(x, "period", "ltv30", {"median_ltv": 0.5}), "period", "left"))


@job("channel_drift", sql=with_mart(f"""
SELECT period, media_source, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r(_pct(_ci('ltv30 > 0'), 'COUNT(*)'), 'payer_rate')}
FROM per GROUP BY period, media_source""", PERIOD_SQL))
def channel_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel mix and value by period."""
    x = _periods(spark, sf_dir)
    return round_doubles(x.groupBy("period", "media_source").agg(
        _n().alias("users"), money_avg("ltv30").alias("avg_ltv"),
        pct(count_if(F.col("ltv30") > 0), _n()).alias("payer_rate")))
