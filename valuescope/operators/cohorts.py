"""A*: KPI rows, channel / cohort / country breakdowns, quality profiles.

All are single ``groupBy`` aggregates over the (column-pruned) mart with
map-side partial aggregation; ranking of a handful of group rows uses a
window over the aggregated frame, whose size is the group count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, money_sum, pct, r6, round_doubles
from ..plans.mart import MART_COLUMNS, materialized, user_mart
from ..plans.windows import WINDOW_MART_SQL, window_mart
from ..sources.tables import read_table
from ..twins import with_mart
from .core import WHALE_LTV_FIXED

W = WHALE_LTV_FIXED
# Minimum users per channel (reference 1000 on the full mart,
# 1/10 here as FIXTURES.md B2 states) and per weekly cohort (reference 100).
CHANNEL_MIN_USERS = 100
WEEK_MIN_USERS = 10
LATE = "(rev_d7 = 0 AND ltv30 > 0)"


def _late():
    return (F.col("rev_d7") == 0) & (F.col("ltv30") > 0)


def _n():
    return F.count(F.lit(1))


def _ms(c):  # SQL money sum
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def _ma(c):  # SQL money mean
    return f"(CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(COUNT({c}) AS DOUBLE), 0.0))"


def _ci(cond):
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def _pct(num, den):
    return f"CAST({num} AS DOUBLE) * 100.0 / NULLIF(CAST({den} AS DOUBLE), 0.0)"


def _r(expr, alias):
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {alias}"


# ---------------------------------------------------------------- A1
@job("executive_kpis", sql=with_mart(f"""
SELECT COUNT(*) AS total_users, {_r(_ms('ltv30'), 'total_revenue')},
  {_r(_ms('ltv30') + ' / COUNT(*)', 'overall_arpu')},
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')},
  {_ci('is_payer_30 = 1')} AS total_payers,
  {_ci(f'ltv30 >= {W}')} AS whale_count,
  {_r(_pct(_ci(f'ltv30 >= {W}'), 'COUNT(*)'), 'whale_rate')},
  {_r(f'COALESCE(CAST(SUM(CASE WHEN ltv30 >= {W} THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0)', 'whale_revenue')},
  {_ci(LATE)} AS late_payers,
  {_r(f'COALESCE(CAST(SUM(CASE WHEN {LATE} THEN CAST(ltv30 AS DECIMAL(18,2)) END) AS DOUBLE), 0.0)', 'late_payer_revenue')},
  {_r(_ms('rev_d7'), 'd7_revenue')},
  {_r('AVG(active_days_d7)', 'avg_active_days')}, {_r('AVG(games_d7)', 'avg_games')},
  MIN(install_date) AS first_install, MAX(install_date) AS last_install
FROM mart"""))
def executive_kpis(spark: SparkSession, sf_dir: str, whale_cutoff: float = W) -> DataFrame:
    m = user_mart(spark, sf_dir)
    wh = F.col("ltv30") >= whale_cutoff

    def cond_money(c):
        return F.coalesce(F.sum(F.when(c, F.col("ltv30").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    return round_doubles(m.agg(
        _n().alias("total_users"), money_sum("ltv30").alias("total_revenue"),
        (money_sum("ltv30") / _n()).alias("overall_arpu"),
        pct(count_if(F.col("is_payer_30") == 1), _n()).alias("payer_rate"),
        count_if(F.col("is_payer_30") == 1).alias("total_payers"),
        count_if(wh).alias("whale_count"), pct(count_if(wh), _n()).alias("whale_rate"),
        cond_money(wh).alias("whale_revenue"),
        count_if(_late()).alias("late_payers"), cond_money(_late()).alias("late_payer_revenue"),
        money_sum("rev_d7").alias("d7_revenue"),
        F.avg("active_days_d7").alias("avg_active_days"), F.avg("games_d7").alias("avg_games"),
        F.min("install_date").alias("first_install"), F.max("install_date").alias("last_install")))


# ---------------------------------------------------------------- A3
CHANNEL_SQL = f"""
SELECT media_source, COUNT(*) AS users, {_r(_ms('ltv30') + ' / COUNT(*)', 'arpu')},
  {_r(_ms('ltv30'), 'total_revenue')},
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')},
  {_r(_pct(_ci(f'ltv30 >= {W}'), _ci('is_payer_30 = 1')), 'whale_rate_of_payers')},
  {_r(_pct(_ci(LATE), _ci('is_payer_30 = 1')), 'late_payer_rate')},
  {_r('AVG(active_days_d7)', 'avg_active_days')}, {_r('AVG(games_d7)', 'avg_games')}
FROM mart WHERE media_source IS NOT NULL AND media_source <> ''
GROUP BY media_source HAVING COUNT(*) >= {CHANNEL_MIN_USERS}"""


def _channel_agg(m: DataFrame, whale_cutoff: float, min_users: int) -> DataFrame:
    payers = count_if(F.col("is_payer_30") == 1)
    return (m.where(F.col("media_source").isNotNull() & (F.col("media_source") != ""))
            .groupBy("media_source").agg(
                _n().alias("users"), (money_sum("ltv30") / _n()).alias("arpu"),
                money_sum("ltv30").alias("total_revenue"), pct(payers, _n()).alias("payer_rate"),
                pct(count_if(F.col("ltv30") >= whale_cutoff), payers).alias("whale_rate_of_payers"),
                pct(count_if(_late()), payers).alias("late_payer_rate"),
                F.avg("active_days_d7").alias("avg_active_days"), F.avg("games_d7").alias("avg_games"))
            .where(F.col("users") >= min_users))


@job("channel_dashboard", sql=with_mart(CHANNEL_SQL))
def channel_dashboard(spark: SparkSession, sf_dir: str, whale_cutoff: float = W,
                      min_users: int = CHANNEL_MIN_USERS) -> DataFrame:
    return round_doubles(_channel_agg(user_mart(spark, sf_dir), whale_cutoff, min_users))


# ---------------------------------------------------------------- A4 / K1
@job("channel_top_arpu", sql=with_mart(f"""
SELECT media_source, COUNT(*) AS users, {_r(_ms('ltv30') + ' / COUNT(*)', 'arpu')}
FROM mart WHERE media_source IS NOT NULL AND media_source <> ''
GROUP BY media_source HAVING COUNT(*) >= {CHANNEL_MIN_USERS}
ORDER BY arpu DESC, media_source LIMIT 8"""))
def channel_top_arpu(spark: SparkSession, sf_dir: str, k: int = 8, min_users: int = CHANNEL_MIN_USERS) -> DataFrame:
    m = user_mart(spark, sf_dir)
    g = (m.where(F.col("media_source").isNotNull() & (F.col("media_source") != ""))
         .groupBy("media_source").agg(_n().alias("users"), r6(money_sum("ltv30") / _n()).alias("arpu"))
         .where(F.col("users") >= min_users))
    return g.orderBy(F.col("arpu").desc(), "media_source").limit(k)


# ---------------------------------------------------------------- A5
@job("cohort_weekly", sql=with_mart(f"""
SELECT CAST(date_trunc('week', install_date) AS DATE) AS install_week, COUNT(*) AS users,
  {_r(_ms('ltv30') + ' / COUNT(*)', 'arpu')},
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')},
  {_r(_pct(_ci(f'ltv30 >= {W}'), 'COUNT(*)'), 'whale_rate')},
  {_r(_pct(_ci(LATE), 'COUNT(*)'), 'late_payer_rate')},
  {_r('AVG(active_days_d7)', 'avg_active_days')}, {_r('AVG(games_d7)', 'avg_games')}
FROM mart WHERE install_date IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= {WEEK_MIN_USERS}"""))
def cohort_weekly(spark: SparkSession, sf_dir: str, whale_cutoff: float = W, min_users: int = WEEK_MIN_USERS):
    m = user_mart(spark, sf_dir)
    return round_doubles(
        m.where(F.col("install_date").isNotNull())
        .groupBy(F.date_trunc("week", "install_date").cast("date").alias("install_week"))
        .agg(_n().alias("users"), (money_sum("ltv30") / _n()).alias("arpu"),
             pct(count_if(F.col("is_payer_30") == 1), _n()).alias("payer_rate"),
             pct(count_if(F.col("ltv30") >= whale_cutoff), _n()).alias("whale_rate"),
             pct(count_if(_late()), _n()).alias("late_payer_rate"),
             F.avg("active_days_d7").alias("avg_active_days"), F.avg("games_d7").alias("avg_games"))
        .where(F.col("users") >= min_users))


# ---------------------------------------------------------------- A8
@job("cohort_iso_week", sql=with_mart(f"""
SELECT CAST(isoyear(install_date) AS INTEGER) AS iso_year, CAST(weekofyear(install_date) AS INTEGER) AS iso_week,
  COUNT(*) AS users, {_r(_ms('ltv30') + ' / COUNT(*)', 'arpu')},
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')}, {_r(_ma('rev_d7'), 'avg_rev_d7')}
FROM mart GROUP BY 1, 2"""))
def cohort_iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir)
    return round_doubles(m.groupBy(F.expr("extract(YEAROFWEEK FROM install_date)").cast("int").alias("iso_year"),
                                   F.weekofyear("install_date").alias("iso_week"))
                         .agg(_n().alias("users"), (money_sum("ltv30") / _n()).alias("arpu"),
                              pct(count_if(F.col("is_payer_30") == 1), _n()).alias("payer_rate"),
                              money_avg("rev_d7").alias("avg_rev_d7")))


# ---------------------------------------------------------------- A9 / A10
COMPARE_MEASURES_SQL = f"""COUNT(*) AS users, {_r(_ms('ltv30') + ' / COUNT(*)', 'arpu')},
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')},
  {_r(_pct(_ci('rev_d7 > 0'), 'COUNT(*)'), 'd7_payer_rate')},
  {_r('AVG(active_days_d7)', 'avg_active_days')}, {_r('AVG(games_d7)', 'avg_games')},
  {_r(_ms('ltv30'), 'revenue')}"""


def _compare_measures():
    return [_n().alias("users"), (money_sum("ltv30") / _n()).alias("arpu"),
            pct(count_if(F.col("is_payer_30") == 1), _n()).alias("payer_rate"),
            pct(count_if(F.col("rev_d7") > 0), _n()).alias("d7_payer_rate"),
            F.avg("active_days_d7").alias("avg_active_days"), F.avg("games_d7").alias("avg_games"),
            money_sum("ltv30").alias("revenue")]


@job("cohort_compare", sql=with_mart(f"""
SELECT CASE WHEN GROUPING(media_source) = 0 THEN 'media_source' ELSE 'first_os' END AS dim,
  COALESCE(media_source, first_os) AS value, {COMPARE_MEASURES_SQL}
FROM mart GROUP BY GROUPING SETS ((media_source), (first_os))"""))
def cohort_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel and OS comparison in one pass (grouping sets via cube + filter)."""
    m = user_mart(spark, sf_dir)
    g = m.cube("media_source", "first_os").agg(*_compare_measures(), F.grouping_id().alias("gid"))
    g = g.where(F.col("gid").isin(1, 2))  # (media_source) → gid 1, (first_os) → gid 2
    return round_doubles(g.select(
        F.when(F.col("gid") == 1, F.lit("media_source")).otherwise(F.lit("first_os")).alias("dim"),
        F.when(F.col("gid") == 1, F.col("media_source")).otherwise(F.col("first_os")).alias("value"),
        *[c for c in g.columns if c not in ("media_source", "first_os", "gid")]))


@job("cohort_channel_os", sql=with_mart(f"""
SELECT media_source, first_os, {COMPARE_MEASURES_SQL} FROM mart GROUP BY media_source, first_os"""))
def cohort_channel_os(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir)
    return round_doubles(m.groupBy("media_source", "first_os").agg(*_compare_measures()))


# ---------------------------------------------------------------- A11
BREAKDOWN_DIMS = {"first_country_code": 15, "first_os": 10, "media_source": 10}


@job("breakdown_by_dim", sql=with_mart(" UNION ALL ".join(f"""
SELECT * FROM (SELECT '{d}' AS dim, {d} AS value, COUNT(*) AS users, {_ci('is_payer_30 = 1')} AS payers,
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')}, {_r(_ms('ltv30'), 'revenue')},
  {_r(_ms('ltv30') + ' / COUNT(*)', 'arpu')}
  FROM mart GROUP BY {d} ORDER BY users DESC, value NULLS LAST LIMIT {k})""" for d, k in BREAKDOWN_DIMS.items())))
def breakdown_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-N values of country / OS / source by users, long form."""
    m = user_mart(spark, sf_dir)
    parts = []
    for d, k in BREAKDOWN_DIMS.items():
        payers = count_if(F.col("is_payer_30") == 1)
        g = m.groupBy(F.col(d).alias("value")).agg(
            _n().alias("users"), payers.alias("payers"), pct(payers, _n()).alias("payer_rate"),
            money_sum("ltv30").alias("revenue"), (money_sum("ltv30") / _n()).alias("arpu"))
        parts.append(g.orderBy(F.col("users").desc(), F.col("value").asc_nulls_last()).limit(k)
                     .select(F.lit(d).alias("dim"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return round_doubles(out)


# ---------------------------------------------------------------- A15 / J7
@job("whale_source_rates", sql=with_mart(f"""
, allc AS (SELECT media_source, COUNT(*) AS users FROM mart GROUP BY media_source),
wh AS (SELECT media_source, COUNT(*) AS whales, {_ms('ltv30')} AS whale_revenue
       FROM mart WHERE ltv30 >= {W} GROUP BY media_source)
SELECT a.media_source, a.users, w.whales, {_r('w.whale_revenue', 'whale_revenue')},
       {_r(_pct('w.whales', 'a.users'), 'whale_rate')}
FROM wh w JOIN allc a ON a.media_source IS NOT DISTINCT FROM w.media_source"""))
def whale_source_rates(spark: SparkSession, sf_dir: str, whale_cutoff: float = W) -> DataFrame:
    """Whale count and revenue by channel joined to channel sizes."""
    m = user_mart(spark, sf_dir)
    allc = m.groupBy("media_source").agg(_n().alias("users"))
    wh = (m.where(F.col("ltv30") >= whale_cutoff).groupBy("media_source")
          .agg(_n().alias("whales"), money_sum("ltv30").alias("whale_revenue")))
    j = wh.join(allc, wh.media_source.eqNullSafe(allc.media_source)).select(
        wh.media_source, "users", "whales", "whale_revenue", pct(F.col("whales"), F.col("users")).alias("whale_rate"))
    return round_doubles(j)


# ---------------------------------------------------------------- A21
@job("first_charge_hist", sql=with_mart(f"""
SELECT first_charge_day_offset_d7 AS offset_day, COUNT(*) AS users,
  {_r(_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 'share_pct')}
FROM mart WHERE first_charge_day_offset_d7 IS NOT NULL GROUP BY 1"""))
def first_charge_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir)
    g = m.where(F.col("first_charge_day_offset_d7").isNotNull()).groupBy(
        F.col("first_charge_day_offset_d7").alias("offset_day")).agg(_n().alias("users"))
    # the aggregated frame has one row per offset day (≤ feat_days rows)
    return round_doubles(g.withColumn("share_pct", pct(F.col("users"), F.sum("users").over(Window.partitionBy()))))


# ---------------------------------------------------------------- A26
# Revenue brackets of the reference (VND), left-closed.
BRACKET_EDGES = [0, 1000, 10000, 50000, 100000, 323000, 1000000, 5000000]
BRACKET_LABELS = ["0-1K", "1K-10K", "10K-50K", "50K-100K", "100K-323K", "323K-1M", "1M-5M", "5M+"]


def _bracket_sql():
    parts = []
    for i, lab in enumerate(BRACKET_LABELS):
        lo = BRACKET_EDGES[i]
        if i + 1 < len(BRACKET_EDGES):
            parts.append(f"WHEN ltv30 >= {lo} AND ltv30 < {BRACKET_EDGES[i + 1]} THEN '{lab}'")
        else:
            parts.append(f"WHEN ltv30 >= {lo} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@job("revenue_brackets", sql=with_mart(f"""
SELECT bracket, COUNT(*) AS users, {_r(_ms('ltv30'), 'revenue')},
  {_r(_ms('ltv30') + ' * 100.0 / NULLIF(SUM(' + _ms('ltv30') + ') OVER (), 0.0)', 'revenue_share_pct')}
FROM (SELECT *, {_bracket_sql()} AS bracket FROM mart WHERE ltv30 > 0) t GROUP BY bracket"""))
def revenue_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payers' ltv30 by fixed brackets with revenue share."""
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    b = None
    for i, lab in enumerate(BRACKET_LABELS):
        c = F.col("ltv30") >= BRACKET_EDGES[i]
        if i + 1 < len(BRACKET_EDGES):
            c = c & (F.col("ltv30") < BRACKET_EDGES[i + 1])
        b = F.when(c, F.lit(lab)) if b is None else b.when(c, F.lit(lab))
    g = m.groupBy(b.alias("bracket")).agg(_n().alias("users"), money_sum("ltv30").alias("revenue"))
    return round_doubles(g.withColumn("revenue_share_pct", F.try_divide(
        F.col("revenue") * 100.0, F.nullif(F.sum("revenue").over(Window.partitionBy()), F.lit(0.0)))))


# ---------------------------------------------------------------- A27
DQ_COLS = ["vopenid", "media_source", "install_date", "ltv30", "rev_d7", "active_days_d7", "games_d7",
           "kills_d7", "first_os"]
DQ_STRING = {"media_source", "first_os"}


def _dq_null_sql(c):
    cond = f"{c} IS NULL OR {c} = ''" if c in DQ_STRING else f"{c} IS NULL"
    return _r(_pct(_ci(cond), "COUNT(*)"), f"null_{c}")


@job("data_quality", sql=with_mart(f"""
SELECT COUNT(*) AS total_rows, MIN(install_date) AS first_date, MAX(install_date) AS last_date,
  COUNT(DISTINCT media_source) AS n_channels, COUNT(DISTINCT first_os) AS n_os,
  {', '.join(_dq_null_sql(c) for c in DQ_COLS)}
FROM mart"""))
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir)

    def nul(c):
        cond = F.col(c).isNull()
        if c in DQ_STRING:
            cond = cond | (F.col(c) == "")
        return pct(count_if(cond), _n()).alias(f"null_{c}")
    return round_doubles(m.agg(
        _n().alias("total_rows"), F.min("install_date").alias("first_date"), F.max("install_date").alias("last_date"),
        F.count_distinct("media_source").alias("n_channels"), F.count_distinct("first_os").alias("n_os"),
        *[nul(c) for c in DQ_COLS]))


@job("data_quality_flags", sql=with_mart(f"""
, dq AS (SELECT {', '.join(_dq_null_sql(c) for c in DQ_COLS)} FROM mart)
SELECT column_name, null_pct, CAST(null_pct > 1.0 AS INTEGER) AS flagged FROM (
  UNPIVOT dq ON {', '.join('null_' + c for c in DQ_COLS)} INTO NAME column_name VALUE null_pct)"""))
def data_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """null/empty % per key column in long form, flagged above 1 %."""
    dq = data_quality(spark, sf_dir)
    cols = [f"null_{c}" for c in DQ_COLS]
    long = dq.select(*cols).unpivot([], cols, "column_name", "null_pct")
    return long.withColumn("flagged", (F.col("null_pct") > 1.0).cast("int"))


# ---------------------------------------------------------------- A28
@job("null_rates", sql=with_mart(f"""
, nr AS (SELECT {', '.join(_r(_pct(_ci(f'{c} IS NULL'), 'COUNT(*)'), c) for c in MART_COLUMNS)} FROM mart)
SELECT column_name, null_pct FROM (UNPIVOT nr ON {', '.join(MART_COLUMNS)} INTO NAME column_name VALUE null_pct)"""))
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null % of every mart column (one aggregate, then unpivot)."""
    m = user_mart(spark, sf_dir)
    wide = round_doubles(m.agg(*[pct(count_if(F.col(c).isNull()), _n()).alias(c) for c in MART_COLUMNS]))
    return wide.unpivot([], MART_COLUMNS, "column_name", "null_pct")


# ---------------------------------------------------------------- A29 / X7
PROFILE_COLS = ["ltv30", "rev_d7", "txn_cnt_d7", "login_rows_d7", "active_days_d7", "games_d7", "win_rate_d7",
                "avg_score_d7", "kills_d7", "kd_d7"]
PROFILE_QS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@job("numeric_profile", sql=with_mart(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, COUNT({c}) AS n, {_r(f'CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / NULLIF(CAST(COUNT({c}) AS DOUBLE), 0.0)', 'mean')}, {_r(f'STDDEV_SAMP({c})', 'std')},
  {_r(f'MIN({c})', 'min')}, {', '.join(_r(f'quantile_cont({c}, {q})', a) for a, q in PROFILE_QS.items())},
  {_r(f'MAX({c})', 'max')} FROM mart""" for c in PROFILE_COLS)))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe() of the numeric columns in long form (one row per column)."""
    from ..functions.ranking import group_quantiles
    m = user_mart(spark, sf_dir).select("vopenid", *PROFILE_COLS)
    long = m.unpivot(["vopenid"], PROFILE_COLS, "column_name", "x").withColumn("x", F.col("x").cast("double"))
    base = long.groupBy("column_name").agg(
        F.count("x").alias("n"),
        F.try_divide(F.sum(F.col("x").cast("decimal(38,6)")).cast("double"), F.count("x").cast("double")).alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = group_quantiles(long, "column_name", "x", PROFILE_QS)  # one row per profiled column
    return round_doubles(base.join(q, "column_name", "left"))


# ---------------------------------------------------------------- A30
@job("label_distribution", sql=with_mart(f"""
SELECT COUNT(*) AS n, {_r(_ma('ltv30'), 'mean')}, {_r('quantile_cont(ltv30, 0.5)', 'median')},
  {_r('STDDEV_SAMP(ltv30)', 'std')}, {_r(_pct(_ci('ltv30 = 0'), 'COUNT(*)'), 'zero_pct')},
  {_r(_ma('CASE WHEN ltv30 > 0 THEN ltv30 END'), 'payer_mean')},
  {_r('quantile_cont(ltv30, 0.5) FILTER (WHERE ltv30 > 0)', 'payer_median')}
FROM mart"""))
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ranking import cutoff_values
    m = user_mart(spark, sf_dir)
    med = cutoff_values(m, "ltv30", {"m": 0.5})["m"]
    pmed = cutoff_values(m, "ltv30", {"m": 0.5}, where=F.col("ltv30") > 0)["m"]
    pay = F.when(F.col("ltv30") > 0, F.col("ltv30"))
    return round_doubles(m.withColumn("pay", pay).agg(
        _n().alias("n"), money_avg("ltv30").alias("mean"), F.lit(med).cast("double").alias("median"),
        F.stddev_samp("ltv30").alias("std"), pct(count_if(F.col("ltv30") == 0), _n()).alias("zero_pct"),
        money_avg("pay").alias("payer_mean"), F.lit(pmed).cast("double").alias("payer_median")))


# ---------------------------------------------------------------- A31
@job("payer_crosstab", sql=with_mart(f"""
SELECT CAST(rev_d7 > 0 AS INTEGER) AS d7_payer, CAST(ltv30 > 0 AS INTEGER) AS d30_payer, COUNT(*) AS users,
  {_r(_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 'share_pct')},
  {_r(_pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY CAST(rev_d7 > 0 AS INTEGER))'), 'row_pct')}
FROM mart GROUP BY 1, 2"""))
def payer_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 payer × D30 payer with cell and conversion (row) shares."""
    m = user_mart(spark, sf_dir)
    g = m.groupBy((F.col("rev_d7") > 0).cast("int").alias("d7_payer"),
                  (F.col("ltv30") > 0).cast("int").alias("d30_payer")).agg(_n().alias("users"))
    # ≤ 4 rows: windows over the aggregated frame are bounded
    return round_doubles(g.select("*",
                                  pct(F.col("users"), F.sum("users").over(Window.partitionBy())).alias("share_pct"),
                                  pct(F.col("users"), F.sum("users").over(Window.partitionBy("d7_payer")))
                                  .alias("row_pct")))


# ---------------------------------------------------------------- A32
VC_DIMS = ["media_source", "first_country_code", "first_os"]


@job("value_counts", sql=with_mart(" UNION ALL ".join(f"""
SELECT '{d}' AS dim, {d} AS value, is_payer_30, COUNT(*) AS users FROM mart GROUP BY {d}, is_payer_30"""
                                                    for d in VC_DIMS)))
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the attribution columns, split by payer flag (one pass)."""
    m = user_mart(spark, sf_dir)
    long = m.select("is_payer_30", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"))
                                                       for d in VC_DIMS])).alias("kv"))
    return long.groupBy(F.col("kv.dim").alias("dim"), F.col("kv.value").alias("value"), "is_payer_30") \
        .agg(_n().alias("users"))


@job("value_counts_time", sql=with_mart("""
SELECT 'install_date' AS dim, CAST(install_date AS VARCHAR) AS value, is_payer_30 AS payer, COUNT(*) AS users FROM mart GROUP BY 1, 2, 3
UNION ALL
SELECT 'window_days' AS dim, CAST(window_days AS VARCHAR) AS value, CAST(rev > 0 AS INTEGER) AS payer, COUNT(*) AS users FROM wm GROUP BY 1, 2, 3""",
                                        WINDOW_MART_SQL))
def value_counts_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of install dates (by payer flag) and of windows (by payers of the window)."""
    m = user_mart(spark, sf_dir).select(F.lit("install_date").alias("dim"), F.col("install_date").cast("string").alias("value"),
                                        F.col("is_payer_30").alias("payer"))
    w = window_mart(spark, sf_dir).select(F.lit("window_days").alias("dim"), F.col("window_days").cast("string").alias("value"),
                                          (F.col("rev") > 0).cast("int").alias("payer"))
    return m.unionByName(w).groupBy("dim", "value", "payer").agg(_n().alias("users"))


# ---------------------------------------------------------------- A33
# Games-played brackets of the reference.
ENGAGEMENT_BRACKETS = [(500, "500+"), (200, "200-499"), (100, "100-199"), (50, "50-99")]


@job("engagement_outliers", sql=with_mart(f"""
SELECT CASE {' '.join(f"WHEN games_d7 >= {lo} THEN '{lab}'" for lo, lab in ENGAGEMENT_BRACKETS)} ELSE '<50' END
    AS games_bucket, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r(_pct(_ci('is_payer_30 = 1'), 'COUNT(*)'), 'payer_rate')}
FROM mart GROUP BY 1"""))
def engagement_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir)
    b = None
    for lo, lab in ENGAGEMENT_BRACKETS:
        b = F.when(F.col("games_d7") >= lo, F.lit(lab)) if b is None else b.when(F.col("games_d7") >= lo, F.lit(lab))
    b = b.otherwise(F.lit("<50"))
    return round_doubles(m.groupBy(b.alias("games_bucket")).agg(
        _n().alias("users"), money_avg("ltv30").alias("avg_ltv"),
        pct(count_if(F.col("is_payer_30") == 1), _n()).alias("payer_rate")))


# ---------------------------------------------------------------- A34
@job("late_rate_by_channel", sql=with_mart(f"""
SELECT media_source, COUNT(*) AS total, {_ci(LATE)} AS late_payers,
  {_r(_pct(_ci(LATE), 'COUNT(*)'), 'late_rate')}
FROM mart WHERE media_source IS NOT NULL AND media_source <> ''
GROUP BY media_source HAVING COUNT(*) >= {CHANNEL_MIN_USERS} ORDER BY late_rate DESC, media_source LIMIT 10"""))
def late_rate_by_channel(spark: SparkSession, sf_dir: str, min_users: int = CHANNEL_MIN_USERS, k: int = 10):
    m = user_mart(spark, sf_dir)
    g = (m.where(F.col("media_source").isNotNull() & (F.col("media_source") != ""))
         .groupBy("media_source").agg(_n().alias("total"), count_if(_late()).alias("late_payers"),
                                      r6(pct(count_if(_late()), _n())).alias("late_rate"))
         .where(F.col("total") >= min_users))
    return g.orderBy(F.col("late_rate").desc(), "media_source").limit(k)


# ---------------------------------------------------------------- A35
@job("d7_d30_multiplier", sql=with_mart(f"""
SELECT COUNT(*) AS d7_payers,
  {_r('quantile_cont(ltv30 / GREATEST(rev_d7, 0.01), 0.5)', 'median_multiplier')},
  {_r('quantile_cont(ltv30 / GREATEST(rev_d7, 0.01), 0.25)', 'p25_multiplier')},
  {_r('quantile_cont(ltv30 / GREATEST(rev_d7, 0.01), 0.75)', 'p75_multiplier')},
  {_r('quantile_cont(ltv30 / GREATEST(rev_d7, 0.01), 0.9)', 'p90_multiplier')},
  {_r('AVG(ltv30 / GREATEST(rev_d7, 0.01))', 'mean_multiplier')}
FROM mart WHERE rev_d7 > 0"""))
def d7_d30_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ltv30 / max(rev_d7, 0.01) over D7 payers: median and spread."""
    from ..functions.ranking import cutoff_values
    m = user_mart(spark, sf_dir).where(F.col("rev_d7") > 0) \
        .withColumn("mult", F.col("ltv30") / F.greatest(F.col("rev_d7"), F.lit(0.01)))
    c = cutoff_values(m, "mult", {"median_multiplier": 0.5, "p25_multiplier": 0.25, "p75_multiplier": 0.75,
                                  "p90_multiplier": 0.9})
    return round_doubles(m.agg(_n().alias("d7_payers"), *[F.lit(v).cast("double").alias(k) for k, v in c.items()],
                               F.avg("mult").alias("mean_multiplier")))


# ---------------------------------------------------------------- A38 / K1
@job("revenue_outliers", sql=with_mart(f"""
, med AS (SELECT quantile_cont(ltv30, 0.5) AS med FROM mart WHERE ltv30 > 0)
SELECT vopenid, media_source, first_os, {_r('ltv30', 'ltv30')}, {_r('rev_d7', 'rev_d7')}, active_days_d7, games_d7,
  {_r('kills_d7', 'kills_d7')}, is_payer_30, {_r('ltv30 / NULLIF(med, 0.0)', 'x_median')}
FROM mart, med ORDER BY ltv30 DESC, vopenid LIMIT 20"""))
def revenue_outliers(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Top-k users by ltv30 (TakeOrderedAndProject) and their multiple of the payer median."""
    from ..functions.ranking import cutoff_values
    m = user_mart(spark, sf_dir)
    med = cutoff_values(m, "ltv30", {"med": 0.5}, where=F.col("ltv30") > 0)["med"]
    top = m.orderBy(F.col("ltv30").desc(), "vopenid").limit(k)
    return round_doubles(top.select("vopenid", "media_source", "first_os", "ltv30", "rev_d7", "active_days_d7",
                                    "games_d7", "kills_d7", "is_payer_30",
                                    F.try_divide(F.col("ltv30"), F.nullif(F.lit(med), F.lit(0.0))).alias("x_median")))


# ---------------------------------------------------------------- A39
@job("approx_variety", sql=None)
def approx_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts per user (HyperLogLog++); values are
    approximate by design, so only the row count is checked against SQL."""
    from ..plans.mart import orders_daily
    d = orders_daily(spark, sf_dir)
    return d.groupBy("vopenid").agg(F.approx_count_distinct("d").alias("approx_active_days"),
                                    F.approx_count_distinct("prio").alias("approx_priority_variety"))


@job("exact_variety", sql="""
SELECT o_custkey AS vopenid, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS active_days,
       COUNT(DISTINCT o_orderpriority) AS priority_variety
FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""")
def exact_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact twin of A39 (distinct days / priorities over the whole history)."""
    from ..plans.mart import orders_daily
    d = orders_daily(spark, sf_dir)
    return d.groupBy("vopenid").agg(F.count_distinct("d").alias("active_days"),
                                    F.count_distinct("prio").alias("priority_variety"))


SKETCH_K = 14  # log2 of the registers: a standard error of 0.65 % (1.04 / sqrt(2^14) is 0.81 % for older forms)


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, channel, sketch): one HyperLogLog sketch of the users of each day and login channel, written once."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderpriority"])
    return materialized(spark, "daily_sketches", sf_dir, ("orders",), (SKETCH_K,), lambda: o.where("o_custkey is not null").groupBy(
        F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("channel")).agg(
        F.hll_sketch_agg(F.col("o_custkey").cast("long"), SKETCH_K).alias("sketch")))


def _reach(per_day: DataFrame, count) -> DataFrame:
    """Users by week and channel, by channel, and in all, from frames by day and channel."""
    week = F.date_trunc("week", "day").cast("date")
    parts = [("week", week, F.col("channel")), ("channel", F.lit(None).cast("date"), F.col("channel")),
             ("total", F.lit(None).cast("date"), F.lit(None).cast("string"))]
    out = None
    for level, period, channel in parts:
        g = per_day.groupBy(F.lit(level).alias("level"), period.alias("week"), channel.alias("channel")).agg(count.alias("users"))
        out = g if out is None else out.unionByName(g)
    return out


@job("sketch_reach", sql=None)
def sketch_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct users per week and channel, per channel and in all, as unions of the daily sketches: the log is not read again."""
    return _reach(daily_sketches(spark, sf_dir), F.hll_sketch_estimate(F.hll_union_agg("sketch")))


@job("exact_reach", sql="""
WITH d AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderpriority AS channel, o_custkey AS u
           FROM orders WHERE o_custkey IS NOT NULL)
SELECT 'week' AS level, week, channel, COUNT(DISTINCT u) AS users FROM d GROUP BY week, channel
UNION ALL SELECT 'channel', CAST(NULL AS DATE), channel, COUNT(DISTINCT u) FROM d GROUP BY channel
UNION ALL SELECT 'total', CAST(NULL AS DATE), CAST(NULL AS VARCHAR), COUNT(DISTINCT u) FROM d""")
def exact_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact twin of ``sketch_reach``."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderpriority"]).where("o_custkey is not null")
    d = o.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("channel"), "o_custkey").distinct()
    return _reach(d, F.count_distinct("o_custkey"))


# ---------------------------------------------------------------- A40
SCORE_BINS = 50
SCORE = "games_d7 / (mg + 1.0) + active_days_d7 / 8.0 + login_rows_d7 / (ml + 1.0)"


@job("score_histogram", sql=with_mart(f"""
, mx AS (SELECT MAX(games_d7) AS mg, MAX(login_rows_d7) AS ml FROM mart),
s AS (SELECT is_payer_30, {SCORE} AS score FROM mart, mx),
b AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM s),
x AS (SELECT is_payer_30, lo, hi, CAST(COALESCE(LEAST(FLOOR((score - lo) / NULLIF((hi - lo) / {SCORE_BINS}, 0.0)), {SCORE_BINS - 1}), 0) AS INTEGER) AS bin
      FROM s, b)
SELECT bin, is_payer_30, COUNT(*) AS users, {_r(f'MIN(lo) + bin * (MIN(hi) - MIN(lo)) / {SCORE_BINS}', 'bin_start')} FROM x GROUP BY bin, is_payer_30"""))
def score_histogram(spark: SparkSession, sf_dir: str, bins: int = SCORE_BINS) -> DataFrame:
    """Equal-width histogram of the engagement score, by payer flag."""
    m = user_mart(spark, sf_dir)
    mx = m.agg(F.max("games_d7").alias("mg"), F.max("login_rows_d7").alias("ml")).first()
    s = m.select("is_payer_30", (F.col("games_d7") / F.lit(float(mx["mg"] or 0) + 1.0) + F.col("active_days_d7") / 8.0
                                 + F.col("login_rows_d7") / F.lit(float(mx["ml"] or 0) + 1.0)).alias("score"))
    r = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, is_payer_30 int, users bigint, bin_start double")
    lo, hi = r["lo"], r["hi"]
    width = (hi - lo) / bins
    b = F.lit(0) if width == 0 else F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    g = s.groupBy(b.cast("int").alias("bin"), "is_payer_30").agg(_n().alias("users"))
    return round_doubles(g.withColumn("bin_start", F.lit(lo) + F.col("bin") * (F.lit(hi) - F.lit(lo)) / bins))


HIST_BINS = 40


@job("ltv_histogram", sql=with_mart(f"""
, b AS (SELECT MIN(ltv30) AS lo, MAX(ltv30) AS hi FROM mart WHERE ltv30 > 0),
x AS (SELECT media_source,
   CAST(LEAST(FLOOR((ltv30 - lo) / NULLIF((hi - lo) / {HIST_BINS}, 0.0)), {HIST_BINS - 1}) AS INTEGER) AS bin,
   lo, hi FROM mart, b WHERE ltv30 > 0)
SELECT COALESCE(bin, 0) AS bin, media_source, COUNT(*) AS users,
  {_r(f'MIN(lo) + COALESCE(bin, 0) * (MIN(hi) - MIN(lo)) / {HIST_BINS}', 'bin_start')}
FROM x GROUP BY COALESCE(bin, 0), media_source"""))
def ltv_histogram(spark: SparkSession, sf_dir: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of payers' ltv30 by channel."""
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    r = m.agg(F.min("ltv30").alias("lo"), F.max("ltv30").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, media_source string, users bigint, bin_start double")
    width = (hi - lo) / bins
    b = F.lit(0) if width == 0 else F.least(F.floor((F.col("ltv30") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    g = m.groupBy(b.cast("int").alias("bin"), "media_source").agg(_n().alias("users"))
    return round_doubles(g.withColumn("bin_start", F.lit(lo) + F.col("bin") * (F.lit(hi) - F.lit(lo)) / bins))


# ---------------------------------------------------------------- A41
@job("label_coverage", sql=with_mart(f"""
SELECT COUNT(*) AS n_rows, COUNT(ltv30) AS labelled, {_ci('ltv30 IS NULL')} AS unlabelled,
  {_r(_ma('ltv30'), 'mean_label')}, MIN(install_date) AS first_date, MAX(install_date) AS last_date
FROM mart"""))
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir)
    return round_doubles(m.agg(_n().alias("n_rows"), F.count("ltv30").alias("labelled"),
                               count_if(F.col("ltv30").isNull()).alias("unlabelled"),
                               money_avg("ltv30").alias("mean_label"),
                               F.min("install_date").alias("first_date"), F.max("install_date").alias("last_date")))


# ---------------------------------------------------------------- K5 / J5
@job("channel_top5_profile", sql=with_mart(f"""
, top AS (SELECT media_source FROM mart WHERE media_source IS NOT NULL GROUP BY media_source
          ORDER BY COUNT(*) DESC, media_source LIMIT 5)
SELECT media_source, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')}, {_r(_ma('rev_d7'), 'avg_rev_d7')},
  {_r('AVG(active_days_d7)', 'avg_active_days')}, {_r('AVG(games_d7)', 'avg_games')},
  {_r('AVG(win_rate_d7)', 'avg_win_rate')}
FROM mart WHERE media_source IN (SELECT media_source FROM top) GROUP BY media_source"""))
def channel_top5_profile(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Top-k channels by users, then a profile restricted by a semi-join."""
    m = user_mart(spark, sf_dir)
    top = (m.where(F.col("media_source").isNotNull()).groupBy("media_source").agg(_n().alias("u"))
           .orderBy(F.col("u").desc(), "media_source").limit(k).select("media_source"))
    prof = m.join(F.broadcast(top), "media_source", "left_semi")  # ≤ k rows: bounded
    return round_doubles(prof.groupBy("media_source").agg(
        _n().alias("users"), money_avg("ltv30").alias("avg_ltv"), money_avg("rev_d7").alias("avg_rev_d7"),
        F.avg("active_days_d7").alias("avg_active_days"), F.avg("games_d7").alias("avg_games"),
        F.avg("win_rate_d7").alias("avg_win_rate")))
