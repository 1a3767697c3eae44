"""Seed lists for ad-network lookalikes and their value.

A strategy is a membership frame ``(strategy, vopenid, …)``; all strategies
are stacked with ``unionByName`` and summarised by one grouped aggregate.
Top-K selections use the bucketed rank (ties broken by user id), never a
driver-side sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, money_sum, round_doubles
from ..functions.ranking import cutoff_values, global_rank
from ..plans.mart import user_mart
from ..twins import with_mart
from .cohorts import _ma, _ms, _r
from .evaluation import _sql_scores, ranked_scores
from .temporal import AS_OF_SQL, as_of_date

LATE_TOP_PCT = 5
REV_TOP_PCT = 10
WHALE_Q = 0.99
# Fixed value: cost per install used by the reference's ROI table (VND).
CPI = 10000.0


def engagement_b(df: DataFrame, mg: float, ml: float):
    """games/(max+1) + active_days/8 + logins/(max+1) (maxima as literals)."""
    return (F.col("games_d7") / F.lit(mg + 1.0) + F.col("active_days_d7") / 8.0
            + F.col("login_rows_d7") / F.lit(ml + 1.0))


def seed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long membership frame of the four seed strategies + composition tag."""
    m = user_mart(spark, sf_dir).select("vopenid", "ltv30", "rev_d7", "games_d7", "active_days_d7",
                                         "login_rows_d7", "media_source", "first_country_code")
    zero = m.where(F.col("rev_d7") == 0)
    mx = zero.agg(F.max("games_d7").alias("mg"), F.max("login_rows_d7").alias("ml"), F.count(F.lit(1)).alias("n")) \
        .first()
    n_all = m.count()
    k_late = (mx["n"] * LATE_TOP_PCT) // 100
    k_rev = (n_all * REV_TOP_PCT) // 100
    z = zero.withColumn("eng", engagement_b(zero, float(mx["mg"] or 0), float(mx["ml"] or 0)))
    late = global_rank(z, "eng", desc=True, n=mx["n"]).df.where(F.col("rn") <= k_late).drop("rn", "eng")
    top_rev = global_rank(m, "rev_d7", desc=True, n=n_all).df.where(F.col("rn") <= k_rev).drop("rn")
    d7 = m.where(F.col("rev_d7") > 0)

    def tag(df, name, part):
        return df.select(F.lit(name).alias("strategy"), F.lit(part).alias("part"), *m.columns)
    return (tag(d7, "D7 Payers Only", "d7_payer")
            .unionByName(tag(d7, "D7 Payers + Top 5% Late", "d7_payer"))
            .unionByName(tag(late, "D7 Payers + Top 5% Late", "predicted_late"))
            .unionByName(tag(top_rev, "Top 10% by rev_d7", "top_rev"))
            .unionByName(tag(m.where(F.col("ltv30") > 0), "D30 Payers (Oracle)", "d30_payer")))


SEED_SQL = f"""
z AS (SELECT * FROM mart WHERE rev_d7 = 0),
zm AS (SELECT MAX(games_d7) AS mg, MAX(login_rows_d7) AS ml, COUNT(*) AS n FROM z),
zl AS (SELECT z.*, ROW_NUMBER() OVER (ORDER BY games_d7 / (zm.mg + 1.0) + active_days_d7 / 8.0
         + login_rows_d7 / (zm.ml + 1.0) DESC, vopenid) AS rn, zm.n AS nz FROM z, zm),
tr AS (SELECT mart.*, ROW_NUMBER() OVER (ORDER BY rev_d7 DESC, vopenid) AS rn FROM mart),
mem AS (
  SELECT 'D7 Payers Only' AS strategy, 'd7_payer' AS part, vopenid, ltv30, media_source, first_country_code FROM mart WHERE rev_d7 > 0
  UNION ALL SELECT 'D7 Payers + Top 5% Late', 'd7_payer', vopenid, ltv30, media_source, first_country_code FROM mart WHERE rev_d7 > 0
  UNION ALL SELECT 'D7 Payers + Top 5% Late', 'predicted_late', vopenid, ltv30, media_source, first_country_code FROM zl
    WHERE rn <= (nz * {LATE_TOP_PCT}) // 100
  UNION ALL SELECT 'Top 10% by rev_d7', 'top_rev', vopenid, ltv30, media_source, first_country_code FROM tr
    WHERE rn <= ((SELECT COUNT(*) FROM mart) * {REV_TOP_PCT}) // 100
  UNION ALL SELECT 'D30 Payers (Oracle)', 'd30_payer', vopenid, ltv30, media_source, first_country_code FROM mart WHERE ltv30 > 0),
wq AS (SELECT quantile_cont(ltv30, {WHALE_Q}) AS t FROM mart),
wt AS (SELECT COUNT(*) AS whales FROM mart, wq WHERE ltv30 > 0 AND ltv30 >= wq.t)"""


@job("seed_strategies", sql=with_mart(f"""
SELECT strategy, COUNT(*) AS seed_size, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r('CAST(COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*)', 'payer_rate')}, {_r(_ms('ltv30'), 'total_revenue')},
  {_r('CAST(COUNT(CASE WHEN ltv30 > 0 AND ltv30 >= wq.t THEN 1 END) AS DOUBLE) / NULLIF(CAST(MIN(wt.whales) AS DOUBLE), 0.0)', 'whale_capture')},
  {_r(_ms('ltv30') + ' / COUNT(*)', 'revenue_per_seed')}
FROM mem, wq, wt GROUP BY strategy, wq.t""", SEED_SQL))
def seed_strategies(spark: SparkSession, sf_dir: str, whale_q: float = WHALE_Q) -> DataFrame:
    """G1: seed size, value, payer rate and whale capture (whale = p99 of all users) per strategy."""
    m = user_mart(spark, sf_dir)
    t = cutoff_values(m, "ltv30", {"t": whale_q})["t"]
    total_whales = m.where((F.col("ltv30") > 0) & (F.col("ltv30") >= t)).count()
    mem = seed_members(spark, sf_dir)
    w = (F.col("ltv30") > 0) & (F.col("ltv30") >= t)
    return round_doubles(mem.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("seed_size"), money_avg("ltv30").alias("avg_ltv"),
        (count_if(F.col("ltv30") > 0).cast("double") / F.count(F.lit(1))).alias("payer_rate"),
        money_sum("ltv30").alias("total_revenue"),
        F.try_divide(count_if(w).cast("double"), F.nullif(F.lit(float(total_whales)), F.lit(0.0))).alias("whale_capture"),
        (money_sum("ltv30") / F.count(F.lit(1))).alias("revenue_per_seed")))


@job("seed_composition", sql=with_mart(f"""
SELECT part AS segment, COUNT(*) AS users, {_r(_ms('ltv30'), 'revenue')},
  {_r(_ms('ltv30') + ' * 100.0 / NULLIF(SUM(' + _ms('ltv30') + ') OVER (), 0.0)', 'revenue_share_pct')}
FROM mem WHERE strategy = 'D7 Payers + Top 5% Late' GROUP BY part""", SEED_SQL))
def seed_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue composition of the enriched seed (D7 payers vs predicted late payers)."""
    mem = seed_members(spark, sf_dir).where(F.col("strategy") == "D7 Payers + Top 5% Late")
    g = mem.groupBy(F.col("part").alias("segment")).agg(F.count(F.lit(1)).alias("users"),
                                                       money_sum("ltv30").alias("revenue"))
    return round_doubles(g.withColumn("revenue_share_pct", F.try_divide(
        F.col("revenue") * 100.0, F.nullif(F.sum("revenue").over(Window.partitionBy()), F.lit(0.0)))))


@job("seed_profile", sql=with_mart("""
SELECT 'media_source' AS dim, media_source AS value, COUNT(*) AS users FROM mem
  WHERE strategy = 'D7 Payers + Top 5% Late' GROUP BY media_source
UNION ALL
SELECT 'first_country_code' AS dim, first_country_code AS value, COUNT(*) AS users FROM mem
  WHERE strategy = 'D7 Payers + Top 5% Late' GROUP BY first_country_code""", SEED_SQL))
def seed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected seed users by channel and by country."""
    mem = seed_members(spark, sf_dir).where(F.col("strategy") == "D7 Payers + Top 5% Late")
    long = mem.select(F.explode(F.array(
        F.struct(F.lit("media_source").alias("dim"), F.col("media_source").alias("value")),
        F.struct(F.lit("first_country_code").alias("dim"), F.col("first_country_code").alias("value")))).alias("kv"))
    return long.groupBy(F.col("kv.dim").alias("dim"), F.col("kv.value").alias("value")).agg(
        F.count(F.lit(1)).alias("users"))


# ---------------------------------------------------------------- G2
WEEK_MIN = 10
ENG_TOP_PCT = 5


@job("seed_weekly", sql=with_mart(f"""
, mx AS (SELECT MAX(games_d7) AS mg, MAX(active_days_d7) AS ma, MAX(login_rows_d7) AS ml FROM mart),
e AS (SELECT mart.*, CAST(date_trunc('week', install_date) AS DATE) AS week,
        ((CASE WHEN mg > 0 THEN games_d7 / mg ELSE 0 END) + (CASE WHEN ma > 0 THEN active_days_d7 / ma ELSE 0 END)
         + (CASE WHEN ml > 0 THEN login_rows_d7 / ml ELSE 0 END)) / 3.0 AS eng FROM mart, mx),
wk AS (SELECT week, COUNT(*) AS n, quantile_cont(ltv30, 0.9) AS wt,
         quantile_cont(eng, {1 - ENG_TOP_PCT / 100}) FILTER (WHERE rev_d7 = 0) AS et FROM e GROUP BY week
       HAVING COUNT(*) >= {WEEK_MIN}),
x AS (SELECT e.*, wk.n, wk.wt, wk.et FROM e JOIN wk ON wk.week = e.week),
mem AS (SELECT week, 'D7 Payers Only' AS strategy, ltv30, n, wt FROM x WHERE rev_d7 > 0
  UNION ALL SELECT week, '+ Top 5% Engagement', ltv30, n, wt FROM x WHERE rev_d7 > 0 OR (rev_d7 = 0 AND eng >= et)
  UNION ALL SELECT week, 'D30 Oracle', ltv30, n, wt FROM x WHERE ltv30 > 0),
tw AS (SELECT week, COUNT(CASE WHEN ltv30 > 0 AND ltv30 >= wt THEN 1 END) AS whales FROM x GROUP BY week)
SELECT mem.week, mem.strategy, COUNT(*) AS seed_size, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r('CAST(COUNT(CASE WHEN ltv30 > 0 AND ltv30 >= wt THEN 1 END) AS DOUBLE) / NULLIF(CAST(MIN(tw.whales) AS DOUBLE), 0.0)', 'whale_capture')},
  {_r('CAST(COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*)', 'payer_rate')}, MIN(n) AS users_in_cohort
FROM mem JOIN tw ON tw.week = mem.week GROUP BY mem.week, mem.strategy"""))
def seed_weekly(spark: SparkSession, sf_dir: str, min_users: int = WEEK_MIN) -> DataFrame:
    """Seed strategies per install week with per-week cutoffs (one grouped pass, no loop over weeks)."""
    m = user_mart(spark, sf_dir)
    mx = m.agg(F.max("games_d7").alias("mg"), F.max("active_days_d7").alias("ma"),
               F.max("login_rows_d7").alias("ml")).first()

    def part(c, v):
        return F.col(c) / F.lit(float(v)) if v and v > 0 else F.lit(0.0)
    e = m.withColumn("week", F.date_trunc("week", "install_date").cast("date")).withColumn(
        "eng", (part("games_d7", mx["mg"]) + part("active_days_d7", mx["ma"]) + part("login_rows_d7", mx["ml"])) / 3.0)
    e = e.withColumn("eng_zero", F.when(F.col("rev_d7") == 0, F.col("eng")))
    from ..functions.ranking import group_quantiles
    wk = e.groupBy("week").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_users)
    wk = wk.join(group_quantiles(e, "week", "ltv30", {"wt": 0.9}), "week", "left") \
        .join(group_quantiles(e, "week", "eng_zero", {"et": 1 - ENG_TOP_PCT / 100}), "week", "left")
    x = e.join(F.broadcast(wk), "week")  # one row per calendar week: bounded
    whale = (F.col("ltv30") > 0) & (F.col("ltv30") >= F.col("wt"))
    tw = x.groupBy("week").agg(count_if(whale).alias("whales"))
    cols = ["week", "ltv30", "n", "wt"]
    mem = (x.where(F.col("rev_d7") > 0).select(F.lit("D7 Payers Only").alias("strategy"), *cols)
           .unionByName(x.where((F.col("rev_d7") > 0) | ((F.col("rev_d7") == 0) & (F.col("eng") >= F.col("et"))))
                        .select(F.lit("+ Top 5% Engagement").alias("strategy"), *cols))
           .unionByName(x.where(F.col("ltv30") > 0).select(F.lit("D30 Oracle").alias("strategy"), *cols)))
    j = mem.join(tw, "week")
    return round_doubles(j.groupBy("week", "strategy").agg(
        F.count(F.lit(1)).alias("seed_size"), money_avg("ltv30").alias("avg_ltv"),
        F.try_divide(count_if(whale).cast("double"), F.nullif(F.min("whales").cast("double"), F.lit(0.0)))
        .alias("whale_capture"),
        (count_if(F.col("ltv30") > 0).cast("double") / F.count(F.lit(1))).alias("payer_rate"),
        F.min("n").alias("users_in_cohort")))


# ---------------------------------------------------------------- G4 / G5
ROI_KS = list(range(1, 11))


def _roi_frame(spark, sf_dir):
    _, r, st = ranked_scores(spark, sf_dir)
    ks = st.select("strategy", "n", "total", F.explode(F.array(*[F.lit(k) for k in ROI_KS])).alias("k_pct"))
    ks = ks.withColumn("pos", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("k_pct") / F.lit(100))).cast("bigint"))
    hits = r.df.select("strategy", F.col("rn").alias("pos"), F.col("cum").alias("revenue"))
    return hits.join(F.broadcast(ks), ["strategy", "pos"])  # strategies x K values; every position exists


@job("topk_roi", sql=with_mart(f"""
, k AS (SELECT unnest({ROI_KS}) AS k_pct),
c AS (SELECT st.strategy, k.k_pct, GREATEST(1, CAST((st.n * k.k_pct) // 100 AS BIGINT)) AS users, rk.cum AS revenue,
        rk.cum * 100.0 / NULLIF(st.total, 0.0) AS share
      FROM st CROSS JOIN k JOIN rk ON rk.strategy = st.strategy AND rk.rn = GREATEST(1, CAST((st.n * k.k_pct) // 100 AS BIGINT)))
SELECT c.strategy, c.k_pct, c.users, {_r('c.revenue', 'revenue')}, {_r(f'c.users * {CPI}', 'cost')},
  {_r(f'(c.revenue - c.users * {CPI}) / (c.users * {CPI}) * 100.0', 'roi_pct')}, {_r('c.share', 'share_pct')},
  {_r('c.share - r.share', 'share_vs_random')}
FROM c JOIN c r ON r.strategy = 'random' AND r.k_pct = c.k_pct""", _sql_scores()))
def topk_roi(spark: SparkSession, sf_dir: str, cpi: float = CPI) -> DataFrame:
    """Revenue, cost, ROI and revenue share of the top K% (K = 1..10) per strategy, vs random."""
    x = _roi_frame(spark, sf_dir)
    x = x.withColumn("share", F.try_divide(F.col("revenue") * 100.0, F.nullif("total", F.lit(0.0))))
    rnd = x.where(F.col("strategy") == "random").select("k_pct", F.col("share").alias("rshare"))
    j = x.join(rnd, "k_pct")  # ≤ 10 rows on the random side
    cost = F.col("pos") * F.lit(cpi)
    return round_doubles(j.select(
        "strategy", "k_pct", F.col("pos").alias("users"), "revenue", cost.alias("cost"),
        ((F.col("revenue") - cost) / cost * 100.0).alias("roi_pct"), F.col("share").alias("share_pct"),
        (F.col("share") - F.col("rshare")).alias("share_vs_random")))


@job("topk_marginal", sql=with_mart(f"""
, k AS (SELECT unnest({ROI_KS}) AS k_pct),
c AS (SELECT st.strategy, k.k_pct, rk.cum * 100.0 / NULLIF(st.total, 0.0) AS share
      FROM st CROSS JOIN k JOIN rk ON rk.strategy = st.strategy AND rk.rn = GREATEST(1, CAST((st.n * k.k_pct) // 100 AS BIGINT))),
g AS (SELECT *, share - LAG(share) OVER (PARTITION BY strategy ORDER BY k_pct) AS marginal FROM c),
f AS (SELECT strategy, MAX(CASE WHEN k_pct = 2 THEN marginal END) AS first_m FROM g GROUP BY strategy),
s AS (SELECT g.strategy, MIN(g.k_pct) - 1 AS sweet FROM g JOIN f ON f.strategy = g.strategy
      WHERE g.k_pct > 2 AND g.marginal < f.first_m * 0.4 GROUP BY g.strategy)
SELECT g.strategy, g.k_pct, {_r('g.share', 'share_pct')}, {_r('g.marginal', 'marginal_pct')},
  CAST(COALESCE(s.sweet, {ROI_KS[-1]}) AS INTEGER) AS sweet_spot_k
FROM g LEFT JOIN s ON s.strategy = g.strategy""", _sql_scores()))
def topk_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal share per extra K% (lag) and the sweet spot (first K whose marginal < 40 % of the first)."""
    x = _roi_frame(spark, sf_dir).withColumn(
        "share", F.try_divide(F.col("revenue") * 100.0, F.nullif("total", F.lit(0.0))))
    w = Window.partitionBy("strategy").orderBy("k_pct")  # ≤ 10 rows per strategy
    g = x.withColumn("marginal", F.col("share") - F.lag("share").over(w))
    first = F.max(F.when(F.col("k_pct") == 2, F.col("marginal"))).over(Window.partitionBy("strategy"))
    g = g.withColumn("first_m", first)
    hit = F.when((F.col("k_pct") > 2) & (F.col("marginal") < F.col("first_m") * 0.4), F.col("k_pct") - 1)
    g = g.withColumn("sweet", F.min(hit).over(Window.partitionBy("strategy")))
    return round_doubles(g.select("strategy", "k_pct", F.col("share").alias("share_pct"),
                                  F.col("marginal").alias("marginal_pct"),
                                  F.coalesce("sweet", F.lit(ROI_KS[-1])).cast("int").alias("sweet_spot_k")))


# ---------------------------------------------------------------- G6 / S9
SEED_LIST_PCT = 5
RECENT_DAYS = 1460


SEED_LIST_SQL = with_mart(f"""
, rec AS (SELECT mart.* FROM mart, dump WHERE date_diff('day', install_date, dump.as_of) < {RECENT_DAYS}),
sc AS (SELECT rec.*, rev_d7 + games_d7 / (MAX(games_d7) OVER () + 1.0) AS score FROM rec),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, vopenid) AS seed_rank FROM sc)
SELECT seed_rank, vopenid, install_date, media_source, first_os, {_r('rev_d7', 'rev_d7')}, games_d7, active_days_d7,
  {_r('score', 'score')}
FROM r WHERE seed_rank <= GREATEST(1, ((SELECT COUNT(*) FROM rec) * {SEED_LIST_PCT}) // 100)""", AS_OF_SQL)


@job("seed_list_topk", sql=SEED_LIST_SQL)
def seed_list_topk(spark: SparkSession, sf_dir: str, top_pct: int = SEED_LIST_PCT,
                   recent_days: int = RECENT_DAYS) -> DataFrame:
    """Ranked seed list of recent (unlabelled) users — score = D7 revenue, games as tie-breaker signal.

    The top-K percentage is the feature here (the list sent to the ad network)."""
    as_of = as_of_date(spark, sf_dir)
    m = user_mart(spark, sf_dir).where(F.datediff(F.lit(as_of), F.col("install_date")) < recent_days)
    mg = m.agg(F.max("games_d7")).first()[0] or 0
    x = m.withColumn("score", F.col("rev_d7") + F.col("games_d7") / F.lit(mg + 1.0))
    r = global_rank(x, "score", desc=True)
    k = max(1, (r.n * top_pct) // 100)
    return round_doubles(r.df.where(F.col("rn") <= k).select(
        F.col("rn").alias("seed_rank"), "vopenid", "install_date", "media_source", "first_os", "rev_d7", "games_d7",
        "active_days_d7", "score"))
