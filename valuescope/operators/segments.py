"""P*: tiers, buckets and segment profiles driven by quantile cutoffs.

Cutoffs are exact quantiles computed by ``functions.ranking`` (bounded
memory at any size) and inlined as literals, so the per-user work is a
single column-pruned scan + ``when`` ladder + grouped aggregate. The tier
ladders guard against zero cutoffs (a quantile of 0 must not turn every
non-payer into a whale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, ladder, money_avg, money_sum, pct, round_doubles
from ..functions.ranking import cutoff_values, group_quantiles
from ..plans.mart import user_mart
from ..twins import with_mart
from .cohorts import CHANNEL_MIN_USERS, _ci, _ma, _ms, _pct, _r

ALL = "(SELECT * FROM mart)"


def _n():
    return F.count(F.lit(1))


def _share(col: str) -> F.Column:
    """x * 100 / sum(x) over the aggregated rows (bounded by the group count)."""
    return F.try_divide(F.col(col).cast("double") * 100.0,
                        F.nullif(F.sum(col).over(Window.partitionBy()).cast("double"), F.lit(0.0)))


def _lit_or_null(v):
    return F.lit(v).cast("double")


# ---------------------------------------------------------------- P2 / A14
WHALE_TIERS = ["Mega-Whale (top 1%)", "Whale (1-5%)", "Minnow (5-20%)", "Low Payer (20-100%)", "Non-Payer"]
TIER_FEATS = ["games_d7", "active_days_d7", "win_rate_d7", "kd_d7", "login_rows_d7"]


def _whale_tier_sql():
    t = WHALE_TIERS
    return (f"CASE WHEN ltv30 > 0 AND ltv30 >= q.p99 THEN '{t[0]}' WHEN ltv30 > 0 AND ltv30 >= q.p95 THEN '{t[1]}' "
            f"WHEN ltv30 > 0 AND ltv30 >= q.p80 THEN '{t[2]}' WHEN ltv30 > 0 THEN '{t[3]}' ELSE '{t[4]}' END")


def _whale_tier(c):
    v = F.col("ltv30")
    t = WHALE_TIERS
    return (F.when((v > 0) & (v >= c["p99"]), t[0]).when((v > 0) & (v >= c["p95"]), t[1])
            .when((v > 0) & (v >= c["p80"]), t[2]).when(v > 0, t[3]).otherwise(t[4]))


def _tier_order_sql(col, names):
    return "CASE " + " ".join(f"WHEN {col} = '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


def _tier_order(col, names):
    e = None
    for i, n in enumerate(names):
        e = F.when(F.col(col) == n, i) if e is None else e.when(F.col(col) == n, i)
    return e


Q_ALL = ("q AS (SELECT quantile_cont(ltv30, 0.99) AS p99, quantile_cont(ltv30, 0.95) AS p95, "
         "quantile_cont(ltv30, 0.80) AS p80, quantile_cont(ltv30, 0.90) AS p90, quantile_cont(ltv30, 0.5) AS p50 "
         "FROM mart)")


@job("whale_tiers", sql=with_mart(f"""
SELECT whale_tier, {_tier_order_sql('whale_tier', WHALE_TIERS)} AS tier_order, COUNT(*) AS users,
  {_r(_ma('ltv30'), 'avg_ltv')}, {_r(_ms('ltv30'), 'total_ltv')},
  {_r(_ms('ltv30') + ' * 100.0 / NULLIF(SUM(' + _ms('ltv30') + ') OVER (), 0.0)', 'rev_share_pct')},
  {', '.join(_r(f'AVG({c})', 'avg_' + c) for c in TIER_FEATS)}
FROM (SELECT mart.*, {_whale_tier_sql()} AS whale_tier FROM mart, q) t GROUP BY whale_tier""", Q_ALL))
def whale_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by p99/p95/p80 of all users, summary with revenue share."""
    m = user_mart(spark, sf_dir)
    c = cutoff_values(m, "ltv30", {"p99": 0.99, "p95": 0.95, "p80": 0.80})
    g = m.groupBy(_whale_tier(c).alias("whale_tier")).agg(
        _n().alias("users"), money_avg("ltv30").alias("avg_ltv"), money_sum("ltv30").alias("total_ltv"),
        *[F.avg(f).alias("avg_" + f) for f in TIER_FEATS])
    return round_doubles(g.withColumn("tier_order", _tier_order("whale_tier", WHALE_TIERS))
                         .withColumn("rev_share_pct", _share("total_ltv")))


# ---------------------------------------------------------------- P14
@job("tier_profile_normalised", sql=with_mart(f"""
, t AS (SELECT whale_tier, {', '.join(f'AVG({c}) AS {c}' for c in TIER_FEATS)}
        FROM (SELECT mart.*, {_whale_tier_sql()} AS whale_tier FROM mart, q) x GROUP BY whale_tier)
SELECT whale_tier, {', '.join(_r(f'{c} / NULLIF(MAX({c}) OVER (), 0.0)', c + '_norm') for c in TIER_FEATS)},
  {', '.join(_r(f'({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0.0)', c + '_minmax')
             for c in TIER_FEATS)}
FROM t""", Q_ALL))
def tier_profile_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier feature means, max-normalised and min–max normalised across tiers."""
    m = user_mart(spark, sf_dir)
    c = cutoff_values(m, "ltv30", {"p99": 0.99, "p95": 0.95, "p80": 0.80})
    t = m.groupBy(_whale_tier(c).alias("whale_tier")).agg(*[F.avg(f).alias(f) for f in TIER_FEATS])
    w = Window.partitionBy()  # ≤ 5 tier rows
    out = [F.col("whale_tier")]
    for f in TIER_FEATS:
        out.append(F.try_divide(F.col(f), F.nullif(F.max(f).over(w), F.lit(0.0))).alias(f + "_norm"))
    for f in TIER_FEATS:
        out.append(F.try_divide(F.col(f) - F.min(f).over(w),
                                F.nullif(F.max(f).over(w) - F.min(f).over(w), F.lit(0.0))).alias(f + "_minmax"))
    return round_doubles(t.select(*out))


# ---------------------------------------------------------------- P3
DECISION_TIERS = ["Non-Payer", "Minnow", "Dolphin", "Whale"]


@job("decision_tiers", sql=with_mart(f"""
SELECT tier, COUNT(*) AS users, {_r(_ms('ltv30'), 'total_rev')}, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r('quantile_cont(ltv30, 0.5)', 'median_ltv')}, {_r(_ma('rev_d7'), 'avg_rev_d7')},
  {_r('AVG(games_d7)', 'avg_games')}, {_r('AVG(active_days_d7)', 'avg_active_days')},
  {_r(_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 'pct_users')},
  {_r(_ms('ltv30') + ' * 100.0 / NULLIF(SUM(' + _ms('ltv30') + ') OVER (), 0.0)', 'pct_revenue')}
FROM (SELECT mart.*, CASE WHEN ltv30 <= 0 THEN 'Non-Payer' WHEN ltv30 < q.p90 THEN 'Minnow'
      WHEN ltv30 < q.p99 THEN 'Dolphin' ELSE 'Whale' END AS tier FROM mart, q) t GROUP BY tier""", Q_ALL))
def decision_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-Payer / Minnow (<p90) / Dolphin (<p99) / Whale over all users."""
    m = user_mart(spark, sf_dir)
    c = cutoff_values(m, "ltv30", {"p90": 0.90, "p99": 0.99})
    v = F.col("ltv30")
    tier = (F.when(v <= 0, "Non-Payer").when(v < c["p90"], "Minnow").when(v < c["p99"], "Dolphin")
            .otherwise("Whale"))
    x = m.withColumn("tier", tier)
    g = x.groupBy("tier").agg(
        _n().alias("users"), money_sum("ltv30").alias("total_rev"), money_avg("ltv30").alias("avg_ltv"),
        money_avg("rev_d7").alias("avg_rev_d7"),
        F.avg("games_d7").alias("avg_games"), F.avg("active_days_d7").alias("avg_active_days"))
    g = g.join(group_quantiles(x, "tier", "ltv30", {"median_ltv": 0.5}), "tier", "left")
    return round_doubles(g.withColumn("pct_users", _share("users")).withColumn("pct_revenue", _share("total_rev")))


# ---------------------------------------------------------------- P4
PAYER_TIERS = ["Minnow (<=p50)", "Dolphin (p50-p90)", "Whale (p90-p99)", "Super Whale (>p99)"]
Q_PAY = ("qp AS (SELECT quantile_cont(ltv30, 0.5) AS p50, quantile_cont(ltv30, 0.9) AS p90, "
         "quantile_cont(ltv30, 0.99) AS p99, quantile_cont(ltv30, 0.95) AS p95 FROM mart WHERE ltv30 > 0)")


@job("payer_tiers", sql=with_mart(f"""
SELECT segment, COUNT(*) AS users, {_r(_ms('ltv30'), 'total_rev')}, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r('quantile_cont(ltv30, 0.5)', 'median_ltv')}, {_r('MIN(ltv30)', 'min_ltv')}, {_r('MAX(ltv30)', 'max_ltv')},
  {_r(_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 'pct_of_payers')},
  {_r(_ms('ltv30') + ' * 100.0 / NULLIF(SUM(' + _ms('ltv30') + ') OVER (), 0.0)', 'pct_of_revenue')}
FROM (SELECT mart.*, CASE WHEN ltv30 <= qp.p50 THEN '{PAYER_TIERS[0]}' WHEN ltv30 <= qp.p90 THEN '{PAYER_TIERS[1]}'
      WHEN ltv30 <= qp.p99 THEN '{PAYER_TIERS[2]}' ELSE '{PAYER_TIERS[3]}' END AS segment
      FROM mart, qp WHERE ltv30 > 0) t GROUP BY segment""", Q_PAY))
def payer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payer tiers from payer quantiles p50/p90/p99 (right-closed bins)."""
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    c = cutoff_values(m, "ltv30", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    v = F.col("ltv30")
    seg = (F.when(v <= c["p50"], PAYER_TIERS[0]).when(v <= c["p90"], PAYER_TIERS[1])
           .when(v <= c["p99"], PAYER_TIERS[2]).otherwise(PAYER_TIERS[3]))
    x = m.withColumn("segment", seg)
    g = x.groupBy("segment").agg(
        _n().alias("users"), money_sum("ltv30").alias("total_rev"), money_avg("ltv30").alias("avg_ltv"),
        F.min("ltv30").alias("min_ltv"), F.max("ltv30").alias("max_ltv"))
    g = g.join(group_quantiles(x, "segment", "ltv30", {"median_ltv": 0.5}), "segment", "left")
    return round_doubles(g.withColumn("pct_of_payers", _share("users"))
                         .withColumn("pct_of_revenue", _share("total_rev")))


# ---------------------------------------------------------------- P5
SPEND_TIERS = ["Mega-Whale", "Whale", "Mid Payer", "Low Payer", "Non-Payer"]
SKILL_COLS = ["kd_d7", "win_rate_d7", "kills_d7", "avg_score_d7"]
ENG_COLS = ["games_d7", "active_days_d7", "login_rows_d7"]


@job("spend_tier_profile", sql=with_mart(f"""
SELECT spend_tier, COUNT(*) AS users, {', '.join(_r(f'AVG({c})', 'avg_' + c) for c in SKILL_COLS + ENG_COLS)}
FROM (SELECT mart.*, CASE WHEN ltv30 > 0 AND ltv30 >= qp.p99 THEN 'Mega-Whale'
        WHEN ltv30 > 0 AND ltv30 >= qp.p95 THEN 'Whale' WHEN ltv30 > qp.p50 THEN 'Mid Payer'
        WHEN ltv30 > 0 THEN 'Low Payer' ELSE 'Non-Payer' END AS spend_tier FROM mart, qp) t
GROUP BY spend_tier""", Q_PAY))
def spend_tier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: spend tiers with cutoffs over payers (so 'Low Payer' is reachable)."""
    m = user_mart(spark, sf_dir)
    c = cutoff_values(m, "ltv30", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, where=F.col("ltv30") > 0)
    v = F.col("ltv30")
    t = (F.when((v > 0) & (v >= c["p99"]), "Mega-Whale").when((v > 0) & (v >= c["p95"]), "Whale")
         .when(v > c["p50"], "Mid Payer").when(v > 0, "Low Payer").otherwise("Non-Payer"))
    return round_doubles(m.groupBy(t.alias("spend_tier")).agg(
        _n().alias("users"), *[F.avg(f).alias("avg_" + f) for f in SKILL_COLS + ENG_COLS]))


# ---------------------------------------------------------------- P6
@job("quartile_tiers", sql=with_mart("""
, e AS (SELECT DISTINCT unnest([quantile_cont(ltv30, 0.0), quantile_cont(ltv30, 0.25), quantile_cont(ltv30, 0.5),
                              quantile_cont(ltv30, 0.75), quantile_cont(ltv30, 1.0)]) AS edge FROM mart WHERE ltv30 > 0),
b AS (SELECT edge AS lo, LEAD(edge) OVER (ORDER BY edge) AS hi, ROW_NUMBER() OVER (ORDER BY edge) - 1 AS quartile FROM e),
x AS (SELECT m.ltv30, b.quartile FROM mart m JOIN b ON b.hi IS NOT NULL AND m.ltv30 <= b.hi
      AND (m.ltv30 > b.lo OR (b.quartile = 0 AND m.ltv30 >= b.lo)) WHERE m.ltv30 > 0)
SELECT CAST(quartile AS INTEGER) AS quartile, COUNT(*) AS users, ROUND(MIN(ltv30), 6) AS min_ltv,
  ROUND(MAX(ltv30), 6) AS max_ltv,
  ROUND(CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(COUNT(ltv30) AS DOUBLE), 0.0), 6) AS avg_ltv
FROM x GROUP BY quartile"""))
def quartile_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qcut(4) of payers' ltv30 — quantile edges, duplicates dropped, right-closed, lowest included."""
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    c = cutoff_values(m, "ltv30", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0})
    edges = sorted({v for v in c.values() if v is not None})
    if len(edges) < 2:
        return spark.createDataFrame([], "quartile int, users bigint, min_ltv double, max_ltv double, avg_ltv double")
    q = ladder(F.col("ltv30"), edges, list(range(len(edges) - 1)), right_closed=True, include_lowest=True)
    return round_doubles(m.groupBy(q.cast("int").alias("quartile")).agg(
        _n().alias("users"), F.min("ltv30").alias("min_ltv"), F.max("ltv30").alias("max_ltv"),
        money_avg("ltv30").alias("avg_ltv")))


# ---------------------------------------------------------------- P7 / A19–A22
TTP_SEGS = ["D0 (same-day)", "D1-D60", "D61-D179", "Later / Unknown"]
TTP_FEATS = ["games_d7", "active_days_d7", "win_rate_d7", "kd_d7"]


def _ttp_seg():
    o = F.col("first_charge_day_offset_d7")
    return (F.when(o.isNull(), TTP_SEGS[3]).when(o == 0, TTP_SEGS[0]).when(o <= 60, TTP_SEGS[1])
            .otherwise(TTP_SEGS[2]))


TTP_SEG_SQL = (f"CASE WHEN first_charge_day_offset_d7 IS NULL THEN '{TTP_SEGS[3]}' "
               f"WHEN first_charge_day_offset_d7 = 0 THEN '{TTP_SEGS[0]}' "
               f"WHEN first_charge_day_offset_d7 <= 60 THEN '{TTP_SEGS[1]}' ELSE '{TTP_SEGS[2]}' END")


@job("ttp_segments", sql=with_mart(f"""
SELECT timing_seg, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')}, {_r('quantile_cont(ltv30, 0.5)', 'median_ltv')},
  {_r(_ms('ltv30'), 'total_ltv')}, {_r(_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 'pct_payers')},
  {_r(_ms('ltv30') + ' * 100.0 / NULLIF(SUM(' + _ms('ltv30') + ') OVER (), 0.0)', 'rev_share')},
  {_r(_pct(_ci('ltv30 >= q.p95'), 'COUNT(*)'), 'whale_rate_pct')}
FROM (SELECT mart.*, {TTP_SEG_SQL} AS timing_seg FROM mart WHERE ltv30 > 0) t, q
GROUP BY timing_seg, q.p95""", Q_ALL))
def ttp_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-purchase timing segments of payers with value and whale rate (p95 of all users)."""
    m = user_mart(spark, sf_dir)
    p95 = cutoff_values(m, "ltv30", {"p95": 0.95})["p95"]
    x = m.where(F.col("ltv30") > 0).withColumn("timing_seg", _ttp_seg())
    g = x.groupBy("timing_seg").agg(
        _n().alias("users"), money_avg("ltv30").alias("avg_ltv"),
        money_sum("ltv30").alias("total_ltv"), pct(count_if(F.col("ltv30") >= p95), _n()).alias("whale_rate_pct"))
    g = g.join(group_quantiles(x, "timing_seg", "ltv30", {"median_ltv": 0.5}), "timing_seg", "left")
    return round_doubles(g.withColumn("pct_payers", _share("users")).withColumn("rev_share", _share("total_ltv")))


@job("ttp_profile", sql=with_mart(f"""
SELECT {TTP_SEG_SQL} AS timing_seg, {', '.join(_r(f'AVG({c})', 'avg_' + c) for c in TTP_FEATS)}
FROM mart WHERE ltv30 > 0 GROUP BY 1"""))
def ttp_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    return round_doubles(m.groupBy(_ttp_seg().alias("timing_seg")).agg(*[F.avg(c).alias("avg_" + c)
                                                                         for c in TTP_FEATS]))


@job("ttp_by_day", sql=with_mart(f"""
SELECT first_charge_day_offset_d7 AS day, COUNT(*) AS users, {_r(_ma('ltv30'), 'avg_ltv')},
  {_r('quantile_cont(ltv30, 0.5)', 'median_ltv')}
FROM mart WHERE ltv30 > 0 AND first_charge_day_offset_d7 IS NOT NULL GROUP BY 1"""))
def ttp_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = user_mart(spark, sf_dir).where((F.col("ltv30") > 0) & F.col("first_charge_day_offset_d7").isNotNull()) \
        .withColumnRenamed("first_charge_day_offset_d7", "day")
    g = x.groupBy("day").agg(_n().alias("users"), money_avg("ltv30").alias("avg_ltv"))
    return round_doubles(g.join(group_quantiles(x, "day", "ltv30", {"median_ltv": 0.5}), "day", "left"))


@job("ttp_survival", sql=with_mart("""
, p AS (SELECT first_charge_day_offset_d7 AS o FROM mart WHERE ltv30 > 0),
d AS (SELECT CAST(range AS INTEGER) AS day FROM range(0, 180))
SELECT d.day, COUNT(p.o) AS cumulative_payers,
  ROUND(CAST(COUNT(p.o) AS DOUBLE) * 100.0 / NULLIF(CAST((SELECT COUNT(*) FROM p) AS DOUBLE), 0.0), 6) AS pct_converted
FROM d LEFT JOIN p ON p.o <= d.day GROUP BY d.day"""))
def ttp_survival(spark: SparkSession, sf_dir: str, feat_days: int = 180) -> DataFrame:
    """Share of payers who have made their first charge by day D (running sum of a per-day count)."""
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    per_day = m.where(F.col("first_charge_day_offset_d7").isNotNull()).groupBy(
        F.col("first_charge_day_offset_d7").alias("day")).agg(_n().alias("k"))
    payers = m.count()  # one scalar
    days = spark.range(0, feat_days).select(F.col("id").cast("int").alias("day"))  # calendar, ≤ feat_days rows
    x = days.join(per_day, "day", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    cum = F.sum("k").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # ≤ feat_days rows
    x = x.withColumn("cumulative_payers", cum.cast("bigint"))
    return round_doubles(x.select("day", "cumulative_payers",
                                  pct(F.col("cumulative_payers"), F.lit(payers)).alias("pct_converted")))


@job("ttp_opportunity", sql=with_mart(f"""
, s AS (SELECT {TTP_SEG_SQL} AS seg, COUNT(*) AS users, {_ma('ltv30')} AS avg_ltv FROM mart WHERE ltv30 > 0 GROUP BY 1),
e AS (SELECT AVG(avg_ltv) AS early_avg FROM s WHERE seg IN ('{TTP_SEGS[0]}', '{TTP_SEGS[1]}')),
l AS (SELECT users AS late_users, avg_ltv AS late_avg FROM s WHERE seg = '{TTP_SEGS[2]}')
SELECT CAST(FLOOR(l.late_users * 0.1) AS BIGINT) AS shift_users, ROUND(e.early_avg, 6) AS early_avg_ltv,
  ROUND(l.late_avg, 6) AS late_avg_ltv,
  ROUND(CASE WHEN l.late_avg > 0 THEN FLOOR(l.late_users * 0.1) * (e.early_avg - l.late_avg) ELSE 0 END, 6)
    AS incremental_revenue
FROM e, l"""))
def ttp_opportunity(spark: SparkSession, sf_dir: str, shift: float = 0.1) -> DataFrame:
    """Value of moving a share of mid-window first purchasers to early-window value."""
    m = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    s = m.groupBy(_ttp_seg().alias("seg")).agg(_n().alias("users"), money_avg("ltv30").alias("avg_ltv"))
    rows = {r["seg"]: r for r in s.collect()}  # ≤ 4 segment rows
    early = [rows[k]["avg_ltv"] for k in TTP_SEGS[:2] if k in rows and rows[k]["avg_ltv"] is not None]
    late = rows.get(TTP_SEGS[2])
    schema = "shift_users bigint, early_avg_ltv double, late_avg_ltv double, incremental_revenue double"
    if not early or late is None:
        return spark.createDataFrame([], schema)
    early_avg = sum(early) / len(early)
    late_avg = late["avg_ltv"]
    shift_users = int(late["users"] * shift)
    inc = shift_users * (early_avg - late_avg) if late_avg > 0 else 0.0
    return round_doubles(spark.createDataFrame([(shift_users, early_avg, late_avg, float(inc))], schema))


# ---------------------------------------------------------------- A12 / J10 / A13
CWQ_FEATS = ["games_d7", "active_days_d7", "win_rate_d7", "kd_d7"]


def _cwq_spark(spark, sf_dir, min_users, dim="media_source"):
    m = user_mart(spark, sf_dir)
    c = cutoff_values(m, "ltv30", {"p99": 0.99, "p95": 0.95})
    v = F.col("ltv30")
    x = m.withColumn(dim, F.coalesce(F.col(dim), F.lit("unknown")))
    g = x.groupBy(dim).agg(
        _n().alias("users"), money_avg("ltv30").alias("arpu"), money_sum("ltv30").alias("total_ltv"),
        pct(count_if(v > 0), _n()).alias("payer_rate_pct"),
        pct(count_if((v > 0) & (v >= c["p95"])), _n()).alias("whale_rate_pct"),
        pct(count_if((v > 0) & (v >= c["p99"])), _n()).alias("mega_whale_rate_pct"),
        *[F.avg(f).alias("avg_" + f) for f in CWQ_FEATS])
    all_rev = m.agg(money_sum("ltv30")).first()[0]  # one scalar
    g = g.withColumn("rev_share_pct", F.try_divide(F.col("total_ltv") * 100.0, F.nullif(F.lit(all_rev), F.lit(0.0))))
    g = g.where(F.col("users") >= min_users)
    # benchmark = the largest channel (stand-in for 'organic'); ≤ #channels rows
    w = Window.partitionBy()
    bench = F.first(F.col("whale_rate_pct")).over(w.orderBy(F.col("users").desc(), dim)
                                                  .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return g.withColumn("whale_rate_vs_benchmark",
                        F.try_divide(F.col("whale_rate_pct") * 100.0, F.nullif(bench, F.lit(0.0))))


CWQ_SQL = f"""
, g AS (SELECT COALESCE(media_source, 'unknown') AS media_source, COUNT(*) AS users, {_ma('ltv30')} AS arpu,
    {_ms('ltv30')} AS total_ltv, {_pct(_ci('ltv30 > 0'), 'COUNT(*)')} AS payer_rate_pct,
    {_pct(_ci('ltv30 > 0 AND ltv30 >= q.p95'), 'COUNT(*)')} AS whale_rate_pct,
    {_pct(_ci('ltv30 > 0 AND ltv30 >= q.p99'), 'COUNT(*)')} AS mega_whale_rate_pct,
    {', '.join(f'AVG({c}) AS avg_{c}' for c in CWQ_FEATS)},
    {_ms('ltv30')} * 100.0 / NULLIF((SELECT {_ms('ltv30')} FROM mart), 0.0) AS rev_share_pct
  FROM mart, q GROUP BY 1, q.p95, q.p99 HAVING COUNT(*) >= {CHANNEL_MIN_USERS}),
gb AS (SELECT *, whale_rate_pct * 100.0 / NULLIF(FIRST(whale_rate_pct) OVER (ORDER BY users DESC, media_source
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS whale_rate_vs_benchmark FROM g)"""


@job("channel_whale_quality", sql=with_mart(f"""
SELECT media_source, users, {_r('arpu', 'arpu')}, {_r('total_ltv', 'total_ltv')}, {_r('payer_rate_pct', 'payer_rate_pct')},
  {_r('whale_rate_pct', 'whale_rate_pct')}, {_r('mega_whale_rate_pct', 'mega_whale_rate_pct')},
  {', '.join(_r('avg_' + c, 'avg_' + c) for c in CWQ_FEATS)}, {_r('rev_share_pct', 'rev_share_pct')},
  {_r('whale_rate_vs_benchmark', 'whale_rate_vs_benchmark')}
FROM gb""", Q_ALL + CWQ_SQL))
def channel_whale_quality(spark: SparkSession, sf_dir: str, min_users: int = CHANNEL_MIN_USERS) -> DataFrame:
    """Whale and mega-whale rate by channel, revenue share, index vs a benchmark channel."""
    return round_doubles(_cwq_spark(spark, sf_dir, min_users))


OS_BENCHMARK = "EUROPE"


@job("os_whale_quality", sql=with_mart(f"""
SELECT first_os, users, {_r('arpu', 'arpu')}, {_r('total_ltv', 'total_ltv')}, {_r('payer_rate_pct', 'payer_rate_pct')},
  {_r('whale_rate_pct', 'whale_rate_pct')}, {_r('mega_whale_rate_pct', 'mega_whale_rate_pct')}, {_r('rev_share_pct', 'rev_share_pct')},
  {_r("whale_rate_pct * 100.0 / NULLIF((SELECT whale_rate_pct FROM g WHERE first_os = '" + OS_BENCHMARK + "'), 0.0)", 'whale_rate_vs_benchmark')}
FROM g""", Q_ALL + CWQ_SQL.split("gb AS")[0].rstrip().rstrip(",").replace("media_source", "first_os")))
def os_whale_quality(spark: SparkSession, sf_dir: str, min_users: int = CHANNEL_MIN_USERS, benchmark: str = OS_BENCHMARK) -> DataFrame:
    """The same by operating system, against a chosen benchmark (null where the benchmark has too few users)."""
    g = _cwq_spark(spark, sf_dir, min_users, "first_os")
    bench = F.max(F.when(F.col("first_os") == benchmark, F.col("whale_rate_pct"))).over(Window.partitionBy())  # one row a system
    g = g.withColumn("whale_rate_vs_benchmark", F.try_divide(F.col("whale_rate_pct") * 100.0, F.nullif(bench, F.lit(0.0))))
    return round_doubles(g.drop(*["avg_" + f for f in CWQ_FEATS]))


@job("channel_quadrants", sql=with_mart(f"""
SELECT media_source, {_r('whale_rate_pct', 'whale_rate_pct')}, {_r('arpu', 'arpu')},
  CASE WHEN whale_rate_pct >= mw AND arpu >= ma THEN 'Stars' WHEN arpu >= ma THEN 'Cash Cows'
       WHEN whale_rate_pct >= mw THEN 'Whale Farms' ELSE 'Cut' END AS quadrant
FROM (SELECT *, quantile_cont(whale_rate_pct, 0.5) OVER () AS mw, quantile_cont(arpu, 0.5) OVER () AS ma FROM gb) t""",
                                           Q_ALL + CWQ_SQL))
def channel_quadrants(spark: SparkSession, sf_dir: str, min_users: int = CHANNEL_MIN_USERS) -> DataFrame:
    """Channel quadrant vs the median whale rate and median ARPU of channels."""
    g = _cwq_spark(spark, sf_dir, min_users)
    # medians over the channel rows (one per channel: bounded)
    med = g.agg(F.percentile("whale_rate_pct", 0.5).alias("mw"), F.percentile("arpu", 0.5).alias("ma")).first()
    x = g
    mw, ma = F.lit(med["mw"]), F.lit(med["ma"])
    q = (F.when((F.col("whale_rate_pct") >= mw) & (F.col("arpu") >= ma), "Stars")
         .when(F.col("arpu") >= ma, "Cash Cows").when(F.col("whale_rate_pct") >= mw, "Whale Farms")
         .otherwise("Cut"))
    return round_doubles(x.select("media_source", "whale_rate_pct", "arpu", q.alias("quadrant")))


# ---------------------------------------------------------------- P20 / P21
@job("high_skill_nonpayers", sql=with_mart("""
, t AS (SELECT quantile_cont(kd_d7, 0.75) AS kd_t, quantile_cont(win_rate_d7, 0.75) AS wr_t FROM mart)
SELECT ROUND(t.kd_t, 6) AS kd_threshold, ROUND(t.wr_t, 6) AS win_rate_threshold,
  COUNT(CASE WHEN kd_d7 >= t.kd_t AND ltv30 = 0 AND win_rate_d7 >= t.wr_t THEN 1 END) AS users,
  ROUND(CAST(COUNT(CASE WHEN kd_d7 >= t.kd_t AND ltv30 = 0 AND win_rate_d7 >= t.wr_t THEN 1 END) AS DOUBLE) * 100.0
        / NULLIF(CAST(COUNT(*) AS DOUBLE), 0.0), 6) AS pct_users
FROM mart, t GROUP BY t.kd_t, t.wr_t"""))
def high_skill_nonpayers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: non-payers in the top quartile of both K/D and win rate."""
    m = user_mart(spark, sf_dir)
    kd = cutoff_values(m, "kd_d7", {"t": 0.75})["t"]
    wr = cutoff_values(m, "win_rate_d7", {"t": 0.75})["t"]
    cond = (F.col("kd_d7") >= kd) & (F.col("ltv30") == 0) & (F.col("win_rate_d7") >= wr)
    return round_doubles(m.agg(_lit_or_null(kd).alias("kd_threshold"), _lit_or_null(wr).alias("win_rate_threshold"),
                               count_if(cond).alias("users"), pct(count_if(cond), _n()).alias("pct_users")))


@job("skill_segment_map", sql=with_mart("""
, t AS (SELECT quantile_cont(kd_d7, 0.75) AS kd_t FROM mart)
SELECT segment, COUNT(*) AS users, ROUND(AVG(kd_d7), 6) AS avg_kd,
  ROUND(CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(COUNT(ltv30) AS DOUBLE), 0.0), 6) AS avg_ltv
FROM (SELECT mart.*, CASE WHEN ltv30 > 0 AND ltv30 >= q.p95 THEN 'Whale' WHEN ltv30 > 0 THEN 'Low/Mid Payer'
        WHEN kd_d7 >= t.kd_t AND ltv30 = 0 THEN 'High-Skill Non-Payer' ELSE 'Other' END AS segment
      FROM mart, q, t) x GROUP BY segment""", Q_ALL))
def skill_segment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D skill × spend segment over all users (counts, not a plotted sample)."""
    m = user_mart(spark, sf_dir)
    p95 = cutoff_values(m, "ltv30", {"p95": 0.95})["p95"]
    kd = cutoff_values(m, "kd_d7", {"t": 0.75})["t"]
    v = F.col("ltv30")
    seg = (F.when((v > 0) & (v >= p95), "Whale").when(v > 0, "Low/Mid Payer")
           .when((F.col("kd_d7") >= kd) & (v == 0), "High-Skill Non-Payer").otherwise("Other"))
    return round_doubles(m.groupBy(seg.alias("segment")).agg(_n().alias("users"), F.avg("kd_d7").alias("avg_kd"),
                                                             money_avg("ltv30").alias("avg_ltv")))


# ---------------------------------------------------------------- P8 / A17
# Games-played bins of the reference (right-closed, lowest included).
GAMES_EDGES = [0, 1, 5, 10, 20, 50, 100, float("inf")]
GAMES_LABELS = ["0-1", "2-5", "6-10", "11-20", "21-50", "51-100", "100+"]


def _games_bucket_sql():
    parts = []
    for i, lab in enumerate(GAMES_LABELS):
        lo, hi = GAMES_EDGES[i], GAMES_EDGES[i + 1]
        left = f"games_d7 >= {lo}" if i == 0 else f"games_d7 > {lo}"
        right = "" if hi == float("inf") else f" AND games_d7 <= {hi}"
        parts.append(f"WHEN {left}{right} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@job("games_buckets", sql=with_mart(f"""
SELECT games_bucket, COUNT(*) AS users,
  {_r('AVG(CASE WHEN rev_d7 = 0 AND ltv30 > 0 THEN 1.0 ELSE 0.0 END)', 'conv_rate')}, {_r(_ma('ltv30'), 'avg_ltv')}
FROM (SELECT mart.*, {_games_bucket_sql()} AS games_bucket FROM mart WHERE rev_d7 = 0) t GROUP BY games_bucket"""))
def games_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late conversion by games bucket among D7 non-payers."""
    m = user_mart(spark, sf_dir).where(F.col("rev_d7") == 0)
    b = ladder(F.col("games_d7"), GAMES_EDGES, GAMES_LABELS, right_closed=True, include_lowest=True)
    late = F.when(F.col("ltv30") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return round_doubles(m.groupBy(b.alias("games_bucket")).agg(
        _n().alias("users"), F.avg(late).alias("conv_rate"), money_avg("ltv30").alias("avg_ltv")))


ACTIVE_MIN_USERS = 50


@job("active_day_response", sql=with_mart(f"""
SELECT active_days_d7, COUNT(*) AS users,
  {_r('AVG(CASE WHEN ltv30 > 0 THEN 1.0 ELSE 0.0 END)', 'conv_rate')}, {_r(_ma('ltv30'), 'avg_ltv')}
FROM mart WHERE rev_d7 = 0 GROUP BY active_days_d7 HAVING COUNT(*) > {ACTIVE_MIN_USERS}"""))
def active_day_response(spark: SparkSession, sf_dir: str, min_users: int = ACTIVE_MIN_USERS) -> DataFrame:
    """Late conversion by exact active days (groups with more than min_users)."""
    m = user_mart(spark, sf_dir).where(F.col("rev_d7") == 0)
    late = F.when(F.col("ltv30") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return round_doubles(m.groupBy("active_days_d7").agg(
        _n().alias("users"), F.avg(late).alias("conv_rate"), money_avg("ltv30").alias("avg_ltv"))
        .where(F.col("users") > min_users))


@job("dose_response_quantile", sql=with_mart("""
, z AS (SELECT * FROM mart WHERE rev_d7 = 0),
e AS (SELECT DISTINCT unnest([quantile_cont(games_d7, 0.0), quantile_cont(games_d7, 0.2), quantile_cont(games_d7, 0.4),
        quantile_cont(games_d7, 0.6), quantile_cont(games_d7, 0.8), quantile_cont(games_d7, 1.0)]) AS edge FROM z),
b AS (SELECT edge AS lo, LEAD(edge) OVER (ORDER BY edge) AS hi, ROW_NUMBER() OVER (ORDER BY edge) - 1 AS bucket FROM e)
SELECT CAST(b.bucket AS INTEGER) AS bucket, COUNT(*) AS users,
  ROUND(AVG(CASE WHEN z.ltv30 > 0 THEN 1.0 ELSE 0.0 END), 6) AS late_payer_rate, ROUND(AVG(z.games_d7), 6) AS mean_feat
FROM z JOIN b ON b.hi IS NOT NULL AND z.games_d7 <= b.hi AND (z.games_d7 > b.lo OR (b.bucket = 0 AND z.games_d7 >= b.lo))
GROUP BY b.bucket"""))
def dose_response_quantile(spark: SparkSession, sf_dir: str, feature: str = "games_d7", q: int = 5) -> DataFrame:
    """qcut(q) of a feature among D7 non-payers (duplicate edges dropped) → late payer rate."""
    m = user_mart(spark, sf_dir).where(F.col("rev_d7") == 0)
    c = cutoff_values(m, feature, {f"e{i}": i / q for i in range(q + 1)})
    edges = sorted({v for v in c.values() if v is not None})
    if len(edges) < 2:
        return spark.createDataFrame([], "bucket int, users bigint, late_payer_rate double, mean_feat double")
    b = ladder(F.col(feature).cast("double"), edges, list(range(len(edges) - 1)), right_closed=True,
               include_lowest=True)
    late = F.when(F.col("ltv30") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return round_doubles(m.groupBy(b.cast("int").alias("bucket")).agg(
        _n().alias("users"), F.avg(late).alias("late_payer_rate"), F.avg(feature).alias("mean_feat")))


# ---------------------------------------------------------------- P11
@job("ltv_box_by_channel", sql=with_mart("""
, p AS (SELECT * FROM mart WHERE ltv30 > 0),
c AS (SELECT quantile_cont(ltv30, 0.95) AS cap FROM p)
SELECT media_source, COUNT(*) AS users, ROUND(MIN(ltv30), 6) AS min_ltv, ROUND(quantile_cont(ltv30, 0.25), 6) AS q1,
  ROUND(quantile_cont(ltv30, 0.5), 6) AS median_ltv, ROUND(quantile_cont(ltv30, 0.75), 6) AS q3,
  ROUND(MAX(ltv30), 6) AS max_ltv
FROM p, c WHERE ltv30 <= c.cap GROUP BY media_source"""))
def ltv_box_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payers capped at the payer p95, box statistics per channel."""
    p = user_mart(spark, sf_dir).where(F.col("ltv30") > 0)
    cap = cutoff_values(p, "ltv30", {"cap": 0.95})["cap"]
    x = p.where(F.col("ltv30") <= cap)
    g = x.groupBy("media_source").agg(_n().alias("users"), F.min("ltv30").alias("min_ltv"),
                                      F.max("ltv30").alias("max_ltv"))
    q = group_quantiles(x, "media_source", "ltv30", {"q1": 0.25, "median_ltv": 0.5, "q3": 0.75})
    return round_doubles(g.join(q, g.media_source.eqNullSafe(q.media_source), "left").drop(q.media_source))


# ---------------------------------------------------------------- P15 / P16
@job("engagement_score", sql=with_mart("""
, mx AS (SELECT MAX(games_d7) AS mg, MAX(active_days_d7) AS ma, MAX(login_rows_d7) AS ml FROM mart)
SELECT vopenid,
  ROUND(((CASE WHEN mg > 0 THEN games_d7 / mg ELSE 0 END) + (CASE WHEN ma > 0 THEN active_days_d7 / ma ELSE 0 END)
        + (CASE WHEN ml > 0 THEN login_rows_d7 / ml ELSE 0 END)) / 3.0, 6) AS score_mean_of_max,
  ROUND(games_d7 / (mg + 1.0) + active_days_d7 / 8.0 + login_rows_d7 / (ml + 1.0), 6) AS score_weighted
FROM mart, mx"""))
def engagement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engagement scores per user from column maxima (one bounded row, inlined)."""
    m = user_mart(spark, sf_dir)
    mx = m.agg(F.max("games_d7").alias("mg"), F.max("active_days_d7").alias("ma"),
               F.max("login_rows_d7").alias("ml")).first()

    def part(c, k):
        v = mx[k] or 0
        return F.col(c).cast("double") / F.lit(float(v)) if v > 0 else F.lit(0.0)
    a = (part("games_d7", "mg") + part("active_days_d7", "ma") + part("login_rows_d7", "ml")) / 3.0
    b = (F.col("games_d7") / F.lit((mx["mg"] or 0) + 1.0) + F.col("active_days_d7") / 8.0
         + F.col("login_rows_d7") / F.lit((mx["ml"] or 0) + 1.0))
    return round_doubles(m.select("vopenid", a.alias("score_mean_of_max"), b.alias("score_weighted")))


# ---------------------------------------------------------------- P17
# Fixed value: the reference's VND per USD conversion constant.
FX_VND_PER_USD = 24000.0


@job("currency_view", sql=with_mart(f"""
SELECT vopenid, ROUND(ltv30 / {FX_VND_PER_USD}, 6) AS ltv30_usd, ROUND(rev_d7 / {FX_VND_PER_USD}, 6) AS rev_d7_usd
FROM mart"""))
def currency_view(spark: SparkSession, sf_dir: str, fx_rate: float = FX_VND_PER_USD) -> DataFrame:
    m = user_mart(spark, sf_dir)
    return round_doubles(m.select("vopenid", (F.col("ltv30") / fx_rate).alias("ltv30_usd"),
                                  (F.col("rev_d7") / fx_rate).alias("rev_d7_usd")))
