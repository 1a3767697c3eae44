"""X*, K2–K8, W7, W10: concentration, curves, inequality, correlations.

Every global order (ltv desc, ltv asc, mid-ranks) goes through the bucketed
global rank in ``functions.ranking``; nothing sorts all users in one task.
Orders are total (value, then user id) so curve points are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import money_sum, pearson, round_doubles
from ..functions.ranking import global_rank, mid_rank_values, mid_ranks, prefix_sums_at, quantiles, rank_correlation, rank_sums
from ..functions.tails import sql_t_two_sided, t_two_sided
from ..plans.mart import user_mart
from ..twins import pearson as sql_pearson
from ..twins import with_mart
from .cohorts import _r

RANK_DESC = ("rk AS (SELECT vopenid, ltv30, ROW_NUMBER() OVER (ORDER BY ltv30 DESC, vopenid) AS rn, "
             "CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) OVER (ORDER BY ltv30 DESC, vopenid "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum FROM mart), "
             "tot AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM mart)")


def _ranked_desc(spark, sf_dir, where=None):
    m = user_mart(spark, sf_dir).select("vopenid", "ltv30")
    if where is not None:
        m = m.where(where)
    return m, global_rank(m, "ltv30", desc=True, measure="ltv30")


def _total(m: DataFrame) -> float:
    return m.agg(money_sum("ltv30")).first()[0] or 0.0


# ---------------------------------------------------------------- K2
CONC_PCTS = [1, 5, 10, 20, 50]


@job("revenue_concentration", sql=with_mart(f"""
, p AS (SELECT unnest({CONC_PCTS}) AS top_pct)
SELECT p.top_pct, GREATEST(1, CAST(FLOOR(tot.n * p.top_pct / 100) AS BIGINT)) AS users,
  {_r('rk.cum * 100.0 / NULLIF(tot.total, 0.0)', 'revenue_share_pct')}
FROM p, tot JOIN rk ON rk.rn = GREATEST(1, CAST(FLOOR(tot.n * p.top_pct / 100) AS BIGINT))""", RANK_DESC))
def revenue_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: share of revenue held by the top p% of users (k = max(1, floor(n·p/100)))."""
    m, r = _ranked_desc(spark, sf_dir)
    total = _total(m)
    ks = {p: max(1, (r.n * p) // 100) for p in CONC_PCTS}
    pts = prefix_sums_at(r, list(ks.values()))
    pmap = spark.createDataFrame([(p, k) for p, k in ks.items()], "top_pct int, users bigint")
    j = pmap.join(pts, pmap.users == pts.pos)
    return round_doubles(j.select("top_pct", "users", F.try_divide(F.col("cum") * 100.0, F.nullif(F.lit(total), F.lit(0.0)))
                                  .alias("revenue_share_pct")))


# ---------------------------------------------------------------- A25
RISK_NS = [1, 5, 10, 50]


@job("whale_revenue_at_risk", sql=with_mart(f"""
, p AS (SELECT unnest({RISK_NS}) AS whales_lost)
SELECT p.whales_lost, {_r('rk.cum', 'revenue_lost')}, {_r('rk.cum * 100.0 / NULLIF(tot.total, 0.0)', 'pct_of_total')}
FROM p, tot JOIN rk ON rk.rn = LEAST(p.whales_lost, tot.n)""", RANK_DESC))
def whale_revenue_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue lost if the top-N users left."""
    m, r = _ranked_desc(spark, sf_dir)
    total = _total(m)
    ks = {k: min(k, r.n) for k in RISK_NS}
    pts = prefix_sums_at(r, list(ks.values()))
    pmap = spark.createDataFrame([(k, v) for k, v in ks.items()], "whales_lost int, pos bigint")
    j = pmap.join(pts, "pos")
    return round_doubles(j.select("whales_lost", F.col("cum").alias("revenue_lost"),
                                  F.try_divide(F.col("cum") * 100.0, F.nullif(F.lit(total), F.lit(0.0)))
                                  .alias("pct_of_total")))


# ---------------------------------------------------------------- K8 / K4
@job("pareto_top_share", sql=with_mart("""
, pr AS (SELECT vopenid, ltv30, ROW_NUMBER() OVER (ORDER BY ltv30 DESC, vopenid) AS rn,
         CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) OVER (ORDER BY ltv30 DESC, vopenid
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum FROM mart WHERE ltv30 > 0),
pt AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM pr),
k AS (SELECT GREATEST(1, CAST(FLOOR(n * 1 / 100) AS BIGINT)) AS top_n, GREATEST(1, CAST(FLOOR(n * 0.01) AS BIGINT)) AS wk
      FROM pt)
SELECT (SELECT COUNT(*) FROM mart) AS total_users, pt.n AS total_payers, k.top_n,
  ROUND(a.cum * 100.0 / NULLIF(pt.total, 0.0), 6) AS top_revenue_share_pct,
  ROUND(b.ltv30, 6) AS whale_threshold, k.wk AS whale_users,
  ROUND(b.cum * 100.0 / NULLIF(pt.total, 0.0), 6) AS whale_revenue_share_pct
FROM pt, k JOIN pr a ON a.rn = k.top_n JOIN pr b ON b.rn = k.wk"""))
def pareto_top_share(spark: SparkSession, sf_dir: str, top_pct: int = 1) -> DataFrame:
    """K8/K4: share of the top X% of payers; whale threshold = value of the k-th largest payer."""
    mall = user_mart(spark, sf_dir)
    total_users = mall.count()
    m, r = _ranked_desc(spark, sf_dir, where=F.col("ltv30") > 0)
    total = _total(m)
    top_n = max(1, (r.n * top_pct) // 100)
    wk = max(1, int(r.n * 0.01))
    hits = r.df.where(F.col("rn").isin(top_n, wk)).select("rn", "ltv30", "cum")
    a = F.max(F.when(F.col("rn") == top_n, F.col("cum")))
    b = F.max(F.when(F.col("rn") == wk, F.col("cum")))
    bt = F.max(F.when(F.col("rn") == wk, F.col("ltv30")))
    tot = F.nullif(F.lit(total), F.lit(0.0))
    return round_doubles(hits.agg(
        F.lit(total_users).cast("bigint").alias("total_users"), F.lit(r.n).cast("bigint").alias("total_payers"),
        F.lit(top_n).cast("bigint").alias("top_n"), F.try_divide(a * 100.0, tot).alias("top_revenue_share_pct"),
        bt.alias("whale_threshold"), F.lit(wk).cast("bigint").alias("whale_users"),
        F.try_divide(b * 100.0, tot).alias("whale_revenue_share_pct")))


# ---------------------------------------------------------------- K3 / J9
@job("top1_share_scalar", sql=with_mart("""
SELECT ROUND(COALESCE((SELECT CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) FROM rk
   WHERE rn <= (SELECT n // 100 FROM tot)), 0.0) * 100.0 / NULLIF((SELECT total FROM tot), 0.0), 6) AS top1_share_pct""",
                                           RANK_DESC))
def top1_share_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue share of the top n//100 users against a scalar total."""
    m, r = _ranked_desc(spark, sf_dir)
    total = _total(m)
    k = r.n // 100
    top = r.df.where(F.col("rn") <= k).agg(F.coalesce(money_sum("ltv30"), F.lit(0.0)).alias("s"))
    return round_doubles(top.select(F.try_divide(F.col("s") * 100.0, F.nullif(F.lit(total), F.lit(0.0)))
                                    .alias("top1_share_pct")))


# ---------------------------------------------------------------- K7
DECILE_CUTS = [1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]


def _decile_bounds(n):
    out = []
    for p in DECILE_CUTS:
        end = max(1, (n * p) // 100)
        prev = p - 10 if p >= 20 else 0
        start = (n * prev) // 100
        out.append((p, start, end))
    return out


@job("revenue_deciles", sql=with_mart(f"""
, c AS (SELECT unnest({DECILE_CUTS}) AS top_pct),
b AS (SELECT top_pct, CAST(FLOOR(tot.n * CASE WHEN top_pct >= 20 THEN top_pct - 10 ELSE 0 END / 100) AS BIGINT) AS start_pos,
      GREATEST(1, CAST(FLOOR(tot.n * top_pct / 100) AS BIGINT)) AS end_pos FROM c, tot)
SELECT b.top_pct, b.start_pos, b.end_pos,
  {_r('e.cum - COALESCE(s.cum, 0.0)', 'decile_revenue')}, {_r('(e.cum - COALESCE(s.cum, 0.0)) * 100.0 / NULLIF(tot.total, 0.0)', 'pct_of_total')},
  {_r('e.cum', 'cum_revenue')}, {_r('e.cum * 100.0 / NULLIF(tot.total, 0.0)', 'cum_pct')}
FROM b CROSS JOIN tot JOIN rk e ON e.rn = b.end_pos LEFT JOIN rk s ON s.rn = b.start_pos""", RANK_DESC))
def revenue_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: revenue by top-p% slices of users (descending ltv) with cumulative share."""
    m, r = _ranked_desc(spark, sf_dir)
    total = _total(m)
    bounds = _decile_bounds(r.n)
    pts = prefix_sums_at(r, [s for _, s, _ in bounds] + [e for _, _, e in bounds])
    b = spark.createDataFrame(bounds, "top_pct int, start_pos bigint, end_pos bigint")
    e = pts.select(F.col("pos").alias("end_pos"), F.col("cum").alias("ce"))
    s = pts.select(F.col("pos").alias("start_pos"), F.col("cum").alias("cs"))
    j = b.join(e, "end_pos").join(s, "start_pos", "left")
    tot = F.nullif(F.lit(total), F.lit(0.0))
    rev = F.col("ce") - F.coalesce("cs", F.lit(0.0))
    return round_doubles(j.select("top_pct", "start_pos", "end_pos", rev.alias("decile_revenue"),
                                  F.try_divide(rev * 100.0, tot).alias("pct_of_total"), F.col("ce").alias("cum_revenue"),
                                  F.try_divide(F.col("ce") * 100.0, tot).alias("cum_pct")))


# ---------------------------------------------------------------- X5 / X6
RANK_ASC = ("ra AS (SELECT ltv30, ROW_NUMBER() OVER (ORDER BY ltv30, vopenid) AS rn, "
            "CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) OVER (ORDER BY ltv30, vopenid "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum FROM mart), "
            "tot AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM mart)")


@job("gini", sql=with_mart("""
SELECT tot.n AS n, ROUND(CASE WHEN tot.total > 0 THEN 2.0 * CAST(SUM(ra.rn * CAST(ra.ltv30 AS DECIMAL(18,2))) AS DOUBLE)
  / (CAST(tot.n AS DOUBLE) * tot.total) - (CAST(tot.n AS DOUBLE) + 1.0) / CAST(tot.n AS DOUBLE) ELSE 0.0 END, 6) AS gini
FROM ra, tot GROUP BY tot.n, tot.total""", RANK_ASC))
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gini of ltv30 from the rank-weighted sum over the ascending order."""
    m = user_mart(spark, sf_dir).select("vopenid", "ltv30")
    r = global_rank(m, "ltv30", desc=False)
    total = _total(m)
    n = float(r.n)
    sw = F.sum(F.col("rn") * F.col("ltv30").cast("decimal(18,2)")).cast("double")
    g = F.lit(2.0) * sw / (F.lit(n) * F.lit(total)) - (F.lit(n) + 1.0) / F.lit(n) if total > 0 else F.lit(0.0)
    return round_doubles(r.df.agg(F.lit(r.n).cast("bigint").alias("n"), g.alias("gini")))


@job("lorenz_curve", sql=with_mart("""
, p AS (SELECT CAST(range AS INTEGER) AS pct_users FROM range(0, 101)),
pp AS (SELECT pct_users, CAST(FLOOR(tot.n * pct_users / 100) AS BIGINT) AS pos FROM p, tot)
SELECT pp.pct_users, ROUND(COALESCE(ra.cum, 0.0) * 100.0 / NULLIF(tot.total, 0.0), 6) AS pct_revenue
FROM pp CROSS JOIN tot LEFT JOIN ra ON ra.rn = pp.pos""", RANK_ASC))
def lorenz_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of revenue held by the bottom p% of users, p = 0..100."""
    m = user_mart(spark, sf_dir).select("vopenid", "ltv30")
    r = global_rank(m, "ltv30", desc=False, measure="ltv30")
    total = _total(m)
    pos = [(p, (r.n * p) // 100) for p in range(101)]
    pts = prefix_sums_at(r, [q for _, q in pos])
    pm = spark.createDataFrame(pos, "pct_users int, pos bigint")
    return round_doubles(pm.join(pts, "pos").select(
        "pct_users", F.try_divide(F.col("cum") * 100.0, F.nullif(F.lit(total), F.lit(0.0))).alias("pct_revenue")))


@job("pareto_curve", sql=with_mart("""
, pr AS (SELECT ltv30, ROW_NUMBER() OVER (ORDER BY ltv30 DESC, vopenid) AS rn,
         CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) OVER (ORDER BY ltv30 DESC, vopenid
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum FROM mart WHERE ltv30 > 0),
pt AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(ltv30 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM pr),
k AS (SELECT LEAST(200, n) AS k, n FROM pt),
pos AS (SELECT CAST(CASE WHEN k.k > 1 THEN (range * (k.n - 1)) // (k.k - 1) ELSE 0 END + 1 AS BIGINT) AS rn
        FROM k, range(0, (SELECT k FROM k)))
SELECT pr.rn, ROUND(CAST(pr.rn AS DOUBLE) * 100.0 / CAST(pt.n AS DOUBLE), 6) AS pct_users,
  ROUND(pr.cum * 100.0 / NULLIF(pt.total, 0.0), 6) AS pct_revenue
FROM pos JOIN pr ON pr.rn = pos.rn CROSS JOIN pt"""))
def pareto_curve(spark: SparkSession, sf_dir: str, points: int = 200) -> DataFrame:
    """Cumulative revenue share of payers by rank, sampled at ≤ 200 evenly spaced ranks."""
    m, r = _ranked_desc(spark, sf_dir, where=F.col("ltv30") > 0)
    total = _total(m)
    k = min(points, r.n)
    idx = [(i * (r.n - 1)) // (k - 1) + 1 if k > 1 else 1 for i in range(k)] if k > 0 else []
    pts = prefix_sums_at(r, idx)
    return round_doubles(pts.where(F.col("pos") > 0).select(
        F.col("pos").alias("rn"), (F.col("pos").cast("double") * 100.0 / F.lit(float(max(r.n, 1)))).alias("pct_users"),
        F.try_divide(F.col("cum") * 100.0, F.nullif(F.lit(total), F.lit(0.0))).alias("pct_revenue")))


# ---------------------------------------------------------------- X7
QT_QS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
QT_SPECS = [("ltv30", "all", None), ("ltv30", "payers", "ltv30 > 0"), ("rev_d7", "all", None),
            ("rev_d7", "d7_payers", "rev_d7 > 0")]


@job("quantile_table", sql=with_mart(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, '{pop}' AS population, COUNT(*) AS n,
  {', '.join(_r(f'quantile_cont({c}, {q})', a) for a, q in QT_QS.items())}
FROM mart{' WHERE ' + w if w else ''}""" for c, pop, w in QT_SPECS)))
def quantile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantile thresholds (linear interpolation) of revenue columns by population."""
    m = user_mart(spark, sf_dir)
    out = None
    for c, pop, w in QT_SPECS:
        base = m.where(w) if w else m
        q = quantiles(base.select("vopenid", c), c, QT_QS)
        n = base.count()
        row = q.select(F.lit(c).alias("column_name"), F.lit(pop).alias("population"),
                       F.lit(n).cast("bigint").alias("n"), *QT_QS.keys())
        out = row if out is None else out.unionByName(row)
    return round_doubles(out)


# ---------------------------------------------------------------- X1 / X2
CORR_FEATURES = ["login_rows_d7", "active_days_d7", "loginchannel_variety_d7", "games_d7", "win_rate_d7",
                 "avg_game_duration_d7", "avg_score_d7", "kills_d7", "deaths_d7", "kd_d7", "max_level_game_d7",
                 "rev_d7", "txn_cnt_d7", "first_charge_day_offset_d7"]


@job("pearson_features", sql=with_mart(f"""
, p AS (SELECT unnest([{', '.join(repr(f) for f in CORR_FEATURES)}]) AS feature,
        unnest([{', '.join(sql_pearson(f, 'ltv30') for f in CORR_FEATURES)}]) AS pearson FROM mart)
SELECT feature, ROUND(pearson, 6) AS pearson,
  CAST(ROW_NUMBER() OVER (ORDER BY ABS(ROUND(pearson, 6)) DESC NULLS LAST, feature) AS INTEGER) AS abs_rank FROM p"""))
def pearson_features(spark: SparkSession, sf_dir: str, label: str = "ltv30") -> DataFrame:
    """Pearson of each feature with the label in one aggregate, ranked by |r|."""
    m = user_mart(spark, sf_dir)
    wide = round_doubles(m.agg(*[pearson(f, label).alias(f) for f in CORR_FEATURES]))
    long = wide.unpivot([], CORR_FEATURES, "feature", "pearson")
    from pyspark.sql import Window
    w = Window.orderBy(F.abs("pearson").desc_nulls_last(), "feature")  # ≤ #features rows
    return long.withColumn("abs_rank", F.row_number().over(w).cast("int"))


def spearman_long(long: DataFrame, group: str) -> DataFrame:
    """Spearman per group of a long frame (group, x, y), complete pairs only: y gets its ranks, those of x are
    weighed by the sums of each distinct x. One grouped rank pass serves every group."""
    base = long.where(F.col("x").isNotNull() & F.col("y").isNotNull()) \
        .select(group, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _rho(mid_ranks(base, "y", "ry", group=group, centred=True), group)


def _rho(ranked: DataFrame, group: str) -> DataFrame:
    """(group, n, rho) of x with the centred ranks ry."""
    v = mid_rank_values(ranked, "x", "rx", group=group, **rank_sums("ry"))
    return v.groupBy(group).agg(F.sum("_c").alias("n"), rank_correlation("rx").alias("rho"))


@job("spearman_features", sql=with_mart(" UNION ALL ".join(f"""
SELECT '{f}' AS feature, COUNT(*) AS n, ROUND({sql_pearson('rx', 'ry')}, 6) AS spearman FROM (
  SELECT RANK() OVER (ORDER BY {f}) + (COUNT(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS rx,
         RANK() OVER (ORDER BY ltv30) + (COUNT(*) OVER (PARTITION BY ltv30) - 1) / 2.0 AS ry
  FROM mart WHERE {f} IS NOT NULL AND ltv30 IS NOT NULL) t""" for f in CORR_FEATURES)))
def spearman_features(spark: SparkSession, sf_dir: str, label: str = "ltv30") -> DataFrame:
    """Spearman of each feature with the label (mid-ranks for ties)."""
    m = user_mart(spark, sf_dir).select(label, *CORR_FEATURES)
    n = m.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c) for c in (label, *CORR_FEATURES)]).first().asDict()
    whole = [f for f in CORR_FEATURES if n[f"count({f})"] == n[f"count({label})"] == n["_n"]]
    rest = [f for f in CORR_FEATURES if f not in whole]

    def long(df: DataFrame, features: list[str], y: str) -> DataFrame:
        kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("kv")
        return df.select(F.col(y).alias("y"), kv).select("kv.feature", "kv.x", "y")
    parts = []
    if whole:  # every row is a complete pair: the label is ranked once for all of these
        ranked = mid_ranks(m.withColumn(label, F.col(label).cast("double")), label, "ry", centred=True)
        parts.append(_rho(long(ranked, whole, "ry").withColumnRenamed("y", "ry"), "feature"))
    if rest:
        parts.append(spearman_long(long(m, rest, label), "feature"))
    r = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return round_doubles(r.select("feature", "n", F.col("rho").alias("spearman")))


SKILL = ["kd_d7", "win_rate_d7", "kills_d7", "avg_score_d7"]
SPEND = ["rev_d7", "ltv30", "txn_cnt_d7"]
MIN_PAIRS = 30


@job("skill_spend_matrix", sql=with_mart("SELECT skill_feature, spend_feature, n, ROUND(rho, 6) AS spearman, ROUND(t, 6) AS t_stat, "
                                         "ROUND(p, 6) AS p_value, CAST(p < 0.05 AS INTEGER) AS significant FROM (SELECT *, "
                                         + sql_t_two_sided("t", "(n - 2.0)") + " AS p FROM (" + " UNION ALL ".join(f"""
SELECT '{sk}' AS skill_feature, '{sp}' AS spend_feature, n, rho,
  rho * SQRT((n - 2) / NULLIF(1.0 - rho * rho, 0.0)) AS t
FROM (SELECT COUNT(*) AS n, {sql_pearson('rx', 'ry')} AS rho FROM (
  SELECT RANK() OVER (ORDER BY {sk}) + (COUNT(*) OVER (PARTITION BY {sk}) - 1) / 2.0 AS rx,
         RANK() OVER (ORDER BY {sp}) + (COUNT(*) OVER (PARTITION BY {sp}) - 1) / 2.0 AS ry
  FROM mart WHERE {sk} IS NOT NULL AND {sp} IS NOT NULL AND {sk} >= 0 AND {sp} >= 0) t) u
WHERE n >= {MIN_PAIRS}""" for sk in SKILL for sp in SPEND) + ") w) z"))
def skill_spend_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman skill × spend over non-negative complete pairs (n ≥ 30), t statistic, two-sided p-value, p < 0.05 flag."""
    m = user_mart(spark, sf_dir).select(*SKILL, *SPEND)
    pairs = [F.struct(F.lit(sk).alias("sk"), F.lit(sp).alias("sp"), F.col(sk).cast("double").alias("x"),
                      F.col(sp).cast("double").alias("y")) for sk in SKILL for sp in SPEND]
    long = m.select(F.explode(F.array(*pairs)).alias("kv")).select(
        F.concat_ws("|", "kv.sk", "kv.sp").alias("pair"), "kv.x", "kv.y").where((F.col("x") >= 0) & (F.col("y") >= 0))
    r = spearman_long(long, "pair").where(F.col("n") >= MIN_PAIRS)
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - F.lit(2.0), F.nullif(1.0 - F.col("rho") * F.col("rho"),
                                                                               F.lit(0.0))))
    p = t_two_sided(t, F.col("n") - 2)
    return round_doubles(r.select(
        F.split("pair", "[|]").getItem(0).alias("skill_feature"), F.split("pair", "[|]").getItem(1).alias("spend_feature"),
        "n", F.col("rho").alias("spearman"), t.alias("t_stat"), p.alias("p_value"), (p < 0.05).cast("int").alias("significant")))
