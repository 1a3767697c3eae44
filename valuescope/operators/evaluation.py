"""Ranking evaluation of scores against the realised label.

All metrics read one long frame ``(strategy, vopenid, score, actual)`` —
one row per user and strategy, built with ``explode`` (no cross join) — and
one grouped global rank (per strategy, score desc, user id asc), so every
strategy is evaluated in the same pass. Strategies: the five single-column
heuristics of the reference, a seeded random order and the oracle (the
label itself). A trained model's scores are appended as one more strategy and
go through ``evaluate_scores`` the same way (``ml.model_vs_heuristics``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, money_sum, round_doubles
from ..functions.ranking import cutoff_values, global_rank, mid_rank_values, mid_ranks, rank_correlation, rank_sums
from ..plans.mart import user_mart
from ..twins import pearson as sql_pearson
from ..twins import with_mart
from .cohorts import _r
from .splits import _hash_sql, user_hash

# The reference's baseline heuristics (single-column scores).
HEURISTICS = ["rev_d7", "login_rows_d7", "active_days_d7", "games_d7", "kd_d7"]
STRATEGIES = HEURISTICS + ["random", "oracle"]


def score_frame(m: DataFrame, label: str = "ltv30", keep: list[str] | None = None) -> DataFrame:
    """Long frame (strategy, vopenid, score, actual[, keep…]) from the mart columns."""
    keep = keep or []
    rnd = user_hash("vopenid").cast("double")  # seeded random order
    items = [F.struct(F.lit(h).alias("strategy"), F.coalesce(F.col(h).cast("double"), F.lit(0.0)).alias("score"))
             for h in HEURISTICS]
    items += [F.struct(F.lit("random").alias("strategy"), rnd.alias("score")),
              F.struct(F.lit("oracle").alias("strategy"), F.col(label).cast("double").alias("score"))]
    x = m.select("vopenid", *keep, F.col(label).alias("actual"), F.explode(F.array(*items)).alias("s"))
    return x.select(F.col("s.strategy").alias("strategy"), "vopenid", F.col("s.score").alias("score"), "actual",
                    *keep)


def _sql_scores(where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    cases = " ".join(f"WHEN '{h}' THEN COALESCE(CAST(m.{h} AS DOUBLE), 0.0)" for h in HEURISTICS)
    return f"""
sc AS (SELECT s.strategy, m.vopenid, m.ltv30 AS actual,
  CASE s.strategy {cases} WHEN 'random' THEN CAST({_hash_sql('m.vopenid')} AS DOUBLE)
  ELSE CAST(m.ltv30 AS DOUBLE) END AS score
  FROM (SELECT * FROM mart{w}) m, (SELECT unnest({STRATEGIES}) AS strategy) s),
rk AS (SELECT strategy, vopenid, actual, score,
  ROW_NUMBER() OVER (PARTITION BY strategy ORDER BY score DESC, vopenid) AS rn,
  CAST(SUM(CAST(actual AS DECIMAL(18,2))) OVER (PARTITION BY strategy ORDER BY score DESC, vopenid
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum FROM sc),
st AS (SELECT strategy, COUNT(*) AS n, CAST(SUM(CAST(actual AS DECIMAL(18,2))) AS DOUBLE) AS total FROM sc
       GROUP BY strategy)"""


def evaluate_scores(sc: DataFrame):
    """Grouped rank (per strategy, score desc, user id) with the running label sum, and per-strategy totals."""
    r = global_rank(sc, "score", desc=True, tiebreak="vopenid", measure="actual", group="strategy")
    st = sc.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), money_sum("actual").alias("total"))
    return r, st


def auc_of(rank: str) -> Column:
    """ROC AUC (Mann-Whitney) as an aggregate over ``mid_rank_values`` of the score with its counts pos and neg."""
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    u = F.sum(F.col(rank) * F.col("pos")) - n_pos * (n_pos + F.lit(1)) / F.lit(2.0)
    return F.try_divide(u, F.nullif(n_pos.cast("double") * n_neg, F.lit(0.0)))


def rank_agreement(sc: DataFrame, group: str) -> DataFrame:
    """(group, spearman, auc) of score and actual, from one row per group and distinct score. ``ra``: the centred ranks
    of the label, where the caller has ranked it once for all strategies; otherwise it is ranked in each group."""
    if "ra" not in sc.columns:
        sc = mid_ranks(sc, "actual", "ra", group=group, centred=True)
    pos = F.col("actual") > 0
    v = mid_rank_values(sc, "score", "rs", group=group, pos=count_if(pos), neg=count_if(~pos), **rank_sums("ra"))
    return v.groupBy(group).agg(rank_correlation("rs").alias("spearman"), auc_of("rs").alias("auc"))


def with_label_rank(m: DataFrame, label: str = "ltv30", group: str | None = None) -> DataFrame:
    """The mart with ``ra``, the centred mid-rank of the label, before users are repeated for each strategy."""
    return mid_ranks(m, label, "ra", group=group, centred=True)


def ranked_scores(spark: SparkSession, sf_dir: str, where=None):
    m = user_mart(spark, sf_dir)
    if where is not None:
        m = m.where(where)
    sc = score_frame(m)
    r, st = evaluate_scores(sc)
    return sc, r, st


def _k(n_col, k10: int):
    """max(1, floor(n·K/100)) with K given in tenths of a percent (integer arithmetic)."""
    return F.greatest(F.lit(1), F.floor(n_col * F.lit(k10) / F.lit(1000))).cast("bigint")


def _k_sql(n, k10: int) -> str:
    return f"GREATEST(1, CAST(({n} * {k10}) // 1000 AS BIGINT))"


def _at_positions(r, st, k10s: list[int]):
    """(strategy, k10, pos, cum) for K values given in tenths of a percent."""
    ks = st.select("strategy", "n", "total", F.explode(F.array(*[F.lit(k) for k in k10s])).alias("k10"))
    ks = ks.withColumn("pos", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("k10") / F.lit(1000))).cast("bigint"))
    hits = r.df.select("strategy", F.col("rn").alias("pos"), "cum")
    return hits.join(F.broadcast(ks), ["strategy", "pos"])  # strategies x K values; every position exists


# ---------------------------------------------------------------- E1
LIFT_POINTS = 100


@job("lift_curve", sql=with_mart(f"""
, p AS (SELECT CAST(range AS INTEGER) AS pct FROM range(1, {LIFT_POINTS + 1}))
SELECT st.strategy, p.pct AS pct_users, {_r('rk.cum * 100.0 / NULLIF(st.total, 0.0)', 'pct_revenue')}
FROM st CROSS JOIN p JOIN rk ON rk.strategy = st.strategy AND rk.rn = {_k_sql('st.n', '(p.pct * 10)')}""",
                                    _sql_scores()))
def lift_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative revenue share captured by the top p% of each strategy's ranking (p = 1..100)."""
    _, r, st = ranked_scores(spark, sf_dir)
    x = _at_positions(r, st, [p * 10 for p in range(1, LIFT_POINTS + 1)])
    return round_doubles(x.select("strategy", (F.col("k10") / 10).cast("int").alias("pct_users"),
                                  F.try_divide(F.col("cum") * 100.0, F.nullif("total", F.lit(0.0))).alias("pct_revenue")))


# ---------------------------------------------------------------- E2 / E8
CAPTURE_K10 = [5, 10, 50, 100]   # 0.5 %, 1 %, 5 %, 10 %


@job("capture_at_k", sql=with_mart(f"""
, k AS (SELECT unnest({CAPTURE_K10}) AS k10)
SELECT st.strategy, {_r('k.k10 / 10.0', 'k_pct')}, {_k_sql('st.n', 'k.k10')} AS users, {_r('rk.cum', 'captured_revenue')},
  {_r('rk.cum * 100.0 / NULLIF(st.total, 0.0)', 'capture_pct')}
FROM st CROSS JOIN k JOIN rk ON rk.strategy = st.strategy AND rk.rn = {_k_sql('st.n', 'k.k10')}""", _sql_scores()))
def capture_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue captured by the top K% (K = 0.5, 1, 5, 10) of each ranking."""
    _, r, st = ranked_scores(spark, sf_dir)
    x = _at_positions(r, st, CAPTURE_K10)
    return round_doubles(x.select("strategy", (F.col("k10") / 10.0).alias("k_pct"), F.col("pos").alias("users"),
                                  F.col("cum").alias("captured_revenue"),
                                  F.try_divide(F.col("cum") * 100.0, F.nullif("total", F.lit(0.0))).alias("capture_pct")))


TOPK_K10 = [10, 50, 100, 200]


@job("topk_vs_oracle", sql=with_mart(f"""
, k AS (SELECT unnest({TOPK_K10}) AS k10),
c AS (SELECT st.strategy, k.k10, rk.cum * 100.0 / NULLIF(st.total, 0.0) AS cap
      FROM st CROSS JOIN k JOIN rk ON rk.strategy = st.strategy AND rk.rn = {_k_sql('st.n', 'k.k10')})
SELECT c.strategy, CAST(c.k10 / 10 AS INTEGER) AS k_pct, {_r('c.cap', 'capture_pct')}, {_r('o.cap', 'oracle_pct')},
  {_r('c.k10 / 10.0', 'random_expected_pct')}, {_r('o.cap - c.cap', 'gap_to_oracle')},
  {_r('c.cap / NULLIF(o.cap, 0.0) * 100.0', 'pct_of_oracle')}
FROM c JOIN c o ON o.strategy = 'oracle' AND o.k10 = c.k10""", _sql_scores()))
def topk_vs_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-K capture of each strategy against the oracle and the random expectation."""
    _, r, st = ranked_scores(spark, sf_dir)
    x = _at_positions(r, st, TOPK_K10).select(
        "strategy", "k10", F.try_divide(F.col("cum") * 100.0, F.nullif("total", F.lit(0.0))).alias("cap"))
    o = x.where(F.col("strategy") == "oracle").select("k10", F.col("cap").alias("ocap"))
    j = x.join(o, "k10")  # ≤ #K rows on the oracle side
    return round_doubles(j.select(
        "strategy", (F.col("k10") / 10).cast("int").alias("k_pct"), F.col("cap").alias("capture_pct"),
        F.col("ocap").alias("oracle_pct"), (F.col("k10") / 10.0).alias("random_expected_pct"),
        (F.col("ocap") - F.col("cap")).alias("gap_to_oracle"),
        (F.try_divide(F.col("cap"), F.nullif("ocap", F.lit(0.0))) * 100.0).alias("pct_of_oracle")))


# ---------------------------------------------------------------- E3
INCR_K10 = [10, 30, 50]
BASELINE = "rev_d7"


@job("capture_incremental", sql=with_mart(f"""
, k AS (SELECT unnest({INCR_K10}) AS k10),
c AS (SELECT st.strategy, k.k10, rk.cum AS rev, rk.cum * 100.0 / NULLIF(st.total, 0.0) AS cap
      FROM st CROSS JOIN k JOIN rk ON rk.strategy = st.strategy AND rk.rn = {_k_sql('st.n', 'k.k10')})
SELECT c.strategy, CAST(c.k10 / 10 AS INTEGER) AS k_pct, {_r('c.cap - b.cap', 'capture_delta_pct')},
  {_r('c.rev - b.rev', 'incremental_revenue')},
  CASE WHEN c.cap - b.cap > 0 THEN 'better' WHEN c.cap - b.cap < 0 THEN 'worse' ELSE 'same' END AS verdict
FROM c JOIN c b ON b.strategy = '{BASELINE}' AND b.k10 = c.k10 WHERE c.strategy <> '{BASELINE}'""", _sql_scores()))
def capture_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture and revenue of each strategy minus the D7-revenue baseline at K = 1, 3, 5 %."""
    _, r, st = ranked_scores(spark, sf_dir)
    x = _at_positions(r, st, INCR_K10).select(
        "strategy", "k10", F.col("cum").alias("rev"),
        F.try_divide(F.col("cum") * 100.0, F.nullif("total", F.lit(0.0))).alias("cap"))
    b = x.where(F.col("strategy") == BASELINE).select("k10", F.col("rev").alias("brev"), F.col("cap").alias("bcap"))
    j = x.where(F.col("strategy") != BASELINE).join(b, "k10")
    d = F.col("cap") - F.col("bcap")
    return round_doubles(j.select(
        "strategy", (F.col("k10") / 10).cast("int").alias("k_pct"), d.alias("capture_delta_pct"),
        (F.col("rev") - F.col("brev")).alias("incremental_revenue"),
        F.when(d > 0, "better").when(d < 0, "worse").otherwise("same").alias("verdict")))


LATE_K10 = [5, 10, 50]   # 0.5 %, 1 %, 5 %
VERDICT_K10 = 50
#: Extra share of the segment's revenue at 5 % that counts as meaningful, and as moderate.
MEANINGFUL, MODERATE = 0.03, 0.01


def incremental_lift(r, st, challengers: list[str] | None = None) -> DataFrame:
    """Each challenger against each heuristic at each K: capture, lift, revenue of the lift, and the verdict of the
    lift at 5 % (one row a strategy, heuristic and K: strategies x 5 x 3)."""
    x = _at_positions(r, st, LATE_K10).select(
        "strategy", "k10", "total", F.try_divide(F.col("cum"), F.nullif("total", F.lit(0.0))).alias("cap"))
    h = x.where(F.col("strategy").isin(HEURISTICS)).select(F.col("strategy").alias("heuristic"), "k10", F.col("cap").alias("hcap"))
    if challengers:
        x = x.where(F.col("strategy").isin(challengers))
    j = x.join(h, "k10").where("strategy <> heuristic")
    lift = F.col("cap") - F.col("hcap")
    at = F.max(F.when(F.col("k10") == VERDICT_K10, lift)).over(Window.partitionBy("strategy", "heuristic"))
    verdict = F.when(at > MEANINGFUL, "meaningful").when(at > MODERATE, "moderate").otherwise("limited")
    return j.select("strategy", "heuristic", (F.col("k10") / 10.0).alias("k_pct"), (F.col("cap") * 100.0).alias("capture_pct"),
                    (F.col("hcap") * 100.0).alias("heuristic_pct"), (lift * 100.0).alias("lift_pct"), (lift * F.col("total")).alias("incremental_revenue"),
                    verdict.alias("verdict"))


@job("capture_incremental_late", sql=with_mart(f"""
, k AS (SELECT unnest({LATE_K10}) AS k10),
c AS (SELECT st.strategy, k.k10, st.total, rk.cum / NULLIF(st.total, 0.0) AS cap
      FROM st CROSS JOIN k JOIN rk ON rk.strategy = st.strategy AND rk.rn = {_k_sql('st.n', 'k.k10')}),
j AS (SELECT c.strategy, h.strategy AS heuristic, c.k10, c.total, c.cap, h.cap AS hcap,
        MAX(CASE WHEN c.k10 = {VERDICT_K10} THEN c.cap - h.cap END) OVER (PARTITION BY c.strategy, h.strategy) AS at5
      FROM c JOIN c h ON h.k10 = c.k10 AND h.strategy IN ({', '.join(repr(x) for x in HEURISTICS)}) AND h.strategy <> c.strategy)
SELECT strategy, heuristic, {_r('k10 / 10.0', 'k_pct')}, {_r('cap * 100.0', 'capture_pct')}, {_r('hcap * 100.0', 'heuristic_pct')},
  {_r('(cap - hcap) * 100.0', 'lift_pct')}, {_r('(cap - hcap) * total', 'incremental_revenue')},
  CASE WHEN at5 > {MEANINGFUL} THEN 'meaningful' WHEN at5 > {MODERATE} THEN 'moderate' ELSE 'limited' END AS verdict
FROM j""", _sql_scores("rev_d7 = 0")))
def capture_incremental_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 among users without D7 revenue: every strategy against every heuristic, with the 3 % / 1 % verdict.
    The trained model takes its place among the strategies in ``model_incremental_late``."""
    _, r, st = ranked_scores(spark, sf_dir, where=F.col("rev_d7") == 0)
    return round_doubles(incremental_lift(r, st))


# ---------------------------------------------------------------- E4
PR_KS = [1, 5, 10, 20]
HIGH_Q = 0.95


@job("precision_recall_at_k", sql=with_mart(f"""
, hq AS (SELECT quantile_cont(ltv30, {HIGH_Q}) AS t FROM mart),
k AS (SELECT unnest({PR_KS}) AS k_pct),
h AS (SELECT rk.strategy, rk.rn, CASE WHEN rk.actual > 0 AND rk.actual >= hq.t THEN 1 ELSE 0 END AS hi FROM rk, hq)
SELECT st.strategy, k.k_pct, {_k_sql('st.n', 'k.k_pct * 10')} AS k_users,
  {_r(f"CAST(SUM(CASE WHEN h.rn <= {_k_sql('st.n', 'k.k_pct * 10')} THEN h.hi ELSE 0 END) AS DOUBLE) / {_k_sql('st.n', 'k.k_pct * 10')}", 'precision')},
  {_r(f"CAST(SUM(CASE WHEN h.rn <= {_k_sql('st.n', 'k.k_pct * 10')} THEN h.hi ELSE 0 END) AS DOUBLE) / NULLIF(CAST(SUM(h.hi) AS DOUBLE), 0.0)", 'recall')}
FROM st CROSS JOIN k JOIN h ON h.strategy = st.strategy GROUP BY st.strategy, k.k_pct, st.n""", _sql_scores()))
def precision_recall_at_k(spark: SparkSession, sf_dir: str, high_q: float = HIGH_Q) -> DataFrame:
    """Precision / recall of the top K% against 'high value' = actual ≥ p95 (and > 0)."""
    m = user_mart(spark, sf_dir)
    t = cutoff_values(m, "ltv30", {"t": high_q})["t"]
    _, r, st = ranked_scores(spark, sf_dir)
    x = r.df.withColumn("hi", ((F.col("actual") > 0) & (F.col("actual") >= t)).cast("int"))
    x = x.join(F.broadcast(st.select("strategy", "n")), "strategy")  # one row per strategy
    aggs = [F.sum("hi").alias("n_hi")]
    for kp in PR_KS:
        aggs.append(F.sum(F.when(F.col("rn") <= _k(F.col("n"), kp * 10), F.col("hi")).otherwise(0)).alias(f"h{kp}"))
    g = x.groupBy("strategy", "n").agg(*aggs)
    rows = [F.struct(F.lit(kp).alias("k_pct"), _k(F.col("n"), kp * 10).alias("k_users"),
                     F.col(f"h{kp}").alias("hits")) for kp in PR_KS]
    long = g.select("strategy", "n_hi", F.explode(F.array(*rows)).alias("r")).select("strategy", "n_hi", "r.*")
    return round_doubles(long.select(
        "strategy", "k_pct", "k_users", (F.col("hits").cast("double") / F.col("k_users")).alias("precision"),
        F.try_divide(F.col("hits").cast("double"), F.nullif(F.col("n_hi").cast("double"), F.lit(0.0))).alias("recall")))


# ---------------------------------------------------------------- E5
CAL_BINS = 10


@job("calibration_bins", sql=with_mart(f"""
, mm AS (SELECT strategy, MIN(score) AS lo, MAX(score) AS hi FROM sc GROUP BY strategy),
b AS (SELECT sc.strategy, sc.score, sc.actual, CASE WHEN mm.hi > mm.lo THEN
        CAST(LEAST(GREATEST(FLOOR((sc.score - mm.lo) * {CAL_BINS} / (mm.hi - mm.lo)), 0), {CAL_BINS - 1}) AS INTEGER)
        ELSE 0 END AS bin FROM sc JOIN mm ON mm.strategy = sc.strategy)
SELECT strategy, bin, COUNT(*) AS users, {_r('AVG(score)', 'mean_score')},
  {_r('CAST(SUM(CAST(actual AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)', 'mean_actual')}
FROM b GROUP BY strategy, bin""", _sql_scores()))
def calibration_bins(spark: SparkSession, sf_dir: str, bins: int = CAL_BINS) -> DataFrame:
    """E5: equal-width score bins per strategy: mean score vs mean realised value."""
    m = user_mart(spark, sf_dir)
    sc = score_frame(m)
    mm = sc.groupBy("strategy").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # one row per strategy
    x = sc.join(F.broadcast(mm), "strategy")
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(F.floor((F.col("score") - F.col("lo")) * F.lit(bins)
                                                                       / (F.col("hi") - F.col("lo"))), F.lit(0)),
                                                  F.lit(bins - 1))).otherwise(F.lit(0))
    return round_doubles(x.groupBy("strategy", b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("users"), F.avg("score").alias("mean_score"), money_avg("actual").alias("mean_actual")))


# ---------------------------------------------------------------- E6
@job("auc_by_strategy", sql=with_mart(f"""
, mr AS (SELECT strategy, actual, RANK() OVER (PARTITION BY strategy ORDER BY score)
           + (COUNT(*) OVER (PARTITION BY strategy, score) - 1) / 2.0 AS r FROM sc)
SELECT strategy, COUNT(CASE WHEN actual > 0 THEN 1 END) AS positives, COUNT(CASE WHEN actual <= 0 THEN 1 END) AS negatives,
  {_r('(SUM(CASE WHEN actual > 0 THEN r ELSE 0 END) - COUNT(CASE WHEN actual > 0 THEN 1 END) * (COUNT(CASE WHEN actual > 0 THEN 1 END) + 1) / 2.0) / NULLIF(CAST(COUNT(CASE WHEN actual > 0 THEN 1 END) AS DOUBLE) * COUNT(CASE WHEN actual <= 0 THEN 1 END), 0.0)', 'auc')}
FROM mr GROUP BY strategy""", _sql_scores()))
def auc_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC for 'payer' (actual > 0) as the Mann–Whitney statistic on mid-ranks of the score."""
    pos = F.col("actual") > 0
    x = mid_rank_values(score_frame(user_mart(spark, sf_dir)), "score", "rs", group="strategy", pos=count_if(pos), neg=count_if(~pos))
    return round_doubles(x.groupBy("strategy").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), auc_of("rs").alias("auc")))


# ---------------------------------------------------------------- E9
@job("model_deciles", sql=with_mart(f"""
SELECT rk.strategy, CAST(((rk.rn - 1) * 10) // st.n AS INTEGER) AS decile, COUNT(*) AS users,
  {_r('CAST(SUM(CAST(rk.actual AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)', 'avg_actual')},
  {_r('CAST(SUM(CAST(rk.actual AS DECIMAL(18,2))) AS DOUBLE) * 100.0 / NULLIF(MIN(st.total), 0.0)', 'revenue_share_pct')}
FROM rk JOIN st ON st.strategy = rk.strategy GROUP BY rk.strategy, 2""", _sql_scores()))
def model_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score deciles per strategy (floor((rank-1)·10/n)): users, mean value, revenue share."""
    _, r, st = ranked_scores(spark, sf_dir)
    x = r.df.join(F.broadcast(st), "strategy")
    d = F.floor((F.col("rn") - 1) * F.lit(10) / F.col("n")).cast("int")
    return round_doubles(x.groupBy("strategy", d.alias("decile")).agg(
        F.count(F.lit(1)).alias("users"), money_avg("actual").alias("avg_actual"),
        F.try_divide(money_sum("actual") * 100.0, F.nullif(F.min("total"), F.lit(0.0))).alias("revenue_share_pct")))


# ---------------------------------------------------------------- E10
DISC_KS = [1, 5, 10, 20]


@job("whale_discovery", sql=with_mart(f"""
, wq AS (SELECT quantile_cont(ltv30, 0.99) AS t FROM mart),
h AS (SELECT rk.strategy, rk.rn, CASE WHEN rk.actual > 0 AND rk.actual >= wq.t THEN 1 ELSE 0 END AS w FROM rk, wq),
k AS (SELECT unnest({DISC_KS}) AS k_pct)
SELECT st.strategy, k.k_pct, {_k_sql('st.n', 'k.k_pct * 10')} AS k_users,
  CAST(SUM(CASE WHEN h.rn <= {_k_sql('st.n', 'k.k_pct * 10')} THEN h.w ELSE 0 END) AS BIGINT) AS whales_found,
  CAST(SUM(h.w) AS BIGINT) AS whales_in_segment,
  {_r(f"CAST(SUM(CASE WHEN h.rn <= {_k_sql('st.n', 'k.k_pct * 10')} THEN h.w ELSE 0 END) AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(h.w) AS DOUBLE), 0.0)", 'discovery_pct')}
FROM st CROSS JOIN k JOIN h ON h.strategy = st.strategy WHERE st.strategy <> 'rev_d7'
GROUP BY st.strategy, k.k_pct, st.n""", _sql_scores("rev_d7 = 0")))
def whale_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among users with no D7 revenue, share of later whales (global p99) found in each ranking's top K%."""
    m = user_mart(spark, sf_dir)
    t = cutoff_values(m, "ltv30", {"t": 0.99})["t"]
    _, r, st = ranked_scores(spark, sf_dir, where=F.col("rev_d7") == 0)
    x = r.df.where(F.col("strategy") != "rev_d7").withColumn(
        "w", ((F.col("actual") > 0) & (F.col("actual") >= t)).cast("int"))
    x = x.join(F.broadcast(st.select("strategy", "n")), "strategy")
    aggs = [F.sum("w").cast("bigint").alias("whales_in_segment")]
    for kp in DISC_KS:
        aggs.append(F.sum(F.when(F.col("rn") <= _k(F.col("n"), kp * 10), F.col("w")).otherwise(0)).alias(f"f{kp}"))
    g = x.groupBy("strategy", "n").agg(*aggs)
    rows = [F.struct(F.lit(kp).alias("k_pct"), _k(F.col("n"), kp * 10).alias("k_users"),
                     F.col(f"f{kp}").cast("bigint").alias("whales_found")) for kp in DISC_KS]
    long = g.select("strategy", "whales_in_segment", F.explode(F.array(*rows)).alias("r")).select(
        "strategy", "whales_in_segment", "r.*")
    return round_doubles(long.select(
        "strategy", "k_pct", "k_users", "whales_found", "whales_in_segment",
        F.try_divide(F.col("whales_found").cast("double") * 100.0,
                     F.nullif(F.col("whales_in_segment").cast("double"), F.lit(0.0))).alias("discovery_pct")))


# ---------------------------------------------------------------- E7
@job("ranking_scorecard", sql=with_mart(f"""
, cap AS (SELECT st.strategy, rk.cum * 100.0 / NULLIF(st.total, 0.0) AS lift10
          FROM st JOIN rk ON rk.strategy = st.strategy AND rk.rn = {_k_sql('st.n', 100)}),
hq AS (SELECT quantile_cont(ltv30, {HIGH_Q}) AS t FROM mart),
pr AS (SELECT rk.strategy,
         CAST(SUM(CASE WHEN rk.rn <= {_k_sql('st.n', 50)} AND rk.actual > 0 AND rk.actual >= hq.t THEN 1 ELSE 0 END) AS DOUBLE)
           / MIN({_k_sql('st.n', 50)}) AS prec5,
         CAST(SUM(CASE WHEN rk.rn <= {_k_sql('st.n', 100)} AND rk.actual > 0 AND rk.actual >= hq.t THEN 1 ELSE 0 END) AS DOUBLE)
           / NULLIF(CAST(SUM(CASE WHEN rk.actual > 0 AND rk.actual >= hq.t THEN 1 ELSE 0 END) AS DOUBLE), 0.0) AS recall10
       FROM rk JOIN st ON st.strategy = rk.strategy, hq GROUP BY rk.strategy),
mr AS (SELECT strategy, actual, RANK() OVER (PARTITION BY strategy ORDER BY score)
         + (COUNT(*) OVER (PARTITION BY strategy, score) - 1) / 2.0 AS rs,
         RANK() OVER (PARTITION BY strategy ORDER BY actual) + (COUNT(*) OVER (PARTITION BY strategy, actual) - 1) / 2.0 AS ra
       FROM sc),
sp AS (SELECT strategy, {sql_pearson('rs', 'ra')} AS spearman,
         (SUM(CASE WHEN actual > 0 THEN rs ELSE 0 END) - COUNT(CASE WHEN actual > 0 THEN 1 END)
           * (COUNT(CASE WHEN actual > 0 THEN 1 END) + 1) / 2.0)
         / NULLIF(CAST(COUNT(CASE WHEN actual > 0 THEN 1 END) AS DOUBLE) * COUNT(CASE WHEN actual <= 0 THEN 1 END), 0.0) AS auc
       FROM mr GROUP BY strategy)
SELECT cap.strategy, {_r('sp.spearman', 'spearman')}, {_r('cap.lift10', 'lift_at_10')}, {_r('o.lift10', 'oracle_at_10')},
  {_r('o.lift10 - cap.lift10', 'gap_to_oracle')}, {_r('pr.prec5', 'precision_at_5')}, {_r('pr.recall10', 'recall_at_10')},
  {_r('sp.auc', 'auc')}
FROM cap JOIN cap o ON o.strategy = 'oracle' JOIN pr ON pr.strategy = cap.strategy JOIN sp ON sp.strategy = cap.strategy""",
                                          _sql_scores()))
def ranking_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per strategy — Spearman, Lift@10, Oracle@10, gap, Precision@5, Recall@10, AUC."""
    m = user_mart(spark, sf_dir)
    t = cutoff_values(m, "ltv30", {"t": HIGH_Q})["t"]
    sc, r, st = ranked_scores(spark, sf_dir)
    x = r.df.join(F.broadcast(st), "strategy").withColumn(
        "hi", ((F.col("actual") > 0) & (F.col("actual") >= t)).cast("int"))
    k5, k10 = _k(F.col("n"), 50), _k(F.col("n"), 100)
    base = x.groupBy("strategy").agg(
        F.max(F.when(F.col("rn") == k10, F.col("cum"))).alias("c10"), F.first("total").alias("total"),
        (F.sum(F.when(F.col("rn") <= k5, F.col("hi")).otherwise(0)).cast("double") / F.min(k5)).alias("precision_at_5"),
        F.try_divide(F.sum(F.when(F.col("rn") <= k10, F.col("hi")).otherwise(0)).cast("double"),
                     F.nullif(F.sum("hi").cast("double"), F.lit(0.0))).alias("recall_at_10"))
    base = base.withColumn("lift_at_10", F.try_divide(F.col("c10") * 100.0, F.nullif("total", F.lit(0.0))))
    sp = rank_agreement(score_frame(with_label_rank(m), keep=["ra"]), "strategy")
    o = base.where(F.col("strategy") == "oracle").select("lift_at_10").first()  # one scalar
    j = base.join(sp, "strategy").withColumn("oracle_at_10", F.lit(o[0] if o else None).cast("double"))
    return round_doubles(j.select("strategy", "spearman", "lift_at_10", "oracle_at_10",
                                  (F.col("oracle_at_10") - F.col("lift_at_10")).alias("gap_to_oracle"),
                                  "precision_at_5", "recall_at_10", "auc"))


# ---------------------------------------------------------------- E13
CURVE_BLOCK = 1_000_000


@job("ranking_checks", sql=with_mart("""
, mono AS (SELECT strategy, MIN(cum - COALESCE(prev, 0.0)) AS min_step FROM
             (SELECT strategy, cum, LAG(cum) OVER (PARTITION BY strategy ORDER BY rn) AS prev FROM rk) t GROUP BY strategy),
full_cap AS (SELECT st.strategy, rk.cum AS c, st.total FROM st JOIN rk ON rk.strategy = st.strategy AND rk.rn = st.n),
zv AS (SELECT COALESCE(VAR_POP(rev_d7), 0.0) AS v FROM mart WHERE rev_d7 = 0)
SELECT f.strategy, CAST(f.c = f.total AS INTEGER) AS capture_at_100_is_full, CAST(mono.min_step >= 0 AS INTEGER) AS curve_monotone,
  CAST(zv.v = 0 AS INTEGER) AS d7_zero_segment_constant
FROM full_cap f JOIN mono ON mono.strategy = f.strategy, zv""", _sql_scores()))
def ranking_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants — capture at 100 % equals the total, curves never decrease, rev_d7 is constant in the D7=0 segment."""
    m = user_mart(spark, sf_dir)
    _, r, st = ranked_scores(spark, sf_dir)
    x = r.df.join(F.broadcast(st), "strategy")
    # steps inside blocks of the curve, then from block to block
    x = x.withColumn("block", F.floor(F.col("rn") / CURVE_BLOCK))
    x = x.withColumn("step", F.col("cum") - F.lag("cum").over(Window.partitionBy("strategy", "block").orderBy("rn")))
    g = x.groupBy("strategy", "block").agg(
        F.max(F.when(F.col("rn") == F.col("n"), F.col("cum"))).alias("c"), F.first("total").alias("total"),
        F.min("step").alias("step"), F.min_by("cum", "rn").alias("lo"), F.max_by("cum", "rn").alias("hi"))
    g = g.withColumn("jump", F.col("lo") - F.lag("hi", 1, 0.0).over(Window.partitionBy("strategy").orderBy("block")))
    g = g.groupBy("strategy").agg(F.max("c").alias("c"), F.first("total").alias("total"), F.min(F.least("step", "jump")).alias("min_step"))
    zv = m.where(F.col("rev_d7") == 0).agg(F.coalesce(F.var_pop("rev_d7"), F.lit(0.0)).alias("v")).first()["v"]
    return g.select("strategy", (F.col("c") == F.col("total")).cast("int").alias("capture_at_100_is_full"),
                    (F.col("min_step") >= 0).cast("int").alias("curve_monotone"),
                    F.lit(int(zv == 0)).alias("d7_zero_segment_constant"))


# ---------------------------------------------------------------- E11 / E12
SEG_MIN_USERS = 50


@job("metrics_by_segment", sql=with_mart(f"""
, seg AS (SELECT first_country_code AS segment FROM mart GROUP BY 1 HAVING COUNT(*) > {SEG_MIN_USERS}),
s2 AS (SELECT sc.*, m.first_country_code AS segment FROM sc JOIN mart m ON m.vopenid = sc.vopenid
       WHERE m.first_country_code IN (SELECT segment FROM seg)),
r2 AS (SELECT segment, strategy, actual, ROW_NUMBER() OVER (PARTITION BY segment, strategy ORDER BY score DESC, vopenid) AS rn,
         CAST(SUM(CAST(actual AS DECIMAL(18,2))) OVER (PARTITION BY segment, strategy ORDER BY score DESC, vopenid
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum,
         COUNT(*) OVER (PARTITION BY segment, strategy) AS n,
         CAST(SUM(CAST(actual AS DECIMAL(18,2))) OVER (PARTITION BY segment, strategy) AS DOUBLE) AS total,
         RANK() OVER (PARTITION BY segment, strategy ORDER BY score) + (COUNT(*) OVER (PARTITION BY segment, strategy, score) - 1) / 2.0 AS rs,
         RANK() OVER (PARTITION BY segment, strategy ORDER BY actual) + (COUNT(*) OVER (PARTITION BY segment, strategy, actual) - 1) / 2.0 AS ra
       FROM s2)
SELECT segment, strategy, COUNT(*) AS users,
  {_r(f"MAX(CASE WHEN rn = {_k_sql('n', 100)} THEN cum END) * 100.0 / NULLIF(MAX(total), 0.0)", 'lift_at_10')},
  {_r(sql_pearson('rs', 'ra'), 'spearman')}
FROM r2 GROUP BY segment, strategy""", _sql_scores()))
def metrics_by_segment(spark: SparkSession, sf_dir: str, min_users: int = SEG_MIN_USERS) -> DataFrame:
    """Lift@10 and Spearman per (country, strategy) for countries with more than min_users users."""
    m = user_mart(spark, sf_dir)
    keep = m.groupBy("first_country_code").agg(F.count(F.lit(1)).alias("u")).where(F.col("u") > min_users)
    mm = m.join(F.broadcast(keep.select("first_country_code")), "first_country_code", "left_semi")  # ≤ #countries
    mm = with_label_rank(mm.withColumnRenamed("first_country_code", "segment"), group="segment")
    sc = score_frame(mm, keep=["segment", "ra"])
    g = group_metrics(sc.withColumn("grp", F.concat_ws("|", "segment", "strategy")), "grp")
    return round_doubles(g.select(F.split("grp", "[|]").getItem(0).alias("segment"),
                                  F.split("grp", "[|]").getItem(1).alias("strategy"), "users", "lift_at_10", "spearman"))


def group_metrics(sc: DataFrame, grp: str) -> DataFrame:
    """(grp, users, lift_at_10 [%], spearman) for a score frame with a group column — one grouped pass."""
    r = global_rank(sc.select(grp, "vopenid", "score", "actual"), "score", desc=True, tiebreak="vopenid", measure="actual", group=grp)
    st = sc.groupBy(grp).agg(F.count(F.lit(1)).alias("n"), money_sum("actual").alias("total"))
    x = r.df.join(st, grp)  # one row per group; Spark's own size check decides about a broadcast
    lift = x.groupBy(grp).agg(F.try_divide(F.max(F.when(F.col("rn") == _k(F.col("n"), 100), F.col("cum"))) * 100.0,
                                           F.nullif(F.max("total"), F.lit(0.0))).alias("lift_at_10"),
                              F.count(F.lit(1)).alias("users"))
    sp = rank_agreement(sc, grp).drop("auc")
    return lift.join(sp, grp)


# ---------------------------------------------------------------- E6 (curve)
@job("roc_curve", sql=with_mart("""
, d AS (SELECT strategy, score, COUNT(CASE WHEN actual > 0 THEN 1 END) AS pos, COUNT(CASE WHEN actual <= 0 THEN 1 END) AS neg
        FROM sc GROUP BY strategy, score),
c AS (SELECT strategy, score, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
        SUM(pos) OVER (PARTITION BY strategy) AS p, SUM(neg) OVER (PARTITION BY strategy) AS nn FROM d
      WINDOW w AS (PARTITION BY strategy ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT strategy, ROUND(score, 6) AS threshold, ROUND(CAST(fp AS DOUBLE) / NULLIF(CAST(nn AS DOUBLE), 0.0), 6) AS fpr,
  ROUND(CAST(tp AS DOUBLE) / NULLIF(CAST(p AS DOUBLE), 0.0), 6) AS tpr FROM c""", _sql_scores()))
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC points per strategy, one per distinct score (descending thresholds); counts per distinct
    score are aggregated first, then accumulated with the bucketed grouped rank."""
    m = user_mart(spark, sf_dir)
    sc = score_frame(m)
    pos = F.col("actual") > 0
    d = sc.groupBy("strategy", "score").agg(count_if(pos).alias("pos"), count_if(~pos).alias("neg"))
    r = global_rank(d, "score", desc=True, tiebreak="score", group="strategy", extra=["pos", "neg"])
    tot = d.groupBy("strategy").agg(F.sum("pos").alias("p"), F.sum("neg").alias("nn"))  # one row per strategy
    x = r.df.join(F.broadcast(tot), "strategy")
    return round_doubles(x.select(
        "strategy", F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.nullif(F.col("nn").cast("double"), F.lit(0.0))).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.nullif(F.col("p").cast("double"), F.lit(0.0))).alias("tpr")))
