"""Splits, samples and their checks.

Randomness is a multiplicative hash of the integer user id, so a split is
repeatable, independent of partitioning, and recomputes identically after an
executor loss (no ``rand()``). Stratified samples take an exact count per
stratum from the grouped rank of that hash (the reference's "stratified"
sample drew a plain Bernoulli sample; this one is stratified for real).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_avg, money_sum, round_doubles
from ..functions.ranking import cutoff_values, global_rank
from ..plans.mart import MART_COLUMNS, user_mart
from ..twins import with_mart
from .cohorts import _ma, _ms, _r

HASH_MULT = 2654435761
HASH_MOD = 4294967296
TRAIN_FRACTION = 0.8
# Maturity for the split: the reference uses the label window (30 days on
# its data); on these tables almost every user is older than the 720-day
# label window, so the registered jobs use 1460 days (FIXTURES.md B2).
MATURITY_DAYS = 1460


def user_hash(c: str = "vopenid"):
    """Multiplicative hash in [0, 2^32); exact for any id, and ids that are not numbers go by their crc32."""
    number = F.coalesce(F.col(c).try_cast("decimal(20,0)"), F.crc32(F.col(c).cast("string")).cast("decimal(20,0)"))
    return F.pmod(number * F.lit(HASH_MULT).cast("decimal(10,0)"), F.lit(HASH_MOD).cast("decimal(10,0)")).cast("bigint")


def _hash_sql(c: str = "vopenid") -> str:
    return f"CAST((CAST({c} AS HUGEINT) * {HASH_MULT}) % {HASH_MOD} AS BIGINT)"


def assign_roles(m: DataFrame, dump_date, maturity_days: int = MATURITY_DAYS,
                 train_frac: float = TRAIN_FRACTION) -> DataFrame:
    """V1: recent if installed after dump − maturity, else train/test by user hash."""
    cutoff = F.date_sub(F.lit(dump_date), maturity_days)
    pct = F.pmod(user_hash(), F.lit(100))
    return m.withColumn("role", F.when(F.col("install_date") > cutoff, F.lit("recent"))
                        .when(pct < F.lit(int(round(train_frac * 100))), F.lit("train")).otherwise(F.lit("test")))


def _dump(m: DataFrame):
    return m.agg(F.max("install_date")).first()[0]


ROLE_SQL = f"""
dd AS (SELECT MAX(install_date) AS dump_date FROM mart),
rl AS (SELECT mart.*, CASE WHEN install_date > dd.dump_date - {MATURITY_DAYS} THEN 'recent'
         WHEN {_hash_sql('vopenid')} % 100 < {int(TRAIN_FRACTION * 100)} THEN 'train' ELSE 'test' END AS role
       FROM mart, dd)"""


@job("split_maturity", sql=with_mart("SELECT vopenid, install_date, role FROM rl", ROLE_SQL))
def split_maturity(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """V1: per-user role (train / test / recent)."""
    m = user_mart(spark, sf_dir)
    return assign_roles(m, _dump(m), maturity_days).select("vopenid", "install_date", "role")


@job("split_summary", sql=with_mart(f"""
SELECT role, COUNT(*) AS users, {_r('CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER ()', 'share_pct')},
  MIN(install_date) AS first_date, MAX(install_date) AS last_date,
  {_r('CAST(COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*)', 'payer_rate')}, {_r(_ma('ltv30'), 'avg_ltv')}
FROM rl GROUP BY role""", ROLE_SQL))
def split_summary(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """V6: rows, share, dates, payer rate, mean label per role."""
    from pyspark.sql import Window
    m = user_mart(spark, sf_dir)
    r = assign_roles(m, _dump(m), maturity_days)
    g = r.groupBy("role").agg(
        F.count(F.lit(1)).alias("users"), F.min("install_date").alias("first_date"),
        F.max("install_date").alias("last_date"),
        (count_if(F.col("ltv30") > 0).cast("double") / F.count(F.lit(1))).alias("payer_rate"),
        money_avg("ltv30").alias("avg_ltv"))
    return round_doubles(g.withColumn("share_pct", F.col("users").cast("double") * 100.0
                                      / F.sum("users").over(Window.partitionBy())))  # ≤ 3 role rows


@job("dataset_registry", sql=with_mart(f"""
SELECT role AS name, COUNT(*) AS rows, {len(MART_COLUMNS)} AS columns, MIN(dd.dump_date) AS dump_date,
  MIN(dd.dump_date) - {MATURITY_DAYS} AS maturity_cutoff, {MATURITY_DAYS} AS maturity_days,
  {_r('CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER ()', 'pct_of_total')}
FROM rl, dd GROUP BY role""", ROLE_SQL))
def dataset_registry(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """Registry statistics of the three datasets (rows, columns, cutoff, share)."""
    from pyspark.sql import Window
    m = user_mart(spark, sf_dir)
    dump = _dump(m)
    r = assign_roles(m, dump, maturity_days)
    g = r.groupBy(F.col("role").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return round_doubles(g.select(
        "name", "rows", F.lit(len(MART_COLUMNS)).alias("columns"), F.lit(dump).alias("dump_date"),
        F.date_sub(F.lit(dump), maturity_days).alias("maturity_cutoff"), F.lit(maturity_days).alias("maturity_days"),
        (F.col("rows").cast("double") * 100.0 / F.sum("rows").over(Window.partitionBy())).alias("pct_of_total")))


@job("split_overlap", sql=with_mart("""
, tr AS (SELECT vopenid FROM rl WHERE role = 'train'), te AS (SELECT vopenid FROM rl WHERE role = 'test'),
re AS (SELECT vopenid FROM rl WHERE role = 'recent')
SELECT (SELECT COUNT(*) FROM mart) AS total_users, (SELECT COUNT(*) FROM tr) AS train_users,
  (SELECT COUNT(*) FROM te) AS test_users, (SELECT COUNT(*) FROM re) AS recent_users,
  (SELECT COUNT(*) FROM (SELECT vopenid FROM tr INTERSECT SELECT vopenid FROM te)) AS train_test_overlap,
  CAST((SELECT COUNT(*) FROM (SELECT vopenid FROM tr UNION SELECT vopenid FROM te UNION SELECT vopenid FROM re))
       = (SELECT COUNT(*) FROM mart) AS INTEGER) AS union_covers_all""", ROLE_SQL))
def split_overlap(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """Train ∩ test must be empty; train ∪ test ∪ recent must cover every user."""
    m = user_mart(spark, sf_dir)
    r = assign_roles(m, _dump(m), maturity_days).select("vopenid", "role")
    tr, te, re_ = (r.where(F.col("role") == k).select("vopenid") for k in ("train", "test", "recent"))
    overlap = tr.intersect(te).count()
    covered = tr.union(te).union(re_).distinct().count()
    total = m.count()
    return spark.createDataFrame(
        [(total, tr.count(), te.count(), re_.count(), overlap, int(covered == total))],
        "total_users bigint, train_users bigint, test_users bigint, recent_users bigint, "
        "train_test_overlap bigint, union_covers_all int")


@job("split_holdout_anti", sql=with_mart("""
SELECT a.vopenid, a.role FROM rl a WHERE a.vopenid NOT IN (SELECT vopenid FROM rl WHERE role = 'test')""", ROLE_SQL))
def split_holdout_anti(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """Everyone except the held-out test users (left anti join)."""
    m = user_mart(spark, sf_dir)
    r = assign_roles(m, _dump(m), maturity_days).select("vopenid", "role")
    return r.join(r.where(F.col("role") == "test").select("vopenid"), "vopenid", "left_anti")


@job("pool_roles", sql=with_mart("""
SELECT vopenid, 'train' AS pool_role, ROUND(ltv30, 6) AS ltv30 FROM rl WHERE role = 'train'
UNION ALL SELECT vopenid, 'test' AS pool_role, ROUND(ltv30, 6) AS ltv30 FROM rl WHERE role = 'test'""", ROLE_SQL))
def pool_roles(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """Train and test pooled with a role tag (unionByName)."""
    m = user_mart(spark, sf_dir)
    r = assign_roles(m, _dump(m), maturity_days)
    tr = r.where(F.col("role") == "train").select("vopenid", F.lit("train").alias("pool_role"), "ltv30")
    te = r.where(F.col("role") == "test").select("vopenid", F.lit("test").alias("pool_role"), "ltv30")
    return round_doubles(tr.unionByName(te))


# ---------------------------------------------------------------- V2 / V3
EVAL_DAYS = 180
OOT_DAYS = 365


@job("split_temporal", sql=with_mart(f"""
, t AS (SELECT mart.*, CASE WHEN install_date <= dd.dump_date - {MATURITY_DAYS + EVAL_DAYS} THEN 'train'
          WHEN install_date <= dd.dump_date - {MATURITY_DAYS} THEN 'eval' ELSE 'predict' END AS part FROM mart, dd)
SELECT part, COUNT(*) AS users, MIN(install_date) AS first_date, MAX(install_date) AS last_date,
  {_r('CAST(COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*)', 'payer_rate')}
FROM t GROUP BY part""", "dd AS (SELECT MAX(install_date) AS dump_date FROM mart)"))
def split_temporal(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS,
                   eval_days: int = EVAL_DAYS) -> DataFrame:
    """V2: train / eval / predict by install-date boundaries (relative to the dump date)."""
    m = user_mart(spark, sf_dir)
    dump = _dump(m)
    part = (F.when(F.col("install_date") <= F.date_sub(F.lit(dump), maturity_days + eval_days), "train")
            .when(F.col("install_date") <= F.date_sub(F.lit(dump), maturity_days), "eval").otherwise("predict"))
    return round_doubles(m.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("users"), F.min("install_date").alias("first_date"),
        F.max("install_date").alias("last_date"),
        (count_if(F.col("ltv30") > 0).cast("double") / F.count(F.lit(1))).alias("payer_rate")))


@job("split_oot", sql=with_mart(f"""
SELECT vopenid, install_date, ROUND(rev_d7, 6) AS rev_d7, games_d7, active_days_d7,
  CAST(NULL AS DOUBLE) AS ltv30, CAST(NULL AS INTEGER) AS is_payer_30
FROM mart, dd WHERE install_date > dd.dump_date - {OOT_DAYS}""", "dd AS (SELECT MAX(install_date) AS dump_date FROM mart)"))
def split_oot(spark: SparkSession, sf_dir: str, oot_days: int = OOT_DAYS) -> DataFrame:
    """V3: out-of-time scoring frame — latest cohorts with the label removed (truth via ``oot_truth``)."""
    m = user_mart(spark, sf_dir)
    dump = _dump(m)
    x = m.where(F.col("install_date") > F.date_sub(F.lit(dump), oot_days))
    return round_doubles(x.select("vopenid", "install_date", "rev_d7", "games_d7", "active_days_d7",
                                  F.lit(None).cast("double").alias("ltv30"), F.lit(None).cast("int").alias("is_payer_30")))


def oot_truth(spark: SparkSession, sf_dir: str, oot_days: int = OOT_DAYS) -> DataFrame:
    """V3: the labels kept aside for the out-of-time frame."""
    m = user_mart(spark, sf_dir)
    dump = _dump(m)
    return m.where(F.col("install_date") > F.date_sub(F.lit(dump), oot_days)).select("vopenid", "ltv30", "is_payer_30")


# ---------------------------------------------------------------- W2 / V4 / V5 / X9
SAMPLE_RATE = 0.2


def _ntile(rn, n: int, tiles: int = 10):
    """NTILE(tiles) from a 1-based rank: the first n % tiles tiles get one extra row."""
    q, r = n // tiles, n % tiles
    big = r * (q + 1)
    if q == 0:
        return rn.cast("int")
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
        .otherwise(F.lit(r) + F.floor((rn - big - 1) / q) + 1).cast("int")


@job("ltv_deciles", sql=with_mart(f"""
SELECT ltv_decile, COUNT(*) AS users, ROUND(MIN(ltv30), 6) AS min_ltv, ROUND(MAX(ltv30), 6) AS max_ltv,
  {_r(_ma('ltv30'), 'avg_ltv')}, {_r(_ms('ltv30'), 'revenue')}
FROM (SELECT ltv30, CAST(NTILE(10) OVER (ORDER BY ltv30, vopenid) AS INTEGER) AS ltv_decile FROM mart) t
GROUP BY ltv_decile"""))
def ltv_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NTILE(10) by ltv30 (ties by user id) computed from the bucketed global rank."""
    m = user_mart(spark, sf_dir).select("vopenid", "ltv30")
    r = global_rank(m, "ltv30", desc=False)
    x = r.df.withColumn("ltv_decile", _ntile(F.col("rn"), r.n))
    return round_doubles(x.groupBy("ltv_decile").agg(
        F.count(F.lit(1)).alias("users"), F.min("ltv30").alias("min_ltv"), F.max("ltv30").alias("max_ltv"),
        money_avg("ltv30").alias("avg_ltv"), money_sum("ltv30").alias("revenue")))


SAMPLE_SQL = f"""
dec AS (SELECT mart.*, NTILE(10) OVER (ORDER BY ltv30, vopenid) AS ltv_decile FROM mart),
hr AS (SELECT dec.*, ROW_NUMBER() OVER (PARTITION BY ltv_decile ORDER BY {_hash_sql('vopenid')}, vopenid) AS hrn,
         COUNT(*) OVER (PARTITION BY ltv_decile) AS dn FROM dec),
smp AS (SELECT * FROM hr WHERE hrn <= (dn * {round(SAMPLE_RATE * 1000)}) // 1000)"""


def stratified_sample(spark: SparkSession, sf_dir: str, rate: float = SAMPLE_RATE) -> DataFrame:
    """V5: exact `rate` share of every ltv decile, members chosen by user hash."""
    m = user_mart(spark, sf_dir)
    r = global_rank(m, "ltv30", desc=False)
    x = r.df.withColumn("ltv_decile", _ntile(F.col("rn"), r.n)).drop("rn").withColumn("h", user_hash().cast("double"))
    hr = global_rank(x, "h", desc=False, group="ltv_decile")
    permille = round(rate * 1000)
    keep = {r[0]: (r[1] * permille) // 1000 for r in hr.counts.collect()}  # ten deciles
    cond = F.lit(False)
    for g, k in keep.items():
        cond = cond | ((F.col("ltv_decile") == g) & (F.col("rn") <= k))
    return hr.df.where(cond).drop("h", "rn")


@job("sample_stratified", sql=with_mart("""
SELECT vopenid, CAST(ltv_decile AS INTEGER) AS ltv_decile, ROUND(ltv30, 6) AS ltv30 FROM smp""", SAMPLE_SQL))
def sample_stratified(spark: SparkSession, sf_dir: str, rate: float = SAMPLE_RATE) -> DataFrame:
    """The sample itself (a sampling operator: the row subset is the feature)."""
    return round_doubles(stratified_sample(spark, sf_dir, rate).select("vopenid", "ltv_decile", "ltv30"))


ERR_STATS = ["mean", "median", "p90", "p99", "payer_rate"]


@job("sample_error", sql=with_mart(f"""
, fs AS (SELECT {_ma('ltv30')} AS mean, quantile_cont(ltv30, 0.5) AS median, quantile_cont(ltv30, 0.9) AS p90,
           quantile_cont(ltv30, 0.99) AS p99, CAST(COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS payer_rate
         FROM mart),
ss AS (SELECT {_ma('ltv30')} AS mean, quantile_cont(ltv30, 0.5) AS median, quantile_cont(ltv30, 0.9) AS p90,
           quantile_cont(ltv30, 0.99) AS p99, CAST(COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS payer_rate
         FROM smp)
{' UNION ALL '.join(f"SELECT '{s}' AS stat, ROUND(fs.{s}, 6) AS full_value, ROUND(ss.{s}, 6) AS sample_value, ROUND(ABS(ss.{s} - fs.{s}) / NULLIF(ABS(fs.{s}), 0.0) * 100.0, 6) AS abs_error_pct FROM fs, ss" for s in ERR_STATS)}""",
                                     SAMPLE_SQL))
def sample_error(spark: SparkSession, sf_dir: str, rate: float = SAMPLE_RATE) -> DataFrame:
    """Sample-vs-full relative error of the label's mean, quantiles and payer rate."""
    m = user_mart(spark, sf_dir)
    s = stratified_sample(spark, sf_dir, rate)

    def stats(df):
        q = cutoff_values(df, "ltv30", {"median": 0.5, "p90": 0.9, "p99": 0.99})
        a = df.agg(money_avg("ltv30").alias("mean"),
                   (count_if(F.col("ltv30") > 0).cast("double") / F.count(F.lit(1))).alias("payer_rate")).first()
        return {"mean": a["mean"], "payer_rate": a["payer_rate"], **q}
    f, sm = stats(m), stats(s)
    rows = []
    for k in ERR_STATS:
        err = abs(sm[k] - f[k]) / abs(f[k]) * 100.0 if f[k] not in (None, 0) and sm[k] is not None else None
        rows.append((k, f[k], sm[k], err))
    return round_doubles(spark.createDataFrame(rows, "stat string, full_value double, sample_value double, "
                                                     "abs_error_pct double"))


PAY_SQL = f"""
ps AS (SELECT mart.*, ROW_NUMBER() OVER (PARTITION BY is_payer_30 ORDER BY {_hash_sql('vopenid')}, vopenid) AS hrn,
         COUNT(*) OVER (PARTITION BY is_payer_30) AS dn FROM mart)"""


@job("sample_payer_stratified", sql=with_mart(f"""
SELECT vopenid, is_payer_30, ROUND(ltv30, 6) AS ltv30 FROM ps
WHERE hrn <= (dn * {round(SAMPLE_RATE * 1000)}) // 1000""", PAY_SQL))
def sample_payer_stratified(spark: SparkSession, sf_dir: str, rate: float = SAMPLE_RATE) -> DataFrame:
    """V4: proportional sample by payer flag — exactly floor(rate·n) users of each stratum, chosen by user hash."""
    m = user_mart(spark, sf_dir).withColumn("h", user_hash().cast("double"))
    hr = global_rank(m, "h", desc=False, group="is_payer_30")
    permille = round(rate * 1000)
    cond = F.lit(False)
    for g, c in hr.counts.collect():  # two flags
        cond = cond | ((F.col("is_payer_30") == g) & (F.col("rn") <= (c * permille) // 1000))
    return round_doubles(hr.df.where(cond).select("vopenid", "is_payer_30", "ltv30"))
