"""S7–S9, V3 as jobs: tables that are written as a version with a manifest, and read back.

Each job writes the next version of its table under the shared folder (one pass) and
returns what the reader of the newest manifest sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import count_if, money_sum, round_doubles
from ..plans.mart import user_mart
from ..session import ensure_checkpoint_dir
from ..sources.writers import read_version, write_version
from ..twins import with_mart
from .cohorts import _ms, _r
from .seeds import SEED_LIST_SQL, seed_list_topk
from .splits import MATURITY_DAYS, OOT_DAYS, ROLE_SQL, SAMPLE_SQL, _dump, assign_roles, oot_truth, split_oot, stratified_sample


def export_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{spark.sparkContext.applicationId}/{name}"


@job("export_splits", sql=with_mart(f"""
SELECT role, COUNT(*) AS users, COUNT(CASE WHEN ltv30 > 0 THEN 1 END) AS payers, {_r(_ms('ltv30'), 'revenue')} FROM rl GROUP BY role""", ROLE_SQL))
def export_splits(spark: SparkSession, sf_dir: str, maturity_days: int = MATURITY_DAYS, path: str | None = None) -> DataFrame:
    """The mart with its role, one folder per role, written in one pass; users, payers and revenue of each role as read back."""
    path = path or export_path(spark, "splits")
    m = user_mart(spark, sf_dir)
    write_version(assign_roles(m, _dump(m), maturity_days), path, partition_by="role")
    return round_doubles(read_version(spark, path).groupBy("role").agg(
        F.count(F.lit(1)).alias("users"), count_if(F.col("ltv30") > 0).alias("payers"), money_sum("ltv30").alias("revenue")))


@job("export_sample", sql=with_mart("SELECT vopenid, CAST(ltv_decile AS INTEGER) AS ltv_decile, ROUND(ltv30, 6) AS ltv30 FROM smp", SAMPLE_SQL))
def export_sample(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """A query's rows (the stratified sample) copied to a file table and read back."""
    path = path or export_path(spark, "sample")
    write_version(stratified_sample(spark, sf_dir).select("vopenid", "ltv_decile", "ltv30"), path)
    return round_doubles(read_version(spark, path))


@job("export_seed_list", sql=SEED_LIST_SQL)
def export_seed_list(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The ranked seed list as CSV in one global order across its files (dealt by ranges of the rank), read back."""
    path = path or export_path(spark, "seed_list")
    write_version(seed_list_topk(spark, sf_dir), path, order_by=["seed_rank"], fmt="csv")
    return round_doubles(read_version(spark, path))


@job("export_oot", sql=with_mart(f"""
SELECT vopenid, install_date, ROUND(rev_d7, 6) AS rev_d7, games_d7, ROUND(ltv30, 6) AS ltv30, is_payer_30
FROM mart, dd WHERE install_date > dd.dump_date - {OOT_DAYS}""", "dd AS (SELECT MAX(install_date) AS dump_date FROM mart)"))
def export_oot(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """V3: the out-of-time scoring frame without labels and the truth kept aside, written as two tables; the truth joined back."""
    path = path or export_path(spark, "oot")
    write_version(split_oot(spark, sf_dir), f"{path}/scoring")
    write_version(oot_truth(spark, sf_dir), f"{path}/truth")
    frame = read_version(spark, f"{path}/scoring").drop("ltv30", "is_payer_30")
    return round_doubles(frame.join(read_version(spark, f"{path}/truth"), "vopenid").select(
        "vopenid", "install_date", "rev_d7", "games_d7", "ltv30", "is_payer_30"))
