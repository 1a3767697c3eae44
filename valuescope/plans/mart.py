"""Raw logs → one feature row per user.

Stand-ins (see FIXTURES.md B2): user = o_custkey; login log = orders;
payments = orders with status 'F'; gameplay log = lineitem reached through
l_orderkey; attribution = customer segment / nation / region.

Plan shape (designed for very large inputs):

* every raw log is pre-aggregated to (user, day[, priority]) with map-side
  partial aggregation first, so a user holding a third of all rows collapses
  to at most one row per day before any shuffle by user;
* the install day d0 is a window ``min(d)`` over the per-user day rows (the
  group is bounded by the calendar, not by the row count), and the feature
  aggregate reuses that hash partitioning — no second exchange;
* the interval join (J1/J2/J3) is an equi-join with the date range as residual:
  in the mart on the order key, with the install day carried by the orders; in
  ``game_features`` on the user key, over pre-aggregated day rows;
* windows are half-open: [d0, d0+feat_days) and [d0, d0+label_days).
"""

from __future__ import annotations

import contextlib
import hashlib
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import MONEY, round_doubles
from ..session import ensure_checkpoint_dir
from ..sources.tables import bucketed, read_table, table_path

FEAT_DAYS = 180
LABEL_DAYS = 720

MART_COLUMNS = [
    "vopenid", "roleid", "install_date", "media_source", "first_country_code", "first_os",
    "login_rows_d7", "active_days_d7", "loginchannel_variety_d7",
    "games_d7", "win_rate_d7", "avg_game_duration_d7", "avg_score_d7", "kills_d7", "deaths_d7", "kd_d7",
    "max_level_game_d7", "rev_d7", "txn_cnt_d7", "first_charge_day_offset_d7", "ltv30", "is_payer_30",
]


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login + payment log at (user, day, priority) grain (pre-aggregated)."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    paid = F.col("o_orderstatus") == F.lit("F")
    return (o.where(F.col("o_custkey").isNotNull())
            .groupBy(F.col("o_custkey").alias("vopenid"), F.to_date("o_orderdate").alias("d"),
                     F.col("o_orderpriority").alias("prio"))
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.min("o_orderkey").alias("first_key"),
                 F.sum(F.when(paid, F.col("o_totalprice").cast(MONEY))).alias("pay"),
                 F.count(F.when(paid & (F.col("o_totalprice") > 0), F.lit(1))).alias("txn")))


def order_features(spark: SparkSession, sf_dir: str, feat_days: int = FEAT_DAYS,
                   label_days: int = LABEL_DAYS) -> DataFrame:
    """cohort, role, login and payment features, label."""
    if feat_days > label_days:
        raise ValueError("feat_days must not exceed label_days")
    daily = orders_daily(spark, sf_dir)
    d0 = F.min("d").over(Window.partitionBy("vopenid"))
    x = daily.withColumn("install_date", d0).where(F.col("d") < F.date_add("install_date", label_days))
    fw = F.col("d") < F.date_add("install_date", feat_days)
    return (x.groupBy("vopenid", "install_date").agg(
        F.min(F.when(F.col("d") == F.col("install_date"), F.col("first_key"))).alias("roleid"),
        F.coalesce(F.sum(F.when(fw, F.col("n_rows"))), F.lit(0)).cast("bigint").alias("login_rows_d7"),
        # distinct days / priorities per user are bounded by the calendar: a set
        # aggregate in the existing per-user partitioning (no Expand, no extra shuffle)
        F.size(F.collect_set(F.when(fw, F.col("d")))).cast("bigint").alias("active_days_d7"),
        F.size(F.collect_set(F.when(fw, F.col("prio")))).cast("bigint").alias("loginchannel_variety_d7"),
        F.coalesce(F.sum(F.when(fw, F.col("pay"))), F.lit(0)).cast("double").alias("rev_d7"),
        F.coalesce(F.sum(F.when(fw, F.col("txn"))), F.lit(0)).cast("bigint").alias("txn_cnt_d7"),
        F.min(F.when(fw & (F.col("txn") > 0), F.datediff("d", "install_date"))).cast("int")
        .alias("first_charge_day_offset_d7"),
        F.coalesce(F.sum("pay"), F.lit(0)).cast("double").alias("ltv30"),
    ).withColumn("is_payer_30", (F.col("ltv30") > 0).cast("int")))


def bucketed_logs(spark: SparkSession, sf_dir: str, buckets: int | None = None):
    """A reader as ``read_table`` whose orders and lineitem are bucketed by order key (J1/F8 without a full-size shuffle)."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}

    def read(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
        return bucketed(spark, sf_dir, name, keys[name], buckets, _source_fingerprint(spark, sf_dir, (name,))).select(*cols)
    return read


def _lineitem_sums() -> list:
    """Game sums of raw lineitem rows."""
    return [F.count(F.lit(1)).alias("games"),
            F.count(F.when(F.col("l_returnflag") == F.lit("R"), F.lit(1))).alias("wins"),
            F.sum(F.col("l_quantity").cast(MONEY)).alias("qty"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).alias("score"),
            F.sum(F.col("l_linenumber").cast("bigint")).alias("lines"),
            F.max("l_linenumber").alias("maxline")]


GAME_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def game_daily(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """Gameplay log at (user, day) grain: lineitem → order owner, pre-aggregated."""
    li = read(spark, sf_dir, "lineitem", GAME_COLUMNS)
    owner = read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    g = li.join(owner, li.l_orderkey == owner.o_orderkey)
    return g.groupBy(F.col("o_custkey").alias("vopenid"), F.to_date("l_shipdate").alias("d")).agg(*_lineitem_sums())


GAME_SUMS = ["games", "wins", "qty", "score", "lines", "maxline"]


def _game_sums() -> list:
    return [(F.max if n == "maxline" else F.sum)(n).alias(f"g_{n}") for n in GAME_SUMS]


def with_games(cohort: DataFrame, gd: DataFrame, feat_days: int, how: str) -> DataFrame:
    """Each row of ``cohort`` (one per user, with install_date) with the sums of its game days inside
    [d0, d0+feat_days): an equi-join on the user with the interval in its condition, then one aggregate in the same
    partitioning. The cohort is read once; with ``how`` left, users without games stay with nulls."""
    gd = gd.withColumnRenamed("vopenid", "_user")
    on = (F.col("vopenid") == F.col("_user")) & (F.col("d") >= F.col("install_date")) & (F.col("d") < F.date_add("install_date", feat_days))
    return cohort.join(gd, on, how).groupBy(*cohort.columns).agg(*_game_sums())


def game_features(spark: SparkSession, sf_dir: str, cohort: DataFrame, feat_days: int = FEAT_DAYS, read=read_table) -> DataFrame:
    """F8: gameplay features inside [d0, d0+feat_days)."""
    return with_games(cohort.select("vopenid", "install_date"), game_daily(spark, sf_dir, read), feat_days, "inner").drop("install_date")


def game_sums(spark: SparkSession, sf_dir: str, feat_days: int = FEAT_DAYS) -> DataFrame:
    """One row per user with the sums of the games inside [d0, d0+feat_days).

    The install day goes with the orders (a narrow log) into the join on the order key, so that the interval is part
    of that join's condition: lineitem is shuffled once, and what is outside the window is never shuffled again.
    The joins of the logs are merge joins at any size: their volume follows the input, without a leap where a side
    outgrows a broadcast, and they can spill."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    first = o.groupBy(F.col("o_custkey").alias("vopenid")).agg(F.min(F.to_date("o_orderdate")).alias("install_date"))
    owner = o.select("o_orderkey", "o_custkey").join(first.hint("merge"), F.col("o_custkey") == F.col("vopenid")).drop("o_custkey")
    li = read_table(spark, sf_dir, "lineitem", GAME_COLUMNS).withColumn("d", F.to_date("l_shipdate")).drop("l_shipdate")
    inside = (F.col("d") >= F.col("install_date")) & (F.col("d") < F.date_add("install_date", feat_days))
    g = li.join(owner.hint("merge"), (F.col("l_orderkey") == F.col("o_orderkey")) & inside)
    return g.groupBy("vopenid").agg(*[c.alias(f"g_{n}") for c, n in zip(_lineitem_sums(), GAME_SUMS)])


def build_user_mart(spark: SparkSession, sf_dir: str, feat_days: int = FEAT_DAYS,
                    label_days: int = LABEL_DAYS) -> DataFrame:
    """assemble the mart (lazy plan, nothing materialised)."""
    base = order_features(spark, sf_dir, feat_days, label_days).join(game_sums(spark, sf_dir, feat_days).hint("merge"), "vopenid", "left")
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    # nation/region are fixed-size dimension tables; Spark's size check
    # (autoBroadcastJoinThreshold on file statistics) broadcasts them.
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = (cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
           .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
           .select(F.col("c_custkey").alias("vopenid"), F.col("c_mktsegment").alias("media_source"),
                   F.col("n_name").alias("first_country_code"), F.col("r_name").alias("first_os")))
    games = F.col("g_games").cast("double")
    m = base.join(geo, "vopenid", "left")
    return m.select(
        "vopenid", "roleid", "install_date", "media_source", "first_country_code", "first_os",
        "login_rows_d7", "active_days_d7", "loginchannel_variety_d7",
        F.coalesce(F.col("g_games"), F.lit(0)).cast("bigint").alias("games_d7"),
        F.coalesce(F.col("g_wins").cast("double") / games, F.lit(0.0)).alias("win_rate_d7"),
        F.coalesce(F.col("g_qty").cast("double") / games, F.lit(0.0)).alias("avg_game_duration_d7"),
        F.coalesce(F.col("g_score").cast("double") / games, F.lit(0.0)).alias("avg_score_d7"),
        F.coalesce(F.col("g_qty").cast("double"), F.lit(0.0)).alias("kills_d7"),
        F.coalesce(F.col("g_lines"), F.lit(0)).cast("bigint").alias("deaths_d7"),
        F.coalesce(F.try_divide(F.col("g_qty").cast("double"),
                                F.nullif(F.col("g_lines").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("kd_d7"),
        F.coalesce(F.col("g_maxline"), F.lit(0)).cast("int").alias("max_level_game_d7"),
        "rev_d7", "txn_cnt_d7", "first_charge_day_offset_d7", "ltv30", "is_payer_30")


_MART_CACHE: dict[tuple, str] = {}
#: Rows of a file of a written table: readers share out files, so few large ones would be read by few tasks.
FILE_ROWS = 100_000
#: Input rows for each shuffle partition of a table that is written; what is read by one task, and the most that small
#: partitions are merged to: a task's memory stays the same whatever the size of the input and the session's partitions.
SHUFFLE_ROWS = 250_000
PARTITIONS = "spark.sql.shuffle.partitions"
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}


def _source_fingerprint(spark: SparkSession, sf_dir: str, tables=("orders", "lineitem", "customer", "nation", "region")) -> str:
    """Digest of the paths, lengths and times of the tables' files, on any Hadoop file system.

    A table of one file is asked for its status. The files of a folder, at any depth, are listed and summed by Spark.
    """
    parts = [sf_dir.rstrip("/")]
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, t))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(table_path(sf_dir, t))
        st = fs.getFileStatus(path)
        if st.isDirectory():
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table_path(sf_dir, t))
            one = F.xxhash64("path", "length", F.col("modificationTime").cast("long")).cast("decimal(20,0)")
            parts += [str(x) for x in files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(one)).first()]  # the content column is not read
        else:
            parts += [str(st.getLen()), str(st.getModificationTime())]
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def _table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table (its _SUCCESS marker) is still present, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@contextlib.contextmanager
def sized_shuffles(spark: SparkSession, rows: int):
    """Inside, shuffles have at least a partition for every SHUFFLE_ROWS of ``rows`` input rows, and tasks take
    TASK_BYTES, where the session names no sizes of its own."""
    before = {k: spark.conf.get(k, None) for k in (PARTITIONS, *TASK_BYTES)}
    try:
        spark.conf.set(PARTITIONS, str(max(int(spark.conf.get(PARTITIONS)), math.ceil(rows / SHUFFLE_ROWS))))
        for k, v in TASK_BYTES.items():
            spark.conf.set(k, before[k] or v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialized(spark: SparkSession, name: str, sf_dir: str, tables, params: tuple, build,
                 partition_by: str | None = None) -> DataFrame:
    """Write ``build()`` once per application as a Parquet table under the
    shared ``spark.checkpoint.dir`` and read it back (cuts lineage; a written
    table survives executor loss, unlike a local checkpoint)."""
    if spark.conf.get("valuescope.mart.materialize", "true") != "true":
        return build()
    app = spark.sparkContext.applicationId
    fp = _source_fingerprint(spark, sf_dir, tables)
    key = (app, name, fp, params)
    path = _MART_CACHE.get(key)
    if path is not None and not _table_exists(spark, path):
        path = None  # the shared folder was cleaned: write the table again
    if path is None:
        root = ensure_checkpoint_dir(spark).rstrip("/")
        ph = hashlib.sha1(repr(params).encode()).hexdigest()[:10]
        path = f"{root}/{name}/{app}/{fp}_{ph}"
        with sized_shuffles(spark, sum(read_table(spark, sf_dir, t).count() for t in tables)):
            w = build()
            if partition_by:
                # rows of one partition value grouped inside each task: few open files per task
                w.sortWithinPartitions(partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
            else:
                w.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        _MART_CACHE[key] = path
    return spark.read.parquet(path)


def user_mart(spark: SparkSession, sf_dir: str, feat_days: int = FEAT_DAYS, label_days: int = LABEL_DAYS,
              materialize: bool | None = None) -> DataFrame:
    """The mart every analysis reads.

    By default it is written once per application as a Parquet table under
    the shared ``spark.checkpoint.dir`` and read back; analyses then start
    from a column-pruned scan instead of rebuilding the joins.
    """
    if materialize is False:
        return build_user_mart(spark, sf_dir, feat_days, label_days)
    return materialized(spark, "mart", sf_dir, ("orders", "lineitem", "customer", "nation", "region"),
                        (feat_days, label_days), lambda: build_user_mart(spark, sf_dir, feat_days, label_days))


def user_mart_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 as a registered query: the full (unmaterialised) build."""
    return round_doubles(build_user_mart(spark, sf_dir))


def derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-user flags used by most analyses."""
    m = user_mart(spark, sf_dir)
    return round_doubles(m.select(
        "vopenid",
        (F.col("rev_d7") > 0).cast("int").alias("is_payer_d7"),
        ((F.col("rev_d7") == 0) & (F.col("ltv30") > 0)).cast("int").alias("is_late_payer"),
        (F.col("ltv30") - F.col("rev_d7")).alias("rev_after_d7"),
        F.date_format("install_date", "EEEE").alias("install_dayname"),
        F.dayofmonth("install_date").alias("install_day_of_month"),
    ))


def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct (user, role) pairs."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey"])
    return o.select(F.col("o_custkey").alias("vopenid"), F.col("o_orderkey").alias("roleid")).distinct()


def cohort_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort day and earliest role per user (min_by with tie-break)."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    return (o.groupBy(F.col("o_custkey").alias("vopenid"))
            .agg(F.min(F.to_date("o_orderdate")).alias("install_date"),
                 F.min_by("o_orderkey", F.struct(F.to_date("o_orderdate"), F.col("o_orderkey"))).alias("roleid")))


def attrib_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest attribution row per user.

    Stand-in: the most recent order per customer (ties → larger order key)
    gives the latest priority; computed as ``max_by`` (partial aggregation,
    skew-safe) instead of a row_number window over a hot user.
    """
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"])
    k = F.struct(F.col("o_orderdate"), F.col("o_orderkey"))
    return (o.groupBy(F.col("o_custkey").alias("vopenid"))
            .agg(F.max("o_orderdate").alias("last_seen_ts"),
                 F.max_by("o_orderkey", k).alias("last_orderkey"),
                 F.max_by("o_orderpriority", k).alias("last_priority")))
