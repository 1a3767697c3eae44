"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuescope.session import ensure_checkpoint_dir


#: Rows of a batch between Spark and its Python workers, where the session has Spark's own default: whole texts are long.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame, *columns: str) -> Column:
    """64-bit hash of what these columns hold; with the id it stands for a row."""
    return F.xxhash64(*[c for k in columns for c in (docs[k].cast("string"), docs[k].isNull())])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set no longer
    changes. Every node's neighbours meet only in aggregates and equi-joins,
    never in one list. Nulls are ignored; an empty input gives an empty result.
    """
    und = lambda e: e.union(e.select("b", "a"))
    cur = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = und(cur)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("b", "m").where("b <> m").union(low.select("a", "m"))
        cur = saved(small.toDF("a", "b").distinct())
        now = cur.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if now == mark:
            break
        mark = now
    return cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
