"""Readers, day-bounded lake scans, tables bucketed by key, schema checks.

Readers pass an explicit schema so that no footer sampling or inference runs
at scale, and always go through ``select`` so Parquet column pruning applies.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D), ("c_mktsegment", S)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                      ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "benchmark": _schema(("item_id", L), ("text", S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Read one table, schema fixed, only ``cols`` projected."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


@dataclass(frozen=True)
class Lake:
    """A log in a folder, with what its scans can be bounded by.

    ``time`` is the column of the event time as it is stored: a range on it is compared with the
    statistics of row groups. A folder partitioned by time also declares ``partition``, a text
    column, and ``pattern``, the strftime form of its values (one whose texts sort by time).
    """

    path: str
    time: str
    partition: str | None = None
    pattern: str | None = None
    schema: T.StructType | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return (spark.read.schema(self.schema) if self.schema else spark.read).parquet(self.path)

    def between(self, spark: SparkSession, lo: dt.date, hi: dt.date) -> DataFrame:
        """Rows of the days lo (included) to hi (not included). The bounds are literals of the stored type, so that
        they reach the scan; the log is neither copied nor rewritten."""
        df = self.frame(spark)
        kind = df.schema[self.time].dataType
        at = lambda d: F.lit(d.isoformat()).cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else kind)
        if self.partition:
            last = (dt.datetime.combine(hi, dt.time()) - dt.timedelta(microseconds=1)).strftime(self.pattern)
            df = df.where((F.col(self.partition) >= lo.strftime(self.pattern)) & (F.col(self.partition) <= last))
        return df.where((F.col(self.time) >= at(lo)) & (F.col(self.time) < at(hi)))


def bucketed(spark: SparkSession, sf_dir: str, name: str, key: str, buckets: int, fingerprint: str) -> DataFrame:
    """A table written once into ``buckets`` buckets by ``key``, each sorted by it, under the shared folder.

    Two tables with as many buckets join on their keys without an exchange. A lake that keeps its
    logs this way pays for the layout when a day is written, not at each query.
    """
    from ..session import ensure_checkpoint_dir

    app = hashlib.sha1(f"{spark.sparkContext.applicationId}{fingerprint}".encode()).hexdigest()[:12]
    table = f"{name}_by_{key}_{buckets}_{app}"
    if not spark.catalog.tableExists(table):
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed/{table}"
        read_table(spark, sf_dir, name).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
            .option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def require_columns(df: DataFrame, cols) -> None:
    """Plan-time check; raises with the missing names."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def shard_union(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Union shards by name; columns missing in a shard become null."""
    frames = [spark.read.format(fmt).option("header", "true").load(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def coerce_numeric(df: DataFrame, cols, to: str = "double") -> DataFrame:
    """Text-typed numerics → numbers; bad values become null (ANSI-safe)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {to})") for c in cols})


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """One folder per role/partition value."""
    df.write.mode(mode).partitionBy(by).parquet(path)
