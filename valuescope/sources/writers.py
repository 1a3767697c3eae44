"""Tables that are written whole or not at all.

A version is written to a folder of its own, in one pass; only then its manifest
(rows, columns, partition column, folder) is put beside it under the next number.
Readers take the newest manifest, so a job that dies half-way leaves the version
before it readable, and a repeated job writes a new one. Of two writers that finish at
once one gets the number, the other fails and can be repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that have a manifest, oldest first."""
    p, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))


def write_version(df: DataFrame, path: str, partition_by: str | None = None, order_by: list | None = None, fmt: str = "parquet") -> dict:
    """Write ``df`` as the next version of the table at ``path``.

    ``partition_by`` puts each value in a folder; ``order_by`` deals the rows by ranges, so
    that the files in the order of their names hold one global order. Returns the manifest.
    """
    spark = df.sparkSession
    folder = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    w = df.write.format(fmt).option("header", "true")
    (w.partitionBy(partition_by) if partition_by else w).save(folder)
    back = spark.read.format(fmt).schema(df.schema).option("header", "true").load(folder)
    number = (versions(spark, path) or [0])[-1] + 1
    manifest = {"version": number, "folder": folder, "format": fmt, "partition_by": partition_by, "rows": back.count(), "schema": df.schema.jsonValue()}
    if partition_by:
        manifest["parts"] = {str(r[0]): r[1] for r in back.groupBy(partition_by).agg(F.count(F.lit(1))).collect()}  # a row a folder
    p, fs = _fs(spark, f"{path}/manifests/{number:08d}.json")
    out = fs.create(p, False)  # fails if another writer has the number
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    return manifest


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    number = version if version is not None else (versions(spark, path) or [None])[-1]
    if number is None:
        raise FileNotFoundError(f"no finished version at {path}")
    text = "".join(r[0] for r in spark.read.text(f"{path}/manifests/{number:08d}.json", wholetext=True).collect())  # one small file
    return json.loads(text)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    from pyspark.sql import types as T

    m = read_manifest(spark, path, version)
    return spark.read.format(m["format"]).schema(T.StructType.fromJson(m["schema"])).option("header", "true").load(m["folder"])
