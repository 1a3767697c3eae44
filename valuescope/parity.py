"""Run a job and its DuckDB twin on the same tables and compare results.

Used by the tests and ``tools/parity.py``; mirrors the external check:
column names sorted, row count, order-insensitive multiset of rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        x = round(v, 6)
        if x == int(x) and abs(x) < 1e15:
            return str(int(x))
        return repr(x)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return names, out


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def spark_rows(df):
    rows = df.collect()
    return _rows(df.columns, [tuple(r) for r in rows])


def spark_types(df) -> dict:
    return {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}


def duck_rows(con, sql, types: dict | None = None):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if types is not None:
        types.update({d[0]: str(d[1]) for d in cur.description})
    return _rows(cols, cur.fetchall())


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_names, s_rows = spark_rows(sdf)
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 3)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    d_types: dict = {}
    d_names, d_rows = duck_rows(con, sql, d_types)
    s_types = spark_types(sdf)
    res["duck_rows"] = len(d_rows)
    if s_names != d_names:
        res["status"] = "schema-mismatch"
        res["detail"] = f"spark={s_names} duck={d_names}"
    elif s_types != d_types:
        res["status"] = "type-mismatch"
        res["detail"] = str({k: (s_types.get(k), d_types.get(k)) for k in s_types if s_types.get(k) != d_types.get(k)})
    elif len(s_rows) != len(d_rows):
        res["status"] = "rowcount-mismatch"
    elif s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        res["status"] = "value-mismatch"
        res["detail"] = str(diff)[:1500]
    else:
        res["status"] = "match"
    return res
