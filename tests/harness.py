"""Spark-vs-DuckDB comparison in the spirit of the driver's correctness gate.

Columns are compared by name (sorted), rows order-insensitively after
normalising values to comparable Python objects.
"""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = sdf.collect()
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    out = {"name": name, "spark_rows": len(srows), "oracle_rows": len(orows)}
    out["cols_match"] = sorted(scols) == sorted(ocols)
    if not out["cols_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(scols), sorted(ocols)
        out["match"] = False
        return out
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    oi = [ocols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in oi) for r in orows), key=repr)
    out["match"] = a == b
    if not out["match"]:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_oracle"] = sorted(sb - sa)[:3]
        out["columns"] = order
    return out
