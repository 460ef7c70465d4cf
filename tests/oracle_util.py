"""Run a registered query on Spark and its oracle SQL on DuckDB; compare."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

SF001 = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(spark, sf_dir, name, con=None):
    import __spark_entry__ as E
    df = E.queries()[name](spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    res = con.execute(E.oracle_sql()[name])
    d_cols, d_rows = [d[0] for d in res.description], res.fetchall()
    duck_types = {d[0]: str(d[1]).upper() for d in res.description}
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert TYPE_MAP.get(st, st.upper()) == duck_types.get(f.name), (f.name, st, duck_types.get(f.name))
    assert sorted(s_cols) == sorted(d_cols), (s_cols, d_cols)
    a, b = rows(s_cols, s_rows), rows(d_cols, d_rows)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, (set(a) - set(b), set(b) - set(a))
    return len(a)
