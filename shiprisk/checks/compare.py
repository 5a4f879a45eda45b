"""Compare a Spark result with a DuckDB result, order-insensitively."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


# Spark simple type -> DuckDB type name, for the strict schema check.
TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark_df, con, sql: str, strict: bool = True) -> tuple[bool, str]:
    """Same columns, same row count, same multiset of rows.

    ``strict`` also requires equal column types and bit-identical values;
    otherwise floats are compared at 6 decimals.
    """
    s_cols = spark_df.columns
    s_types = dict(spark_df.dtypes)
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_types = {c[0]: str(c[1]) for c in res.description}
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if strict:
        for c, t in s_types.items():
            want = TYPE_NAMES.get(t, t.upper()).replace(" ", "")
            if want != d_types[c].replace(" ", ""):
                return False, f"type of {c}: spark={t} duck={d_types[c]}"
        order = sorted(s_cols)
        a = sorted((tuple(r[s_cols.index(c)] for c in order) for r in s_rows), key=repr)
        b = sorted((tuple(r[d_cols.index(c)] for c in order) for r in d_rows), key=repr)
        if a != b:
            diff = next(((x, y) for x, y in zip(a, b) if x != y), (len(a), len(b)))
            return False, f"values differ (cols {order}): {diff}"
        return True, f"{len(s_rows)} rows (exact)"
    if len(s_rows) != len(d_rows):
        return False, f"row count differ: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff (cols {sorted(s_cols)}):\n spark={x}\n duck ={y}"
    return True, f"{len(s_rows)} rows"


__all__ = ["compare", "duck"]
