"""Spark-vs-DuckDB comparison in the shape of the driver's correctness gate."""

from __future__ import annotations

import math

import duckdb

from expstudy.plans.fixtures import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, round(v, 6))
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return (1, float(v))
    return (2, str(v))


def compare(spark_df, con, sql):
    """Return (ok, message): same column names, row count, and sorted values."""
    pdf = spark_df.toPandas()
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    scols = list(pdf.columns)
    if sorted(c.lower() for c in scols) != sorted(c.lower() for c in ocols):
        return False, f"columns differ: spark={scols} oracle={ocols}"
    order = sorted(scols, key=str.lower)
    o_ix = {c.lower(): i for i, c in enumerate(ocols)}
    srows = sorted(tuple(_norm(None if (isinstance(r[c], float) and False) else _py(r[c])) for c in order)
                   for _, r in pdf.iterrows())
    orow_n = sorted(tuple(_norm(row[o_ix[c.lower()]]) for c in order) for row in orows)
    if len(srows) != len(orow_n):
        return False, f"row count spark={len(srows)} oracle={len(orow_n)}"
    for a, b in zip(srows, orow_n):
        if a != b:
            return False, f"first differing row spark={a} oracle={b}"
    return True, f"{len(srows)} rows"


def _py(v):
    if isinstance(v, float) and math.isnan(v):
        return None  # pandas turns NULL in a float column into NaN
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (str, bytes)) and pd.isna(v) and not isinstance(v, float)):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        v = v.item()
    return v
