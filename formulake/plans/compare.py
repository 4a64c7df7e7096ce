"""Compare a Spark result with its SQL twin, as values."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "item"):
        return cell(value.item())
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(shown, key=lambda r: tuple("" if v is None else v for v in r))


def differences(spark_df, con, statement: str) -> list[str]:
    """Empty when both sides agree."""
    left_cols = spark_df.columns
    left = table([tuple(r) for r in spark_df.collect()], left_cols)
    cursor = con.execute(statement)
    right_cols = [d[0] for d in cursor.description]
    right = table(cursor.fetchall(), right_cols)
    if sorted(left_cols) != sorted(right_cols):
        return [f"columns {sorted(left_cols)} != {sorted(right_cols)}"]
    out = []
    if len(left) != len(right):
        out.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        extra = list(set(left) - set(right))[:3]
        missing = list(set(right) - set(left))[:3]
        out.append(f"cols {sorted(left_cols)}\n   spark only {extra}\n   sql only   {missing}")
    return out
