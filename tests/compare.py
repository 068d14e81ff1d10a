"""Compare a query with its SQL: names, types, row count, and values as sorted rows.

As a script: python tests/compare.py <sf_dir> [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def kinds(df: pd.DataFrame) -> dict[str, str]:
    out = {}
    for c in df.columns:
        numbers = pd.api.types.is_numeric_dtype(df[c])
        out[c] = ("float" if pd.api.types.is_float_dtype(df[c]) else "int") if numbers else "text"
    return out


def sorted_rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c] + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def check(spark, con, name: str, sf_dir: str) -> str | None:
    """None if equal, otherwise what differs."""
    spark_df = contract.queries()[name](spark, sf_dir)
    types = {c: ("BIGINT" if t == "bigint" else "INTEGER" if t == "int" else t.upper()) for c, t in spark_df.dtypes}
    ours = spark_df.toPandas()
    rel = con.sql(contract.oracle_sql()[name])
    want_types = dict(zip(rel.columns, [str(t).replace("VARCHAR", "STRING") for t in rel.types]))
    want = rel.df()
    if sorted(ours.columns) != sorted(want.columns):
        return f"columns {sorted(ours.columns)} != {sorted(want.columns)}"
    if types != {c: want_types[c] for c in types}:
        return f"types {types} != {want_types}"
    if len(ours) != len(want):
        return f"rows {len(ours)} != {len(want)}"
    a, b = sorted_rows(ours), sorted_rows(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{(~same).sum()} of {len(a)} rows differ in {c}:\n{a.loc[at].to_dict()}\n{b.loc[at].to_dict()}"
    if len(a) == 0:
        return "no rows"
    return None


if __name__ == "__main__":
    from haulcomp.session import local_session

    spark, sf_dir = local_session(cores=8), sys.argv[1]
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or contract.queries():
        start = time.time()
        try:
            problem = check(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
