"""Compare registered queries with their oracle SQL in DuckDB: python tests/check_oracles.py [sf] [name...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from busloom.plans.standins import TABLES  # noqa: E402
from busloom.session import make_session  # noqa: E402


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(object)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64").round(9)
        else:
            df[c] = df[c].map(lambda v: v if v is None else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), kind="stable", na_position="last", key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} vs {len(duck_df)}"
    a, b = normal(spark_df), normal(duck_df)
    for c in a.columns:
        if a[c].dtype != b[c].dtype and not (a[c].isna().all() and b[c].isna().all()):
            return f"dtype {c}: {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values differ in {c}, e.g.\n  {a.loc[i].to_dict()}\n  {b.loc[i].to_dict()}"
    return "" if len(a) else "EMPTY"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    want = args[1:]
    spark = make_session(master="local[8]", shuffle=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sql:
                msg = compare(got, con.sql(sql[name]).df())
            else:
                msg = "" if len(got) else "EMPTY"
        except Exception as exc:
            t1 = time.time()
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(msg)
        tag = "ok" if not msg else "BAD"
        print(f"{tag:4s}{name:32s}{t1 - t0:6.2f}s {len(got) if not msg else ''} {'' if name in sql else '(rows only)'} {msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
