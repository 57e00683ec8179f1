"""Run registered queries against DuckDB on the same tables."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty when equal."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    notes = []
    for c in a.columns:
        if a[c].dtype == float:
            x, y = a[c].to_numpy(), b[c].to_numpy()
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)))
        else:
            bad = (a[c] != b[c]).to_numpy()
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            notes.append(f"{c}: {int(bad.sum())} ({a[c][i]!r} vs {b[c][i]!r})")
    return "; ".join(notes[:6]) + (f" (+{len(notes) - 6} more columns)" if len(notes) > 6 else "")


def main(sf: str, names: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    from barwright.session import build_session
    import __spark_entry__ as entry

    spark = build_session("harness", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"{name}: rows-only {len(got)} [{t1 - t0:.1f}s]", flush=True)
            continue
        try:
            want = con.execute(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SQL FAILED {str(e)[:1500]}", flush=True)
            continue
        diff = difference(got, want)
        kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if c in want.columns
                 and got[c].dtype.kind != want[c].dtype.kind}
        if kinds:
            print(f"  types {name}: {kinds}")
        print(f"{name}: {'ok' if not diff else 'DIFF ' + diff} rows={len(got)} cols={len(got.columns)} "
              f"[{t1 - t0:.1f}s / {time.time() - t1:.1f}s]", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
