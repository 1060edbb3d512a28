"""Run registered queries next to their DuckDB text and compare row by row.

python tests/oracle_check.py [sf_dir] [name-substring …]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got, want = canon(got), canon(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind != b.dtype.kind and len(a) and not (a.isna().any() or b.isna().any()):
            return f"column {c}: dtype {a.dtype} vs {b.dtype}"
        na, nb = a.isna().to_numpy(), b.isna().to_numpy()
        same = (na & nb) | (~na & ~nb & (a.to_numpy() == b.to_numpy()))
        if not np.all(same):
            i = int(np.argmin(same))
            return f"column {c}: {int((~same).sum())} differ, first\n{got.iloc[i].to_dict()}\n{want.iloc[i].to_dict()}"
        if a.dtype.kind == "f" and np.any(np.signbit(a.to_numpy()) != np.signbit(b.to_numpy()) & ~na):
            return f"column {c}: negative zero"
    return None


def main() -> int:
    from trialframe.plans.catalog import ORACLES, QUERIES
    from trialframe.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            got = QUERIES[n](spark, sf_dir).toPandas()
            t1 = time.time()
            if n in ORACLES:
                diff = compare(got, con.execute(ORACLES[n]).fetchdf())
            else:
                diff = None if len(got) else "no rows"
        except Exception as e:  # report and go on
            diff, t1, got = f"{type(e).__name__}: {str(e)[:600]}", time.time(), pd.DataFrame()
        bad += diff is not None
        kind = "sql " if n in ORACLES else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {n} rows={len(got)} {t1 - t0:.2f}s", diff or "", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
