"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tabforge.plans.registry import load_all  # noqa: E402
from tabforge.plans.standins import TABLES  # noqa: E402
from tabforge.session import build_session  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: repr(r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, tol: float = 0.0):
    c1, r1 = _rows(spark_pdf)
    c2, r2 = _rows(duck_pdf)
    if c1 != c2:
        return f"columns differ: spark={c1} duck={c2}"
    if len(r1) != len(r2):
        return f"row count differ: spark={len(r1)} duck={len(r2)}"
    bad = 0
    first = None
    for a, b in zip(r1, r2):
        if a != b:
            ok = tol > 0 and all(
                (x == y) or (isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) <= tol * max(1, abs(y)))
                for x, y in zip(a, b))
            if not ok:
                bad += 1
                first = first or (a, b)
    return None if bad == 0 else f"{bad} rows differ, e.g. spark={first[0]} duck={first[1]}"


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    reg = load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    n_ok = n_bad = n_rows_only = 0
    for key, q in reg.items():
        if keys and key not in keys:
            continue
        t0 = time.time()
        try:
            sp = q.fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {key}: spark error {type(e).__name__}: {str(e)[:400]}")
            n_bad += 1
            continue
        dt = time.time() - t0
        if q.sql is None:
            print(f"ROWS  {key}: {len(sp)} rows ({dt:.1f}s)")
            n_rows_only += 1
            continue
        try:
            du = con.execute(q.sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {key}: duckdb error {str(e)[:400]}")
            n_bad += 1
            continue
        msg = compare(sp, du)
        types = {c: (str(sp[c].dtype), str(du[c].dtype)) for c in sp.columns if c in du.columns}
        bad_types = {c: t for c, t in types.items() if t[0] != t[1]}
        if bad_types:
            print(f"TYPE  {key}: {bad_types}")
        if msg is None:
            print(f"OK    {key}: {len(sp)} rows ({dt:.1f}s)")
            n_ok += 1
        else:
            near = compare(sp, du, tol=1e-9)
            tag = "NEAR " if near is None else "FAIL "
            print(f"{tag} {key}: {msg} ({dt:.1f}s)")
            n_bad += 1
    print(f"ok={n_ok} bad={n_bad} rows_only={n_rows_only}")


if __name__ == "__main__":
    main()
