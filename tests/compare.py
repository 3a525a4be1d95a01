"""Runs a registered query and its SQL side by side and compares every value."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    # whole numbers with nulls: pandas has them as floats from Spark, as its own type from SQL
    df = df.astype({c: "float64" for c in df.columns if isinstance(df[c].dtype, pd.Int64Dtype)})
    order = sorted(df.columns, key=lambda c: (df[c].dtype.kind == "f", c))
    return df.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame, exact: bool = True) -> list[str]:
    """What differs; without ``exact``, doubles may differ in the last rounded digit."""
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        strings = {"O", "U"}
        if a != b and not {a, b} <= strings and len(got) and len(want):
            out.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
        if len(got) == len(want):
            same = (got[c].astype(str) == want[c].astype(str)) | (got[c].isna() & want[c].isna())
            if not exact and a == b == "f":
                same |= (got[c] - want[c]).abs() <= 2e-6 + 1e-9 * want[c].abs()
            if not same.all():
                at = same.idxmin()
                out.append(f"{c}: {int((~same).sum())} differ, first {got.loc[at].to_dict()} != {want.loc[at].to_dict()}")
    return out


def main(sf: str, names: list[str]) -> None:
    from wattloom.session import build_session

    import __spark_entry__ as entry

    spark = build_session("local[8]")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - start
            if name in oracles:
                start = time.time()
                found = differences(got, con.execute(oracles[name]).df())
                kind = f"sql {time.time() - start:.1f}s"
            else:
                found, kind = [], "rows"
            status = "ok  " if not found else "FAIL"
            print(f"{status} {name} rows={len(got)} {took:.1f}s {kind}", *found, sep="\n     " if found else " ", flush=True)
            failed += bool(found)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERR  {name}: {str(error)[:1500]}", flush=True)
    print(f"{failed} failed", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
