"""Compare registered queries with their SQL oracles in DuckDB.

Usage: python tests/oracle.py [sf_dir] [name prefixes ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return ("", "NULL")
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return ("b", bool(v))
        if hasattr(v, "item"):
            v = v.item() if getattr(v, "ndim", 0) == 0 else tuple(cell(x) for x in v)
        if isinstance(v, float):
            return ("n", v)
        if isinstance(v, int):
            return ("n", float(v))
        return ("s", str(v))

    rows = [tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} != {bad[0][1]} columns {sorted(got.columns)}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from wavegauge.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark = local_session("8")
    con = duck(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.execute(oracles[name]).fetchdf()
                msg = compare(got, want)
            else:
                msg = "" if len(got) else "no rows"
            status = ("ok " if name in oracles else "rows") if not msg else "BAD "
        except Exception as exc:  # noqa: BLE001
            t1 = time.time()
            got, status, msg = [], "ERR ", str(exc)[:700]
        failed += status in ("BAD ", "ERR ")
        print(f"{status} {name} rows={len(got)} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s {msg}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
