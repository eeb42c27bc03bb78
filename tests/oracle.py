"""Run registered queries beside their DuckDB twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

from watchloom.plans import catalog
from watchloom.plans.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (Decimal, float)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, folder: str) -> tuple[int, str]:
    """(row count, problem); an empty problem means the rows agree."""
    df = catalog.QUERIES[name](spark, folder)
    got = df.collect()
    if name not in catalog.ORACLES:
        return len(got), ""
    cur = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a != b:
        extra, missing = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
        return len(got), f"{len(a)} rows != {len(b)}; only here {extra[:2]}; only there {missing[:2]}"
    return len(got), ""


def main(folder: str, names: list[str]) -> None:
    from watchloom.session import local_session

    catalog.load_all()
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in names or list(catalog.QUERIES):
        start = time.time()
        try:
            n, problem = differences(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        print(f"{name:34} rows={n:7} {time.time() - start:6.1f}s {'oracle' if name in catalog.ORACLES else 'rows  '} {problem[:1800] or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
