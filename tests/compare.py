"""Comparison of a query with the SQL that stands beside it, both over the same Parquet files.

Run by itself it prints a line for each query: python tests/compare.py [folder] [names...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def by_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _rows(df.columns, df.collect())


def by_duckdb(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted(columns), _rows(columns, got.fetchall())


def difference(df, sql: str, folder: str) -> str | None:
    """What differs first, None if nothing does."""
    (spark_columns, ours), (sql_columns, theirs) = by_spark(df), by_duckdb(sql, folder)
    if spark_columns != sql_columns:
        return f"columns {spark_columns} and {sql_columns}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)} by SQL; first of either alone: {list(set(ours) - set(theirs))[:1]} {list(set(theirs) - set(ours))[:1]}"
    return next((f"{a} and by SQL {b}" for a, b in zip(ours, theirs, strict=True) if a != b), None)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from quern.session import build_session

    at = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            out = run(session, at)
            if name in oracles:
                said = difference(out, oracles[name], at) or "same"
            else:
                said = f"{len(out.collect())} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {time.time() - began:5.1f}s {said[:900]}", flush=True)
