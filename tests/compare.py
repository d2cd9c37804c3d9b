"""Run registered queries beside their SQL oracles and compare values."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries
from tessera.sources.tables import TABLES

QUERIES, ORACLES = queries(), oracle_sql()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, folder)
    mine = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return None if mine[1] else "no rows"
    rel = con.execute(ORACLES[name])
    other = rows_of([d[0] for d in rel.description], rel.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} != {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"rows {len(mine[1])} != {len(other[1])}"
    if not mine[1]:
        return "no rows"
    bad = [(a, b) for a, b in zip(mine[1], other[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, e.g. {bad[:3]}" if bad else None


if __name__ == "__main__":
    from tests.session import local_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    session, connection = local_session(), connect(folder)
    failed = []
    for query in names:
        start = time.time()
        try:
            outcome = compare(session, connection, query, folder)
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:700]}"
        note = "ok" if outcome is None else outcome
        print(f"{query:26s} {time.time() - start:6.1f}s {'' if query in ORACLES else '(rows only) '}{note}", flush=True)
        failed += [query] if outcome else []
    print(f"{len(names) - len(failed)} ok, {len(failed)} failed: {failed}")
