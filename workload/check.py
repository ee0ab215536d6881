"""Run queries next to their SQL on DuckDB and compare all values.

    python -m workload.check SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from decimal import Decimal

import duckdb

from fileledger.session import local_session
from workload.oracles import oracle_sql
from workload.queries import queries


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, Decimal)) or (isinstance(value, float) and value == int(value)):
        return int(value) if value == int(value) else round(float(value), 9)
    if isinstance(value, float):
        return round(value, 9)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def main(sf: str, names: list[str]) -> int:
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    db = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from '{file}'")
    oracles, failed = oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = query(spark, sf)
            got = _rows(frame.columns, frame.collect())
            took = time.time() - started
            if name not in oracles:
                print(f"{name:24} rows={len(got)} {took:.1f}s (no SQL)", flush=True)
                continue
            started = time.time()
            cursor = db.execute(oracles[name])
            columns = [d[0] for d in cursor.description]
            want = _rows(columns, cursor.fetchall())
            same = sorted(columns) == sorted(frame.columns) and got == want
            print(f"{name:24} {'ok' if same else 'DIFF'} rows={len(got)}/{len(want)} {took:.1f}s sql={time.time() - started:.1f}s", flush=True)
            if not same:
                failed += 1
                print("   columns", sorted(frame.columns), sorted(columns))
                left, right = set(got) - set(want), set(want) - set(got)
                for row in list(left)[:2]:
                    print("   spark", str(row)[:700])
                for row in list(right)[:2]:
                    print("   sql  ", str(row)[:700])
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"{name:24} ERROR {type(error).__name__} {str(error)[:600]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
