"""Run registered queries against their checking SQL: `python tests/check.py [folder] [name prefix ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from wayfold.plans.views import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    return value


def kind(value) -> str:
    if isinstance(value, tuple):
        return "list"
    return type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], out


def compare(spark_names, spark_rows, sql_names, sql_rows):
    """None when equal, else a short text."""
    a_names, a = rows_of(spark_names, spark_rows)
    b_names, b = rows_of(sql_names, sql_rows)
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    a.sort(key=key)
    b.sort(key=key)
    for left, right in zip(a, b):
        if left != right:
            only_a = sorted(set(a) - set(b), key=key)[:3]
            only_b = sorted(set(b) - set(a), key=key)[:3]
            return f"values differ: spark {only_a} vs sql {only_b}"
        for u, v in zip(left, right):
            if u is not None and kind(u) != kind(v):
                return f"types differ: {left} vs {right}"
    return None


def main(argv: list[str]) -> int:
    folder = "/root/testdata/sf0.01"
    prefixes = argv
    if argv and argv[0].startswith("/"):
        folder, prefixes = argv[0], argv[1:]
    from wayfold.plans import catalog
    from wayfold.session import build_session

    wanted_families = [f[1:] for f in prefixes if f.startswith("@")]
    prefixes = [p for p in prefixes if not p.startswith("@")]
    if wanted_families:
        from importlib import import_module
        for family in wanted_families:
            import_module(f"wayfold.plans.catalog.{family}")
    else:
        catalog.load()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            frame = fn(spark, folder)
            rows = [tuple(r) for r in frame.collect()]
            took = time.time() - started
            if name in catalog.CHECKS:
                started = time.time()
                cursor = con.execute(catalog.CHECKS[name])
                sql_names = [d[0] for d in cursor.description]
                verdict = compare(frame.columns, rows, sql_names, cursor.fetchall())
                extra = f" (sql {time.time() - started:.1f}s)"
            else:
                verdict, extra = None, " (rows only)"
            if not rows:
                verdict = (verdict or "") + " NO ROWS"
        except Exception as exc:  # noqa: BLE001
            verdict, rows, extra, took = f"{type(exc).__name__}: {str(exc)[:900]}", [], "", time.time() - started
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'BAD '} {name:40s} {len(rows):7d} rows {took:6.1f}s{extra}"
              + (f"\n      {verdict}" if verdict else ""), flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
