"""Run catalogue queries in Spark and their SQL in DuckDB, compare the rows.

    python tools/check_oracle.py /root/testdata/sf0.01 [key prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(path: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{path}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def table_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows: list[tuple], width: int) -> list[set]:
    return [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(width)]


def compare(columns_a, rows_a, columns_b, rows_b) -> str | None:
    """None when equal, otherwise the first difference."""
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(columns_a)} != {sorted(columns_b)}"
    if len(rows_a) != len(rows_b):
        return f"row counts {len(rows_a)} != {len(rows_b)}"
    a, b = table_of(columns_a, rows_a), table_of(columns_b, rows_b)
    names = sorted(columns_a)
    ka, kb = kinds(a, len(names)), kinds(b, len(names))
    for i, (x, y) in enumerate(zip(ka, kb)):
        if x and y and x != y:
            return f"types of {names[i]}: {x} != {y}"
    if any(isinstance(v, Decimal) for r in b[:1] for v in r):
        return "decimal values in the SQL result"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} rows differ, first in {diff}"
    return None


def check(spark, con, path: str, key: str, entry) -> tuple[str, str | None, int, float]:
    start = time.time()
    df = entry.run(spark, path)
    rows = df.collect()
    took = time.time() - start
    if entry.sql is None:
        return "rows-only", None, len(rows), took
    cursor = con.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    diff = compare(df.columns, rows, names, cursor.fetchall())
    return ("ok" if diff is None else "DIFF"), diff, len(rows), took


def main() -> int:
    from tidemark.queries import CATALOGUE
    from tidemark.runtime import build_session

    path, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", "check", 8)
    con = connect(path)
    failures = 0
    for key, entry in CATALOGUE.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            state, diff, n, took = check(spark, con, path, key, entry)
        except Exception as e:  # report and go on with the next query
            state, diff, n, took = "ERROR", str(e)[:1500], -1, 0.0
        failures += state in ("DIFF", "ERROR")
        print(f"{state:9} {key:45} rows={n:<7} {took:6.2f}s {diff or ''}", flush=True)
    print(f"failures: {failures}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
