"""Compare Spark queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 7)) if not isinstance(v, tuple) else (False, "t", str(v)) for v in row)


def same(a, b, tolerance: float) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, tolerance) for x, y in zip(a, b))
    return a == b


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=key)


def compare(df, con, sql: str, tolerance: float = 0.0) -> str | None:
    """None when equal, else what differs."""
    left_columns, left = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    right_columns, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if not all(same(x, y, tolerance) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(left)} rows differ, first {str(bad[0])[:700]}" if bad else None


def main() -> None:
    import importlib
    import os
    import sys
    import time

    from winnow.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("OFF")
    from table_queries import base

    modules = os.environ.get("MODULES")
    if modules:
        for m in modules.split(","):
            importlib.import_module(f"table_queries.{m}")
    con = connect(folder)
    wanted = sys.argv[1:]
    failures = 0
    for name, fn in base.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in base.ORACLES:
                result = compare(fn(spark, folder), con, base.ORACLES[name])
            else:
                result = None if (n := fn(spark, folder).count()) else f"{n} rows"
                name += " (no SQL)"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("failures", failures)


if __name__ == "__main__":
    main()
