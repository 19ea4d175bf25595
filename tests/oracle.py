"""Run registered queries beside their DuckDB oracles and compare all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return 0.0 if value == 0 else float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def same_but_rounding(mine, theirs):
    """Equal when fractions may differ in their last rounded digit.

    Both engines round exact halves by the noise of their sums.
    """
    def key(row):
        return [repr(round(v, 2)) if isinstance(v, float) and v % 1 else repr(v) for v in row]

    if len(mine) != len(theirs):
        return False
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key)):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                if not math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-4):
                    return False
            elif x != y:
                return False
    return True


def compare(spark, connection, folder, query, sql):
    """Difference as text, or None; and the number of rows."""
    frame = query(spark, folder)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None, len(mine)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(mine)
    if mine != theirs and not same_but_rounding(mine, theirs):
        gone = set(theirs) - set(mine)
        extra = set(mine) - set(theirs)
        return (f"{len(mine)} rows vs {len(theirs)}; {len(extra)} extra e.g. "
                f"{sorted(extra, key=repr)[:3]}; {len(gone)} missing e.g. "
                f"{sorted(gone, key=repr)[:3]}"), len(mine)
    return None, len(mine)


if __name__ == "__main__":
    from tidemark.queries import REGISTRY
    from tidemark.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:] or list(REGISTRY)
    extra = {}
    if "CHUNK_BYTES" in os.environ:  # force the path that large inputs take
        extra["spark__tidemark__chunkBytes"] = os.environ["CHUNK_BYTES"]
    spark = build_session(master="local[8]", shuffle_partitions=8, **extra)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in wanted:
        query, sql = REGISTRY[name]
        start = time.time()
        try:
            difference, count = compare(spark, connection, folder, query, sql)
            verdict = "ok  " if difference is None else "DIFF"
            print(f"{verdict} {name} rows={count} {time.time() - start:.2f}s "
                  f"{'' if sql else 'rows only '}{difference or ''}", flush=True)
        except Exception as error:  # noqa: BLE001 - a report of all queries is wanted
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:900]}", flush=True)
