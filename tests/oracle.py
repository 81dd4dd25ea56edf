"""Compare registered queries with their SQL: ``python tests/oracle.py [--sf 0.01] [names...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


# Type names of both engines that stand for the same type.
SAME = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP": "timestamp",
}


def compare(spark, con, sf_dir, name, fn, sql):
    """An empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "", len(got)
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(got)
    here = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    there = {c: SAME.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    if here != there:
        return f"types {here} != {there}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""), len(got)


def main():
    from tests.conftest import make_session

    import __spark_entry__ as e

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = make_session(), connect(sf_dir)
    oracles, failed = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            diff, n = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as err:  # noqa: BLE001
            diff, n = f"{type(err).__name__}: {str(err)[:1500]}", 0
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {time.time() - start:6.2f}s {n:8d} {name} {diff}", flush=True)
        failed += bool(diff)
    print("failed:", failed)


if __name__ == "__main__":
    main()
