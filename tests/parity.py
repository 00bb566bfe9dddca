"""Compare registered queries with their SQL counterpart: python -m tests.parity [folder] [names]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    if isinstance(value, dict):
        return str({k: _plain(v) for k, v in value.items()})
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_rel = con.sql(sql)
    want = rows_of(want_rel.columns, want_rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(want_rel.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(want_rel.columns)}")
    types = {c: str(t) for c, t in zip(want_rel.columns, want_rel.types)}
    for f in df.schema:
        if types.get(f.name) == "HUGEINT" or (types.get(f.name) == "BIGINT") != (f.dataType.simpleString() == "bigint"):
            problems.append(f"type {f.name}: {f.dataType.simpleString()} vs {types.get(f.name)}")
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        problems.append(f"{len(got)} vs {len(want)} rows; only here {extra}; only there {missing}")
    return len(got), problems


def main():
    from hearsay.session import build_session
    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("parity", os.environ.get("PARITY_CPUS", "8"))
    con = connect(folder)
    oracles = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                n, problems = compare(spark, con, name, query, oracles[name], folder)
            else:
                n, problems = query(spark, folder).count(), []
        except Exception as error:  # report and go on
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name:32s} {n:7d} rows {time.time() - start:6.2f}s {' | '.join(problems)}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
