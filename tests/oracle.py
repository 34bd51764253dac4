"""Run queries next to their SQL twins and report differences.

    python tests/oracle.py [folder] [name ...]
"""

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return (2, "nan")
        return (2, f"{float(v):.6f}" if float(v) != 0 else "0.000000")
    if isinstance(v, datetime.datetime):
        return (3, v.isoformat())
    return (4, str(v))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder, run, sql):
    df = run(spark, folder)
    got_columns = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return len(got), len(want), f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = normal(got_columns, got), normal(want_columns, want)
    if a == b:
        return len(got), len(want), None
    in_a, in_b = set(a), set(b)
    only_a, only_b = list(in_a - in_b)[:2], list(in_b - in_a)[:2]
    return len(got), len(want), f"spark only {[[c[1] for c in r] for r in only_a]} sql only {[[c[1] for c in r] for r in only_b]}"


if __name__ == "__main__":
    from candlewright.plans.registry import QUERIES, SQL
    from candlewright.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), duck(folder), []
    for n in names:
        t = time.time()
        try:
            if n in SQL:
                got, want, problem = compare(spark, con, n, folder, QUERIES[n], SQL[n])
            else:
                got, want, problem = QUERIES[n](spark, folder).count(), "-", None
        except Exception as e:  # noqa: BLE001
            got, want, problem = "?", "?", f"{type(e).__name__}: {str(e)[:700]}"
        if problem:
            bad.append(n)
        print(f"{'FAIL' if problem else 'ok  '} {n} {got}/{want} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; failing: {bad}")
