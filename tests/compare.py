"""Run registered queries and their SQL side by side: `python tests/compare.py [sf] [name prefix ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 5) + 0.0)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v if isinstance(v, str) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name, q, sf_dir):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t0
    if q.sql is None:
        return "rows-only", len(got[1]), took, ""
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), took, f"{got[0]} vs {want[0]}"
    if got[1] != want[1]:
        diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return "DIFF", len(got[1]), took, f"rows {len(got[1])} vs {len(want[1])} {diff}"
    return "ok" if got[1] else "EMPTY", len(got[1]), took, ""


def main(argv):
    from duologue.plans.registry import load_all
    from duologue.session import local_session

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for name, q in sorted(load_all().items()):
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            status, n, took, note = check(spark, con, name, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "FAIL", 0, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        if status in ("FAIL", "DIFF", "COLUMNS", "EMPTY"):
            bad.append(name)
        print(f"{status:10s} {name:42s} {n:7d} rows {took:6.2f}s {note[:900]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
