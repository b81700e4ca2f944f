"""Run a registered query in Spark and its SQL in DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return None, len(got[1]), t1 - t0, 0.0, ""
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    t2 = time.time()
    why = ""
    if got[0] != want[0]:
        why = f"columns {got[0]} vs {want[0]}"
    elif len(got[1]) != len(want[1]):
        why = f"rows {len(got[1])} vs {len(want[1])}"
    elif got[1] != want[1]:
        bad = [(g, w) for g, w in zip(*[got[1], want[1]]) if g != w]
        why = f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:300]} || {str(bad[0][1])[:300]}"
    return why == "", len(got[1]), t1 - t0, t2 - t1, why


def main(argv):
    from tests.session import session

    from __spark_entry__ import oracle_sql, queries

    sf = argv[0]
    wanted = argv[1:]
    spark = session()
    con = connect(sf)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, n, ts, td, why = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on
            ok, n, ts, td, why = False, 0, 0, 0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        state = {True: "ok", False: "BAD", None: "rows"}[ok]
        print(f"{state:4} {name:28} rows={n:<7} spark={ts:6.2f}s duck={td:6.2f}s {why}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
