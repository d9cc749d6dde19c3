"""Compare registered queries with their SQL on DuckDB: rows, columns and values.

Run: python tests/oracle_check.py [-k text] [--sf DIR]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows: list[tuple]) -> list[tuple]:
    def one(v):
        if v is None:
            return (0, "")
        if isinstance(v, float):
            return (0, "") if math.isnan(v) else (1, f"{round(v, 6):.6f}")
        if isinstance(v, (list, tuple)):
            return (3, str([one(x) for x in v]))
        return (2, str(v))

    return sorted(tuple(one(v) for v in r) for r in rows)


def compare(spark, con, fn, sql, sf) -> tuple[bool, str]:
    df = fn(spark, sf)
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    t0 = time.time()
    raw = df.select(*[f"`{c}`" for c in cols]).collect()
    spent = time.time() - t0
    got = canonical([tuple(r) for r in raw])
    if sql is None:
        return False, f"rows={len(got)} spark={spent:.1f}s: no SQL to compare with"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    off = [f"{c}:{types[c]}/{kinds[c]}" for c in cols if names.get(types[c], kinds[c]) != kinds[c]]
    want = canonical(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall())
    note = f" types {off}" if off else ""
    if got == want:
        return not off, f"rows={len(got)} spark={spent:.1f}s{note}"
    extra, lost = sorted(set(got) - set(want))[:1], sorted(set(want) - set(got))[:1]
    return False, f"rows {len(got)} vs {len(want)} cols={cols}{note}\n   spark: {str(extra)[:700]}\n   sql:   {str(lost)[:700]}"


def main() -> None:
    import duckdb

    import __spark_entry__ as entry
    from scriptorium.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("-k", default="")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{args.sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.k and not any(k in name for k in args.k.split(",")):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, fn, sql.get(name), args.sf)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
