"""Run registered queries next to their oracles: python -m checks.compare [--sf 0.01] [name or prefix ...]"""

import argparse
import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

import duckdb

from checks import collect
from docweave.testing import local_session


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


def connect(directory):
    con = duckdb.connect()
    for f in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"create view {name} as select * from '{f}'")
    return con


def compare(spark, con, directory, name, query, sql):
    t = time.time()
    df = query(spark, directory)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", took, 0.0, None
    t = time.time()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", took, sql_took, None
    a, b = rows_of(df.columns, got), rows_of(names, want)
    note = ""
    spark_types = dict(df.dtypes)
    bad = [(n, spark_types[n], t) for n, t in zip(names, types) if not same_type(spark_types[n], t)]
    if bad:
        note = f" TYPES {bad}"
    if not got:
        note += " EMPTY"
    if a == b:
        return f"ok {len(got)}{note}", took, sql_took, None
    sa, sb = set(a), set(b)
    extra = f"rows {len(a)} vs {len(b)}; spark-only {len(sa - sb)}, sql-only {len(sb - sa)}"
    detail = "\n".join(
        ["   cols  " + str(sorted(names))]
        + ["   spark " + str(x)[:700] for x in sorted(sa - sb)[:2]]
        + ["   sql   " + str(x)[:700] for x in sorted(sb - sa)[:2]]
    )
    return f"DIFF {extra}{note}", took, sql_took, detail


PAIRS = {
    "string": {"VARCHAR"},
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def same_type(spark_type, duck_type):
    return duck_type in PAIRS.get(spark_type, set())


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    directory = f"/root/testdata/sf{args.sf}"
    queries, oracles = collect()
    chosen = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    spark, con = local_session(), connect(directory)
    bad = 0
    for n in chosen:
        try:
            verdict, took, sql_took, detail = compare(spark, con, directory, n, queries[n], oracles.get(n))
        except Exception as e:
            verdict, took, sql_took, detail = "ERROR", 0.0, 0.0, "".join(traceback.format_exception_only(e))[:1500]
        bad += not verdict.startswith(("ok", "rows-only")) or "TYPES" in verdict or "EMPTY" in verdict
        print(f"{n:34s} spark {took:6.2f}s sql {sql_took:6.2f}s  {verdict}", flush=True)
        if detail:
            print(detail, flush=True)
    print(f"{len(chosen)} queries, {bad} need a look")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
