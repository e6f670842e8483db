"""Run every query beside its SQL twin: ``python tests/compare.py SF_DIR [name ...]``."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as contract


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e15 else repr(round(v, 6))
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def open_tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def check(spark, con, name, sf_dir):
    """(equal, spark rows, seconds, first difference)"""
    begin = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - begin
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None, len(got), seconds, ""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return False, len(got), seconds, f"columns {sorted(df.columns)} / {sorted(columns)}"
    a, b = canonical(got, df.columns), canonical(result.fetchall(), columns)
    if a == b:
        return True, len(a), seconds, ""
    sa, sb = set(a), set(b)
    return False, len(a), seconds, f"rows {len(a)}/{len(b)}; only here {sorted(sa - sb)[:2]}; only SQL {sorted(sb - sa)[:2]}"


if __name__ == "__main__":
    from wallflow.session import build_session

    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    tables = open_tables(sys.argv[1])
    for query in sys.argv[2:] or contract.queries():
        try:
            equal, n, seconds, note = check(session, tables, query, sys.argv[1])
        except Exception as failure:  # noqa: BLE001
            equal, n, seconds, note = False, 0, 0.0, str(failure)[:600]
        print(f"{query:22} {str(equal):5} {n:8} {seconds:6.2f}s {note[:900]}", flush=True)
