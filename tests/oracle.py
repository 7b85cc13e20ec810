"""Run a query and its reference SQL side by side and compare them value by value."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return None if value is None else f"{type(value).__name__}:{value}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple(str(v) for v in t))


def compare(spark, con, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    got_cols, got = table(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    want_cols, want = table([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(c, a, b) for c, a, b in zip(got_cols, *bad[0]) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first: {diff[:4]} in {bad[0][0][:6]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, queries[name], sqls[name], sf)
            else:
                frame = queries[name](spark, sf)
                problem = None if frame.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failed += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {time.time() - start:5.1f}s {'' if name in sqls else '(rows only) '}{name}"
              + (f"  {problem}" if problem else ""), flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} pass")
