"""Run registered queries next to their checking SQL and compare the values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, decimal.Decimal):
        return f"DEC{value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, bool):
        return f"B{value}"
    return "\0" if value is None else f"{type(value).__name__}:{value}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description."""
    df = fn(spark, sf_dir)
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    sql_cols, sql_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if spark_cols != sql_cols:
        return f"columns {spark_cols} vs {sql_cols}", len(spark_rows)
    if spark_rows != sql_rows:
        a, b = set(spark_rows) - set(sql_rows), set(sql_rows) - set(spark_rows)
        return (
            f"rows {len(spark_rows)} vs {len(sql_rows)}; only spark {len(a)}: {sorted(a)[:2]}; only sql {len(b)}: {sorted(b)[:2]}; columns {spark_cols}",
            len(spark_rows),
        )
    return None, len(spark_rows)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from gavel.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark, con = local_session("8"), connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                problem, n = None, fn(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += problem is not None
        note = "" if name in sqls else " (no sql)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{note} rows={n} {time.time() - start:.1f}s" + (f"\n    {problem}" if problem else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv)
