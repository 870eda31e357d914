"""Compare catalogued queries with their SQL: python -m tests.oracle_check [sf_dir] [query …]"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    columns, got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names, want = table_rows([d[0] for d in cur.description], cur.fetchall())
    if columns != names:
        return f"columns {columns} != {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else None


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from lexcorpus.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = e.oracle_sql()
    only = sys.argv[2:]
    bad = 0
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, sql.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        state = "ok" if problem is None else "FAIL " + str(problem)[:900]
        print(f"{name:28s} {time.time() - start:6.2f}s {'' if name in sql else '(no sql) '}{state}", flush=True)
    missing = set(sql) - set(e.queries())
    print("failed:", bad, "sql without query:", sorted(missing))
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
