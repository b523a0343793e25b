"""Compare registered queries with their SQL: python -m tests.oracle SF [NAME...]"""

import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/root/testdata"


def normal(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in t))


def difference(spark, sf, name, f, sql):
    """Nothing, or what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{sf}/{t}.parquet'")
    df = f(spark, f"{ROOT}/{sf}")
    got = [tuple(r) for r in df.collect()]
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows_of(df.columns, got), rows_of(want.columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidewater.session import build_session

    spark = build_session("oracle")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        try:
            found = difference(spark, sys.argv[1], name, queries[name], oracles[name])
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:300]}"
        print(name, found or "ok", flush=True)
