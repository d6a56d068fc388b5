"""Row-by-row comparison of a registered query with its SQL."""

import datetime
import glob
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 8)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        return v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, f, sql, d):
    df = f(spark, d)
    got = rows_of(df.columns, df.collect())
    cur = connect(d).execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
    return len(got[1])
