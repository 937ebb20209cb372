"""Side-by-side run of a Spark query and its SQL twin."""

import datetime
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def compare(df, con, sql):
    """Return (spark rows, oracle rows, differing rows, sample)."""
    cols = sorted(df.columns)
    left = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(left), -1, -1, (cols, sorted(names))
    idx = [names.index(c) for c in cols]
    right = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    from collections import Counter
    a = Counter(tuple(norm(x) for x in r) for r in left)
    b = Counter(tuple(norm(x) for x in r) for r in right)
    da, db = a - b, b - a
    diff = sum(da.values()) + sum(db.values())
    return len(left), len(right), diff, (cols, sorted(da)[:3], sorted(db)[:3]) if diff else None
