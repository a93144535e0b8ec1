"""Compare a registered query with its SQL as DuckDB runs it."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(v)


def assert_same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(normal(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
