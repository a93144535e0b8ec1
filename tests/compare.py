"""Compare a query with its SQL as DuckDB runs it."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(columns, rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in (r[c] for c in columns)) for r in rows)


def difference(spark, query, sql, sf_dir):
    """None where both give the same rows, else a short account."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    mine, theirs = rows_of(columns, (r.asDict() for r in df.collect())), rows_of(columns, (dict(zip(names, r)) for r in found.fetchall()))
    if mine == theirs:
        return None
    a, b = [x for x in mine if x not in set(theirs)], [x for x in theirs if x not in set(mine)]
    return f"{columns}: {len(mine)} and {len(theirs)} rows; only ours {a[:2]}; only theirs {b[:2]}"
