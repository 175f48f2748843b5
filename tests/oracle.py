"""Compare a query's rows with its SQL on DuckDB, as the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(value):
    return "null" if value is None or value != value else f"{value:.9g}" if isinstance(value, float) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, sql, sf_dir):
    cursor = views(sf_dir).execute(sql)
    want = normal([c[0] for c in cursor.description], cursor.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
