"""Holds a query's rows against its SQL in DuckDB, on the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: repr(round(x, 9)) if isinstance(x, float) else repr(x)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def agree(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cursor = connection(sf_dir).execute(sql)
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
