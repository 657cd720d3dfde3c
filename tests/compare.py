"""Spark's rows against DuckDB's, as the driver compares them: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(got.columns, got.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, different[:3]
