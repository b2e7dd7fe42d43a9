"""Rows of a query and of its SQL twin, in comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def sql_rows(c, sql):
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return cols, sorted(repr(tuple(row[i] for i in at)) for row in r.fetchall())


def spark_rows(df, tmp, c):
    df.write.mode("overwrite").parquet(tmp)
    return sql_rows(c, f"select * from '{tmp}/*.parquet'")
