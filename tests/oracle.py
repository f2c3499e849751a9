"""Holding a query's rows against its SQL's."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        return round(x, 8) if isinstance(x, float) else x

    return sorted(([plain(r[k]) for k in order] for r in found), key=repr)


def same(df, con, sql):
    got = df.collect()
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
