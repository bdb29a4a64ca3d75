"""Spark results against DuckDB's."""

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def check(spark, run, sql, sf_dir, **instead):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.split(".")[0] in instead:
            continue
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    for name, table in instead.items():  # a DataFrame in place of a table
        con.register(name, table.toPandas())
    df, want = run(spark, sf_dir), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())
