"""Spark's rows against DuckDB's."""

from pathlib import Path

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple("" if r[k] is None else cell(r[k]) for k in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def assert_same(spark, sf, query, sql):
    df = query(spark, sf)
    got = df.collect()
    found = connect(sf).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = found.fetchall()
    assert rows_of(df.columns, got) == rows_of(columns, want)
