"""Comparison of a query with its SQL, as the driver makes it."""

import glob
import os

import duckdb


def _plain(value):
    return round(value, 6) if isinstance(value, float) else (round(float(value), 6) if type(value).__name__ == "Decimal" else value)


def assert_same(spark, name, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(_plain, r)) for r in frame.select(*columns).collect()), key=str)
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns, name
    order = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    assert got == want, name
