"""Runs a query's SQL in DuckDB on the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    return names, cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, sf_dir, sql):
    names, want = sql_rows(sf_dir, sql)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    got = [tuple(norm(r[n]) for n in sorted(names)) for r in df.collect()]
    at = [names.index(n) for n in sorted(names)]
    want = [tuple(norm(r[i]) for i in at) for r in want]
    got.sort(key=repr)
    want.sort(key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])
    for a, b in zip(got, want):
        assert a == b, (a, b)
    return len(got)
