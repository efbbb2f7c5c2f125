"""Compares a DataFrame with DuckDB's rows of the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)


def same_rows(df, sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(r[names.index(n)]) for n in df.columns) for r in cur.fetchall()), key=str)
    got = sorted((tuple(_plain(v) for v in r) for r in df.collect()), key=str)
    assert len(got) == len(want)
    assert [x for x in zip(got, want) if x[0] != x[1]][:3] == []
