"""Compares a query's rows with its SQL over the same Parquet files."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def differences(spark, query, sql: str, sf_dir: str = DATA) -> list:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    result = connect(sf_dir).execute(sql)
    have = [c[0] for c in result.description]
    assert sorted(have) == names, (sorted(have), names)
    order = [have.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    if len(got) != len(want):
        return [("rows", len(got), len(want))]
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
