"""A query of ours against its SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def oracle(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(n for n in names), Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf_dir: str = SF):
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows(*oracle(sql, sf_dir))
    assert ours[0] == theirs[0]
    if ours[1] != theirs[1]:
        raise AssertionError(f"only ours: {list((ours[1] - theirs[1]).items())[:5]}\nonly SQL: {list((theirs[1] - ours[1]).items())[:5]}")
    return sum(ours[1].values())
