"""Row comparison of Spark results with DuckDB's, as multisets of values by column name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, **extra: str):
    """A connection with the tables of a folder as views; extra: further (or other) tables by parquet path."""
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists() and name not in extra:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    for name, path in extra.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql: str) -> None:
    """The DataFrame and the SQL give the same columns and the same multiset of rows."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want != got:
        raise AssertionError(f"{sum((want - got).values())} rows only in SQL, e.g. {list(want - got)[:2]}; {sum((got - want).values())} only in Spark, e.g. {list(got - want)[:2]}")
