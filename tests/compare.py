"""Spark results against DuckDB's, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7) + 0.0
    if isinstance(x, datetime):
        return x.isoformat()
    if isinstance(x, date):
        return datetime(x.year, x.month, x.day).isoformat()
    return x


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duckdb_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def agree(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    names, expected = duckdb_rows(sf_dir, sql)
    assert sorted(df.columns) == names
    got = spark_rows(df)
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
