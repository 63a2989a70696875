"""Comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    return round(float(value), 4) if isinstance(value, (float, Decimal)) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(_plain(v[i])) for i in order) for v in values)


def assert_matches(query, sql: str, spark, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = query(spark, sf_dir)
    wanted = con.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, wanted.fetchall())
