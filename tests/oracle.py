"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

DATA = "/root/testdata"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float | int):
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf="sf0.001"):
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    got = query(spark, f"{DATA}/{sf}")
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]
