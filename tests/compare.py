"""Compares a query with its SQL over the same Parquet tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def same_rows(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
