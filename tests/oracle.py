"""Runs a query and its SQL side by side."""

import os
from decimal import Decimal

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, Decimal):
        return float(v)
    return v.item() if hasattr(v, "item") else v


def lines(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([cell(v) for v in row]) for row in frame.itertuples(index=False, name=None))


def both(spark, query, sql: str, sf: str = SF) -> tuple[list[str], list[str]]:
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for name in os.listdir(sf):
            c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
        expected = c.execute(sql).df()
    got = query(spark, sf).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    return lines(got), lines(expected)
