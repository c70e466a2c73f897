"""Results of Spark and of DuckDB over the same tables, made comparable."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def cell(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else int(x) if x.is_integer() else float(f"{x:.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(columns: list[str], found: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in found), key=repr)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows(df.columns, df.collect())
