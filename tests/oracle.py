"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

#: Spark and DuckDB types that count as the same.
KINDS = ((pa.types.is_integer, "int"), (pa.types.is_floating, "float"), (pa.types.is_decimal, "decimal"), (pa.types.is_boolean, "bool"), (pa.types.is_string, "text"), (pa.types.is_large_string, "text"), (pa.types.is_timestamp, "time"))


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with a view of each table of the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def kind(t: pa.DataType) -> str:
    return next((name for test, name in KINDS if test(t)), str(t))


def plain(value):
    """Floats to nine digits; -0.0 and NaN have one form each."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows(table: pa.Table) -> Counter:
    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return Counter(tuple(map(plain, r)) for r in zip(*columns))


def differences(own: pa.Table, other: pa.Table) -> list[str]:
    """What differs between two results: column names, kinds of types, rows."""
    if sorted(own.column_names) != sorted(other.column_names):
        return [f"columns {sorted(own.column_names)} and {sorted(other.column_names)}"]
    out = [f"{c}: {own.schema.field(c).type} and {other.schema.field(c).type}" for c in own.column_names if kind(own.schema.field(c).type) != kind(other.schema.field(c).type)]
    a, b = rows(own), rows(other)
    if a != b:
        out.append(f"{own.num_rows} and {other.num_rows} rows; only here {list((a - b).items())[:3]}, only there {list((b - a).items())[:3]}")
    return out
