"""Run a query in Spark and its SQL in DuckDB, and compare all rows without regard to order."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str, show: int = 3) -> list[str]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rows_of(names, rel.fetchall())
    types = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    for name, kind in df.dtypes:
        if types.get(name) != SPARK_TYPES[kind]:
            found.append(f"type of {name}: {kind} != {types.get(name)}")
    if len(got) != len(expected):
        found.append(f"rows {len(got)} != {len(expected)}")
    if got != expected:
        only_got, only_expected = sorted(set(got) - set(expected)), sorted(set(expected) - set(got))
        found.append(f"{len(only_got)} rows differ, e.g. {only_got[:show]} != {only_expected[:show]}")
    return found
