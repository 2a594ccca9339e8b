"""Compare a query's rows with those of its SQL, regardless of row order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows_by_name(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def differences(df, connection, sql) -> str | None:
    """None if columns, types and rows agree, else what does not."""
    expected = connection.execute(sql)
    names = [column[0] for column in expected.description]
    types = {n: KINDS.get(str(column[1]), str(column[1])) for n, column in zip(names, expected.description)}
    want = rows_by_name(names, expected.fetchall())
    have_types = dict(df.dtypes)
    if sorted(have_types) != sorted(types):
        return f"columns {sorted(have_types)} != {sorted(types)}"
    wrong = {n: (have_types[n], types[n]) for n in types if have_types[n] != types[n]}
    have = rows_by_name(df.columns, [tuple(row) for row in df.collect()])
    if have != want:
        extra, missing = have - want, want - have
        return (
            f"{have.total()} rows, expected {want.total()}; extra {str(list(extra)[:2])[:1500]}; "
            f"missing {str(list(missing)[:2])[:1500]}"
        )
    return f"types {wrong}" if wrong else None
