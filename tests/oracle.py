"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, con, case, sf_dir: str):
    """Number of rows, after checking that both sides agree."""
    df = case.run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if case.sql is None:
        return len(got)
    cur = con.execute(case.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_cols == want_cols, f"{case.name}: columns {got_cols} != {want_cols}"
    assert len(got) == len(want), f"{case.name}: {len(got)} rows, SQL has {len(want)}"
    for a, b in zip(got, want):
        assert a == b, f"{case.name}: {a} != {b} ({got_cols})"
        assert [type(x) for x in a] == [type(x) for x in b], f"{case.name}: types {a} {b}"
    return len(got)
