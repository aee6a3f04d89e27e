"""Runs queries and their SQL side by side."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).iterdir():
        name = path.name.removesuffix(".parquet")
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda x: round(float(x), 6) + 0.0 if isinstance(x, float) else x
    out = [tuple(value(r[k]) for k in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x) if not isinstance(x, float) or not math.isnan(x) else "nan") for x in r))


def compare(spark, name: str, query, sql: str, folder: str = DATA, con=None) -> str:
    """'' if the rows are equal, else what differs."""
    df = query(spark, folder)
    ours = plain([tuple(r) for r in df.collect()], df.columns)
    got = (con or views(folder)).execute(sql)
    names = [c[0] for c in got.description]
    theirs = plain(got.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} and {len(theirs)} rows; {[r for r in ours if r not in set(theirs)][:2]} {[r for r in theirs if r not in set(ours)][:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b and not _near(a, b)]
    return f"{name}: {len(bad)} of {len(ours)} rows differ, as {bad[0]}" if bad else ""


def _near(a: tuple, b: tuple) -> bool:
    return all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b))
