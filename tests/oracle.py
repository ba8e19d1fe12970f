"""Spark rows against DuckDB rows, sorted, by name; numbers within a small tolerance."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, Decimal):
            return float(v)
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)):
            return float(v)
        return str(v)

    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(v is None, str(type(v)), round(v, 3) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in r])


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def differences(spark_df, sf_dir, sql, most=3):
    cols, want = duck(sf_dir, sql)
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if cols != names:
        return [f"columns {names} and {cols}"]
    if len(got) != len(want):
        return [f"{len(got)} and {len(want)} rows", got[:2], want[:2]]
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))][:most]
