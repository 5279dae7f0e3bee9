"""Comparison of a query with its DuckDB statement on the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df) -> list[tuple]:
    names = sorted(df.columns)
    plain = df[names].astype(object).where(df[names].notna(), None)
    return sorted(tuple("~" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v) for v in r) for r in plain.itertuples(index=False))


def want(sql: str, folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con.sql(sql).df()
