"""Holds a Spark result against DuckDB's, as sorted rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


def difference(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    expected, got = rows(names, want.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != expected:
        extra, missing = set(got) - set(expected), set(expected) - set(got)
        return f"{len(got)} rows against {len(expected)}; {len(extra)} only here, {len(missing)} only there: {sorted(extra)[:2]} {sorted(missing)[:2]}"
    return "" if expected else "no rows"
