"""Compare a Spark DataFrame with a DuckDB query on the same parquet tables.

Mirrors the driver's check: same column names, same row count, same
values regardless of row order (columns compared by sorted name).
"""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT",
    "tinyint": "TINYINT",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark_df, con, sql: str, check_types: bool = True) -> list[str]:
    """Return a list of problems (empty when equal)."""
    problems = []
    s_cols = sorted(spark_df.columns)
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d_cols = sorted(rel.columns)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if s_cols != d_cols:
        return [f"columns differ: spark-only {sorted(set(s_cols) - set(d_cols))}, "
                f"duck-only {sorted(set(d_cols) - set(s_cols))}"]
    if check_types:
        for c in s_cols:
            want = SPARK_TO_DUCK.get(s_types[c])
            if want and d_types[c] != want:
                problems.append(f"type {c}: spark {s_types[c]} vs duck {d_types[c]}")
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in spark_df.select(*s_cols).collect()]
    d_rows = [tuple(_norm(v) for v in row) for row in rel.select(*[f'"{c}"' for c in s_cols]).fetchall()]
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark {len(s_rows)} vs duck {len(d_rows)}")
    s_sorted, d_sorted = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    diffs = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
    if diffs:
        problems.append(f"{len(diffs)} differing rows, first: spark {diffs[0][0]} vs duck {diffs[0][1]} "
                        f"cols {s_cols}")
    return problems
