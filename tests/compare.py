"""Run registered queries in Spark and their twins in DuckDB and compare the values."""

from __future__ import annotations

import math
from typing import Any

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v: Any) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def difference(spark_df, con, sql: str) -> str | None:  # noqa: ANN001
    """None when both sides agree, else what differs."""
    cols = sorted(spark_df.columns)
    spark_types = dict(spark_df.dtypes)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in spark_df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in idx) for r in cur.fetchall())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP"}
    types = [(c[0], str(c[1])) for c in cur.description]
    off = [f"{n}:{spark_types[n]}/{k}" for n, k in types if kinds.get(spark_types[n]) != k and k != "NUMBER"
           and {k, spark_types[n]} not in ({"STRING", "string"}, {"bool", "boolean"}, {"DATETIME", "timestamp_ntz"})]
    if got != want:
        a, b = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        note = f"rows {len(got)} vs {len(want)}; only spark {len(a)}, only duckdb {len(b)}"
        if a and b:
            d = [(c, x, y) for c, x, y in zip(cols, a[0], b[0], strict=True) if x != y]
            note += f"; first differing cells {d[:5]}"
        elif a or b:
            note += f"; e.g. {(a or b)[0]}"
        return note
    if off:
        return f"types {off}"
    return None
