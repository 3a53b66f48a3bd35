"""Comparison of a registered query with its reference SQL."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if hasattr(value, "as_tuple"):
        raise AssertionError("the reference gives a decimal")
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(spark_df, con, sql: str) -> list[str]:
    """Messages for all ways in which the two results differ."""
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    ours = [tuple(r) for r in spark_df.collect()]
    found = []
    mine = {f.name: _TYPES[f.dataType.simpleString()] for f in spark_df.schema.fields}
    if mine != types:
        odd = {n: (mine.get(n), types.get(n)) for n in set(mine) | set(types)}
        found.append(f"types: { {n: t for n, t in odd.items() if t[0] != t[1]} }")
    if sorted(mine) != sorted(types):
        return found
    if len(ours) != len(theirs):
        found.append(f"rows: {len(ours)} vs {len(theirs)}")
    a, b = _bag(list(mine), ours), _bag(list(types), theirs)
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        found.append(f"values: {sum((a - b).values())} differ, {sorted(mine)}: {left} vs {right}")
    return found
