"""Register of queries, and composition of the SQL that checks them."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burstlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Declare a named subquery; others may refer to it by name."""
    if name in _VIEWS:
        raise ValueError(f"view declared twice: {name}")
    _VIEWS[name] = sql.strip()


def compose(final: str) -> str:
    """``final`` with the declared views that it needs, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bv_\w+", sql)):
            if word in _VIEWS and word not in needed:
                visit(_VIEWS[word])
                if word not in needed:
                    needed.append(word)

    visit(final)
    if not needed:
        return final.strip()
    body = ",\n".join(f"{name} AS (\n{_VIEWS[name]}\n)" for name in needed)
    return f"WITH {body}\n{final.strip()}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"query registered twice: {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        _QUERIES[key] = run
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return {key: compose(sql) for key, sql in _ORACLES.items()}
