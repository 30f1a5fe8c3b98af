"""The registered queries and their SQL.

A query takes (spark, sf_dir) and runs over whole tables. Where SQL can say the
same, ``@query`` holds the DuckDB text; fixtures are the same rows on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal(value) -> str:
    """A value as DuckDB text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a DuckDB table expression with named columns."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


from . import blocks, checked, classified, paired, references, reported  # noqa: E402, F401
