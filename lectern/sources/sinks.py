"""Sinks: one folder a table, as Parquet, JSON or CSV, with a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv")


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> dict[str, str]:
    """Writes each table under its name; nested columns become JSON text in CSV. Gives the path of each."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {FORMATS}")
    out = {}
    for name, df in tables.items():
        if form == "csv":
            nested = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
            df = df.withColumns(nested) if nested else df
        writer = df.write.mode("overwrite")
        out[name] = f"{folder.rstrip('/')}/{name}"
        (writer.option("header", "true") if form == "csv" else writer).format(form).save(out[name])
    return out
