"""Column expressions shared by the record operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_of(cols: Sequence[str], key: str | None = None) -> Column:
    """A struct of the columns; the key, if given, leads, as structs sort field by field."""
    names = [key, *(c for c in cols if c != key)] if key else list(cols)
    return F.struct(*(F.col(f"`{c}`") for c in names))


def json_of(column: Column) -> Column:
    """JSON text of a struct; null fields are kept as null."""
    return F.to_json(column, {"ignoreNullFields": "false"})
