"""List, count, wrap and serialise the records of any table.

All are built-in expressions. Nulls are kept and counted, repeated rows are listed and counted as
often as they occur, and an empty table gives no records, a count of 0 and an envelope with ``[]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import json_of, record_of

#: Records that one envelope may hold: it is one row, so one task builds it.
MAX_ROWS = 1_000_000


def list_records(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    """Every record with the columns ``cols``; sorted by ``key`` only if one is given (a range exchange)."""
    listed = df.select(*(F.col(f"`{c}`") for c in cols))
    return listed.orderBy(F.col(f"`{key}`")) if key else listed


def count_records(df: DataFrame) -> DataFrame:
    """One row with the number of records: partial counts on every partition, then one row each."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def envelope(
    df: DataFrame, cols: Sequence[str], key: str, status: str, message: str, max_rows: int = MAX_ROWS
) -> DataFrame:
    """One row ``status, message, count, data``; ``data`` holds all records as structs, sorted by ``key``.

    Count and data come from one aggregate, so they agree for every parse mode. The row is built by
    one task: the plan reads ``max_rows + 1`` records at most and fails if there are that many, so
    no envelope silently misses a record. Larger tables go through ``enveloped_records`` or ``write_records``.
    """
    some = df.select(record_of(cols, key).alias("record")).limit(max_rows + 1)
    one = some.agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("record")).alias("data"))
    data = F.transform("data", lambda r: F.struct(*(r[c].alias(c) for c in cols)))
    within = F.when(F.col("count") <= max_rows, data).otherwise(
        F.raise_error(F.lit(f"more than {max_rows} records: use enveloped_records"))
    )
    return one.select(F.lit(status).alias("status"), F.lit(message).alias("message"), "count", within.alias("data"))


def enveloped_records(df: DataFrame, cols: Sequence[str], status: str, message: str) -> DataFrame:
    """The envelope of a table of any size: one row ``status, message, count, data`` for each record, its JSON text in ``data``.

    The count adds up partial counts of the same texts, so it agrees with the rows for every parse
    mode; it reaches the rows as a scalar of the plan, and the records stay where they were read. An
    empty table gives one row with a count of 0 and no data.
    """
    records = df.select(json_of(record_of(cols)).alias("data"))
    # the length makes the count read the records: a bare one would skip parsing them
    total = F.sum(F.when(F.length("data") >= 0, 1).otherwise(0))
    summary = records.agg(F.coalesce(total, F.lit(0)).cast("long").alias("count"))
    head = [F.lit(status).alias("status"), F.lit(message).alias("message")]
    rows = records.select(*head, summary.scalar().alias("count"), "data")
    nothing = summary.filter("count = 0").select(*head, "count", F.lit(None).cast("string").alias("data"))
    return rows.unionByName(nothing)


def json_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text with its columns in order, nulls kept."""
    return df.select(json_of(record_of(df.columns)).alias(name))


def record_json(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One JSON text a record."""
    return json_document(list_records(df, cols), "record")
