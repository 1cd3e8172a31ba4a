"""Read a record table, list and count it, and give it as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corvane.functions.schemas import USER
from corvane.operators.records import MAX_ROWS, envelope, json_document
from corvane.sources.records import read_records, write_records

# The status and message of the listing.
STATUS, MESSAGE = "success", "Demo users fetched successfully"


def list_job(
    spark: SparkSession,
    path: str,
    schema: StructType = USER,
    key: str = "id",
    fmt: str = "json",
    status: str = STATUS,
    message: str = MESSAGE,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """One row ``document``: status, message, count and all records of ``path`` as JSON text."""
    records = read_records(spark, path, schema, fmt)
    return json_document(envelope(records, schema.fieldNames(), key, status, message, max_rows))


def written_job(df: DataFrame, path: str, status: str = STATUS, message: str = MESSAGE) -> DataFrame:
    """Writes all records of ``df`` as JSON to ``path``; gives them as they were written, with ``count`` from the summary.

    Writing and reading back are spread over all tasks, whatever the size of the table.
    """
    summary = write_records(df, path, status, message)
    back = read_records(df.sparkSession, path, df.schema, "json")
    return back.withColumn("count", summary.select("count").scalar())
