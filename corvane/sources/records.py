"""Record tables from JSON, Parquet or the catalog, and their JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet", mode: str = "FAILFAST"
) -> DataFrame:
    """All records of ``path`` with the declared schema; unknown fields are ignored.

    ``fmt`` is ``json``, ``parquet`` or ``table`` (then ``path`` is a table's name). JSON needs a
    schema: an inferred one would cost a pass and change with the data. A malformed JSON record
    fails the read unless ``mode`` says otherwise.
    """
    if fmt == "table":
        table = spark.table(path)
        return table.select(*schema.fieldNames()) if schema else table
    if fmt == "json":
        if schema is None:
            raise ValueError("JSON records need a declared schema")
        return spark.read.schema(schema).option("mode", mode).json(path)
    if fmt == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def write_records(df: DataFrame, path: str, status: str, message: str) -> DataFrame:
    """Writes one JSON object a line, as many files as there are partitions; returns a one-row summary.

    This is the unbounded form of the envelope: the count comes from the written files, so it
    agrees with what readers will see even when tasks were retried.
    """
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    written = df.sparkSession.read.text(path)
    return written.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(status).alias("status"), F.lit(message).alias("message"), "count", F.lit(path).alias("data")
    )
