"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below the warehouse where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    top = top or spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
