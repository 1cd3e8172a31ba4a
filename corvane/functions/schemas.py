"""Declared schemas. ``createdAt`` stays text, so it is returned unchanged."""

from pyspark.sql import types as T

USER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("isActive", T.BooleanType()),
        T.StructField("createdAt", T.StringType()),
    ]
)
