"""JSON-lines histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_history(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON-lines files; blank and unparsable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stream_history(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The same as a file stream."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").json(path)
