"""Tables written between the jobs of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/taskscope-llm"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for one job; keys are written with ``__`` for dots."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` as a table in the shared folder and return its path; the job's shuffle files go once it is written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with settings(spark, **{_CLEANUP: "true"}):
        df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from a table in the shared folder: its lineage is cut."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))
