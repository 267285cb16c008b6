"""The registered queries: what they cover, how they run, and their SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# tables whose rows are long texts, so that the work per row is large
TEXT_TABLES = ["documents", "pages", "conversations"]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The driver tables of one folder, and inputs derived from them by SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = instants(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        return self.spread(df) if name in TEXT_TABLES else df

    def spread(self, df: DataFrame) -> DataFrame:
        """Use every core for a table that is scanned in fewer tasks than there are cores.

        A large table is scanned in many tasks and stays as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def derive(self, sql: str) -> DataFrame:
        """Run a binding, whose tables are written as ``{table}``."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in sql}
        text = sql.replace("{", "{{").replace("}", "}}")
        for t in used:
            text = text.replace("{{" + t + "}}", "{" + t + "}")
        return self.spark.sql(text, **used)


def instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as points in time, which watermarks and time spans need."""
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def plain(sql: str) -> str:
    """A binding as text for an engine where the tables are views."""
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql


def query(name: str, covers: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, fn, sql)
        return fn

    return add
