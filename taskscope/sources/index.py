"""Vector index and embedding cache tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_index(df: DataFrame, path: str, slices: int = 16) -> None:
    """Replace all rows of every (kind, model) present in ``df``; other partitions stay.

    A kind is written by up to ``slices`` tasks, so one large kind is not one task.
    """
    (
        df.repartition("kind", "model", F.pmod(F.xxhash64("id"), F.lit(slices))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("kind", "model").parquet(path)
    )


def index_for(repos: DataFrame, index: DataFrame, shared: str = "global") -> DataFrame:
    """Which index partition each repository reads: its own, or the shared one where it has none.

    ``index(kind, id, ...)`` holds a repository's rows under ``kind = repo``. The result
    ``(repo, kind)`` is joined to the index on ``kind``, so shared rows are not copied.
    """
    has = index.select(F.col("kind").alias("repo")).distinct().withColumn("_own", F.lit(True))
    return repos.select("repo").distinct().join(has, "repo", "left").select(
        "repo", F.when(F.col("_own"), F.col("repo")).otherwise(F.lit(shared)).alias("kind")
    )


def cache_key(model: str, text: str = "text", fingerprint: str = "fingerprint"):
    return F.sha2(F.concat_ws("\u0000", F.lit(model), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(fingerprint), F.lit(""))), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts without a cached vector for the model, one row per key."""
    keyed = texts.withColumn("key", cache_key(model)).dropDuplicates(["key"])
    return keyed.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")
