"""Source corpora: which files of a repository are read, and what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import paths
from ..functions.skew import top_n
from ..functions.text import literal_array


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def filter_corpus(
    files: DataFrame, profile: str = "source", include_tests: bool = False,
    max_files: int | None = None, max_bytes: int | None = None, max_depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Files of a corpus profile and the ones skipped for their size.

    ``files(repo, path, size, ...)`` with paths relative to the repository. Every file of
    the profile is kept, unless a caller sets a limit. With ``max_files``, paths alone are
    ranked, and ``truncated`` tells whether the repository had more.
    """
    p = C.SCAN_PROFILES[profile]
    search = profile == "search"
    excluded = C.SEARCH_EXCLUDED_DIRS if search else C.SCAN_EXCLUDED_DIRS
    if include_tests and not search:
        excluded = [d for d in excluded if d not in C.SCAN_TEST_DIRS]
    posix = files.withColumn("path", paths.posix(F.col("path")))
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda s: s.startswith(".") & (s != ".github")) if search else F.exists(parts, lambda s: s.startswith("."))
    fit = posix.where(
        paths.extension(F.col("path")).isin(p["extensions"]) & ~F.arrays_overlap(_dirs(F.col("path")), literal_array(excluded)) & ~hidden
    )
    if max_depth is not None:
        fit = fit.where(F.size(_dirs(F.col("path"))) <= max_depth)
    if not search:
        fit = fit.where(~F.col("path").endswith(".d.ts"))
    skipped = fit.limit(0)
    if max_bytes is not None:
        skipped = fit.where(F.col("size") > max_bytes)
        fit = fit.where(F.col("size") <= max_bytes)
    if max_files is not None:
        named = fit.select("repo", "path")
        counts = named.groupBy("repo").agg((F.count("*") > max_files).alias("truncated"))
        fit = fit.join(top_n(named, ["repo"], [F.col("path")], max_files).join(counts, "repo"), ["repo", "path"])
    return fit, skipped.select("repo", "path", F.lit("larger than the size limit").alias("reason"))


def scan_corpus(spark: SparkSession, root: str, profile: str = "source", include_tests: bool = False, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Scan a folder of repositories: ``root/<repo>/<path>``, with file texts.

    Limits are those of ``filter_corpus``; with ``max_files``, contents are joined to the ranked paths.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    local = F.substring_index(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), base, -1)
    listed = raw.select(
        F.substring_index(local, "/", 1).alias("repo"), F.regexp_replace(local, "^[^/]+/", "").alias("path"), F.col("length").alias("size"),
        F.col("content").cast("string").alias("text"),
    )
    return filter_corpus(listed, profile, include_tests, **limits)


def coverage(skipped: DataFrame, sample: int = 3) -> DataFrame:
    """Skipped files per repository and reason: count, first samples by path, and the remainder."""
    counts = skipped.groupBy("repo", "reason").agg(F.count("*").alias("n"))
    first = top_n(skipped, ["repo", "reason"], [F.col("path")], sample).groupBy("repo", "reason").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("samples")
    )
    return counts.join(first, ["repo", "reason"]).withColumn("more", F.greatest(F.lit(0), F.col("n") - sample))
