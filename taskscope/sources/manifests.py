"""Project evidence from package manifests and configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

_MAPS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
_SCHEMA = "name STRING, description STRING, keywords ARRAY<STRING>, " + ", ".join(f"{m} MAP<STRING, STRING>" for m in [*_MAPS, "scripts"])


def parse_manifests(files: DataFrame) -> DataFrame:
    """``files(repo, path, text)`` of package manifests; unparsable ones are dropped."""
    parsed = files.withColumn("m", F.from_json("text", _SCHEMA, {"mode": "PERMISSIVE"}))
    globs = F.coalesce(
        F.from_json(F.get_json_object("text", "$.workspaces"), "ARRAY<STRING>"),
        F.from_json(F.get_json_object("text", "$.workspaces.packages"), "ARRAY<STRING>"),
        F.array().cast("array<string>"),
    )
    return parsed.where(F.try_parse_json("text").isNotNull()).select("repo", "path", "m.*", globs.alias("workspaces"))


def _names(column: str) -> Column:
    return F.coalesce(F.map_keys(column), F.array().cast("array<string>"))


def read_manifests(files: DataFrame, sections: int = 4) -> DataFrame:
    """Evidence rows ``(repo, kind, value, source)``: dependencies, scripts and the manifests themselves.

    Four dependency sections describe a stack; catalog evidence uses the first three.
    """
    m = parse_manifests(files)
    tag = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    rows = F.concat(
        tag(F.array_distinct(F.concat(*[_names(s) for s in _MAPS[:sections]])), "dependency"),
        tag(_names("scripts"), "script"), tag(F.array("path"), "file"),
    )
    return m.select("repo", F.col("path").alias("source"), F.explode(rows).alias("_e")).select("repo", "_e.kind", "_e.value", "source")


def workspace_packages(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Directories of workspace packages named by the root manifest.

    ``manifests`` is the result of ``parse_manifests``. A pattern names a folder, or all
    folders at one level with a single ``*``; both match on the folder before the star.
    """
    root = manifests.where(F.col("path") == "package.json").select("repo", F.explode("workspaces").alias("glob"))
    glob = F.regexp_replace(F.regexp_replace("glob", r"\\", "/"), "/+$", "")
    valid = root.withColumn("glob", glob).where(
        (F.col("glob") != "") & ~F.col("glob").startswith("..") & ~F.col("glob").startswith("/") & ~F.col("glob").contains("**")
    )
    parts = F.split("glob", "/")
    star = F.array_position(parts, "*")
    shaped = valid.select("repo", "glob", star.alias("star"), parts.alias("parts"))
    folders = files.where(paths.basename(F.col("path")) == "package.json").select("repo", paths.dirname(F.col("path")).alias("dir")).distinct()
    exact = shaped.where("star = 0").select("repo", F.col("glob").alias("dir")).join(folders, ["repo", "dir"], "left_semi")
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("star").cast("int") - 1), "/")
    suffix = F.array_join(F.slice("parts", F.col("star").cast("int") + 1, F.size("parts")), "/")
    starred = shaped.where("star > 0").select("repo", prefix.alias("prefix"), suffix.alias("suffix"), F.size("parts").alias("levels"), "star")
    segments = F.split("dir", "/")
    cut = folders.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(segments)))).select(
        "repo", "dir", F.array_join(F.slice(segments, F.lit(1), F.col("_n") - 1), "/").alias("prefix"),
        F.element_at(segments, F.col("_n")).alias("_at"), F.array_join(F.slice(segments, F.col("_n") + 1, F.size(segments)), "/").alias("suffix"),
    )
    wild = cut.where(~F.col("_at").startswith(".")).join(starred, ["repo", "prefix", "suffix"]).select("repo", "dir")
    return exact.unionByName(wild).distinct()


def read_file_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of ``pubspec.yaml`` files: names indented by two under ``dependencies:``."""
    block = F.regexp_extract("text", r"(?m)^dependencies:[^\S\n]*\r?\n((?:[^\S\n].*(?:\n|$)|[^\S\n]*\r?\n)*)", 1)
    names = F.regexp_extract_all(block, F.lit(r"(?m)^[^\S\n]{2}([A-Za-z0-9_-]+):"), F.lit(1))
    return files.where(paths.basename(F.col("path")) == "pubspec.yaml").select(
        "repo", F.lit("dependency").alias("kind"), F.explode(names).alias("value"), F.col("path").alias("source")
    )
