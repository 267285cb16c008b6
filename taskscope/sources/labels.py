"""Evaluation cases and defect labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CASE_SCHEMA = "case_id STRING, prompt STRING, fixture STRING, expected ARRAY<STRING>, allowed ARRAY<STRING>, forbidden ARRAY<STRING>, rejected ARRAY<STRING>"
LABEL_SCHEMA = (
    "name STRING, expected ARRAY<STRUCT<id: STRING, file: STRING>>, controls ARRAY<STRUCT<file: STRING>>, "
    "tolerated ARRAY<STRUCT<id: STRING, file: STRING>>, stack MAP<STRING, STRING>, forbiddenAnalyzers ARRAY<STRING>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Routing cases of JSON-lines files; ``rejected`` is another name of ``forbidden``."""
    raw = spark.read.schema(CASE_SCHEMA).json(path)
    none = F.array().cast("array<string>")
    some = lambda *c: F.coalesce(*[F.col(x) for x in c], none)
    return raw.select("case_id", "prompt", "fixture", some("expected").alias("expected"), some("allowed").alias("allowed"), some("rejected", "forbidden").alias("forbidden"))


def case_items(cases: DataFrame) -> DataFrame:
    """Long form of the case lists: ``(case_id, role, item)``."""
    rows = F.concat(*[_tagged(role) for role in ("expected", "allowed", "forbidden")])
    return cases.select("case_id", F.explode(rows).alias("_r")).select("case_id", "_r.role", "_r.item")


def _tagged(role: str):
    return F.transform(F.col(role), lambda v: F.struct(F.lit(role).alias("role"), v.alias("item")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Defect labels of JSON files, one per fixture, as ``(fixture, role, id, file)``."""
    raw = spark.read.schema(LABEL_SCHEMA).option("multiLine", "true").json(path)
    pair = lambda c, role: F.transform(
        F.coalesce(F.col(c), F.array().cast("array<struct<id:string,file:string>>")),
        lambda v: F.struct(F.lit(role).alias("role"), v["id"].alias("id"), v["file"].alias("file")),
    )
    control = F.transform(
        F.coalesce("controls", F.array().cast("array<struct<file:string>>")),
        lambda v: F.struct(F.lit("control").alias("role"), F.lit(None).cast("string").alias("id"), v["file"].alias("file")),
    )
    barred = F.transform(
        F.coalesce("forbiddenAnalyzers", F.array().cast("array<string>")),
        lambda v: F.struct(F.lit("forbidden_analyzer").alias("role"), v.alias("id"), F.lit(None).cast("string").alias("file")),
    )
    rows = F.concat(pair("expected", "expected"), pair("tolerated", "tolerated"), control, barred)
    return raw.select(F.col("name").alias("fixture"), F.explode(rows).alias("_r")).select("fixture", "_r.role", "_r.id", "_r.file")
