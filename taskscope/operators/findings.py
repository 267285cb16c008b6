"""Findings: filters, suppression, deduplication, order, summaries and the check registry."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..session import compiled_methods, stored
from ..functions.skew import first_per
from ..functions.text import weight

_LINE_BUCKET = 64


def severity_weight(col: Column) -> Column:
    return weight(col, C.SEVERITY_WEIGHT)


def confidence_weight(col: Column) -> Column:
    return weight(col, C.CONFIDENCE_WEIGHT)


def at_least(findings: DataFrame, severity: str | None = None, confidence: str | None = None) -> DataFrame:
    out = findings
    if severity:
        out = out.where(severity_weight(F.col("severity")) >= C.SEVERITY_WEIGHT[severity])
    if confidence:
        out = out.where(confidence_weight(F.col("confidence")) >= C.CONFIDENCE_WEIGHT[confidence])
    return out


def select_findings(
    findings: DataFrame, categories: list[str] | None = None, analyzers: list[str] | None = None,
    severity: str | None = None, confidence: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Chosen findings, and per repository how many the filters hid."""
    out = findings
    if analyzers:
        out = out.where(F.col("analyzer").isin(analyzers))
    base = out
    if categories:
        out = out.where(F.lower("category").isin([c.lower() for c in categories]))
    out = at_least(out, severity, confidence)
    shown = F.lit(True)
    if categories:
        shown = shown & F.lower("category").isin([c.lower() for c in categories])
    if severity:
        shown = shown & (severity_weight(F.col("severity")) >= C.SEVERITY_WEIGHT[severity])
    if confidence:
        shown = shown & (confidence_weight(F.col("confidence")) >= C.CONFIDENCE_WEIGHT[confidence])
    hidden = base.groupBy("repo").agg(F.count_if(~shown).alias("hidden"))
    return out, hidden


def gate(findings: DataFrame, fail_on: str, structural_only: bool = False) -> DataFrame:
    """Per repository whether no finding reaches ``fail_on``; optionally only structural items block."""
    blocks = severity_weight(F.col("severity")) >= C.SEVERITY_WEIGHT[fail_on]
    if structural_only:
        blocks = blocks & F.col("structural")
    return findings.groupBy("repo").agg((~F.bool_or(blocks)).alias("passed"))


def scope(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings in changed files; both sides use posix paths."""
    return findings.join(changed.select("repo", "file").distinct(), ["repo", "file"], "left_semi")


def suppress(findings: DataFrame) -> DataFrame:
    """Drop a finding with a line range when a specific one of the same file lies within it.

    Specific findings have no range and a confidence of at least high. Lines are cut
    in buckets of 64, so a file with very many findings is spread over many keys.
    """
    specific = findings.where(F.col("superseded").isNull() & (confidence_weight(F.col("confidence")) >= 3))
    points = specific.select("repo", "file", F.col("line").alias("_at")).distinct()
    points = points.withColumn("_b", F.floor(F.col("_at") / _LINE_BUCKET).cast("int"))
    ranged = findings.where(F.col("superseded").isNotNull())
    spans = ranged.select("repo", "file", "superseded").distinct()
    first = F.floor(F.col("superseded.start_line") / _LINE_BUCKET).cast("int")
    last = F.floor(F.col("superseded.end_line") / _LINE_BUCKET).cast("int")
    spread = spans.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
    covered = (
        spread.join(points, ["repo", "file", "_b"])
        .where(F.col("_at").between(F.col("superseded.start_line"), F.col("superseded.end_line")))
        .select("repo", "file", F.col("superseded.start_line").alias("_s"), F.col("superseded.end_line").alias("_e")).distinct()
    )
    kept = ranged.withColumn("_s", F.col("superseded.start_line")).withColumn("_e", F.col("superseded.end_line"))
    kept = kept.join(covered, ["repo", "file", "_s", "_e"], "left_anti").select(*findings.columns)
    return findings.where(F.col("superseded").isNull()).unionByName(kept).drop("superseded")


def dedupe_findings(findings: DataFrame, order: str | None = None) -> DataFrame:
    """Highest severity per (repo, file, line, id) after suppression; first in ``order`` on ties."""
    tie = [F.col(order)] if order else [F.desc(confidence_weight(F.col("confidence"))), F.col("title"), F.col("evidence"), F.col("col")]
    return first_per(suppress(findings), ["repo", "file", "line", "id"], [F.desc(severity_weight(F.col("severity"))), *tie])


def order_findings(findings: DataFrame) -> DataFrame:
    """Report order: severity, confidence, file, line, id."""
    return findings.orderBy(
        F.desc(severity_weight(F.col("severity"))), F.desc(confidence_weight(F.col("confidence"))), "file", "line", "id"
    )


def summarise(findings: DataFrame) -> DataFrame:
    """Counts per repository and severity, one column per severity."""
    return findings.groupBy("repo").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES])


# --- registry -----------------------------------------------------------------


class Registry:
    """Named checks ``inputs -> findings``.

    A check that cannot be planned, or fails while it runs, is reported and does not
    lose the findings of the others: each check's findings are stored on their own.
    """

    def __init__(self) -> None:
        self._checks: dict[str, tuple[Callable[[dict[str, DataFrame]], DataFrame], str | None]] = {}

    def register(self, check_id: str, check: Callable[[dict[str, DataFrame]], DataFrame], platform: str | None = None) -> "Registry":
        if not isinstance(check_id, str) or not check_id:
            raise ValueError("A check must have a non-empty string id.")
        if not callable(check):
            raise ValueError(f'Check "{check_id}" must be callable.')
        if check_id in self._checks:
            raise ValueError(f'Check "{check_id}" is already registered.')
        self._checks[check_id] = (check, platform)
        return self

    def list(self) -> list[str]:
        return list(self._checks)

    def run(
        self, inputs: dict[str, DataFrame], platforms: DataFrame | None = None, only: list[str] | None = None
    ) -> tuple[DataFrame | None, list[str], dict[str, str]]:
        """Union of the findings, the checks that ran, and the errors by check.

        ``platforms(repo, platform)`` gates each check to the repositories that use its
        technology; naming checks in ``only`` overrides the gate.
        """
        out, ran, errors = None, [], {}
        for check_id, (check, platform) in self._checks.items():
            if only and check_id not in only:
                continue
            try:
                with compiled_methods(next(iter(inputs.values())).sparkSession) if inputs else nullcontext():
                    found = check(inputs)
                    if platform and platforms is not None and not only:
                        users = platforms.where(F.col("platform") == platform).select("repo").distinct()
                        found = found.join(users, "repo", "left_semi")
                    found = stored(found, "findings")
            except Exception as error:
                errors[check_id] = str(error)
                continue
            out = found if out is None else out.unionByName(found)
            ran.append(check_id)
        return out, ran, errors
