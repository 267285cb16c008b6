"""Evaluation: labels, metrics, leaderboards, readiness, rubric and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions.text import matches


def middle_risk(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Share of relevant rules that stood in the middle half of their document.

    ``scored(<keys>, pos, score)`` with one row per actionable rule.
    """
    total = scored.groupBy(*keys).agg(F.count("*").alias("rules"))
    relevant = scored.where(F.col("score") >= C.BAND_MID).join(total, keys)
    middle = F.col("pos").between(F.floor(F.col("rules") * 0.25), F.ceil(F.col("rules") * 0.75))
    counts = relevant.groupBy(*keys).agg(F.count("*").alias("relevant"), F.count_if(middle).alias("in_middle"))
    out = total.join(counts, keys, "left").na.fill(0, ["relevant", "in_middle"])
    return out.withColumn(
        "risk_percent", F.when(F.col("relevant") > 0, F.round(100 * F.col("in_middle") / F.col("relevant"))).otherwise(0).cast("bigint")
    )


# --- routing ------------------------------------------------------------------


def routing_metrics(cases: DataFrame, selected: DataFrame, top_k: int = 3) -> DataFrame:
    """Top-1 accuracy, recall, false positives, negative gate and calibration of a routing run.

    ``cases(case_id, expected, allowed, forbidden)`` arrays, ``selected(case_id, rank, id, confidence)``.
    """
    chosen = selected.where(F.col("rank") <= top_k).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "confidence"))).alias("_s")
    )
    df = cases.join(chosen, "case_id", "left").withColumn("_ids", F.coalesce(F.transform("_s", lambda s: s["id"]), F.array().cast("array<string>")))
    df = df.withColumn("_accepted", F.concat("expected", "allowed"))
    no_expected, none = F.size("expected") == 0, F.size("_ids") == 0
    calibrated = F.size(F.filter(
        F.coalesce(F.col("_s"), F.array().cast(df.schema["_s"].dataType)),
        lambda s: F.array_contains("_accepted", s["id"]) == (s["confidence"] >= 0.65),
    ))
    quiet = F.when(no_expected & none, 1).otherwise(0)
    count = lambda c, keep: F.size(F.filter(c, keep))
    sums = df.agg(
        F.count("*").alias("cases"),
        F.sum(F.when(no_expected, none.cast("int")).otherwise(F.coalesce(F.array_contains("expected", F.try_element_at("_ids", F.lit(1))), F.lit(False)).cast("int"))).alias("top1"),
        F.sum(F.size("expected")).alias("recall_total"), F.sum(count("expected", lambda e: F.array_contains("_ids", e))).alias("recall"),
        F.sum(F.size("_ids")).alias("fp_total"), F.sum(count("_ids", lambda s: ~F.array_contains("_accepted", s))).alias("fp"),
        F.sum(F.size("forbidden")).alias("gate_total"), F.sum(count("forbidden", lambda f: ~F.array_contains("_ids", f))).alias("gate"),
        F.sum(F.size("_ids") + quiet).alias("cal_total"), F.sum(calibrated + quiet).alias("cal"),
    )

    def rate(hits: str, total: str, empty: int) -> Column:
        return F.coalesce(F.try_divide(hits, total), F.lit(float(empty)))

    return sums.select(
        "cases", rate("top1", "cases", 0).alias("top1_accuracy"), rate("recall", "recall_total", 1).alias("top3_recall"),
        rate("fp", "fp_total", 0).alias("false_positive_rate"), rate("gate", "gate_total", 1).alias("negative_gate_accuracy"),
        rate("cal", "cal_total", 1).alias("calibration"),
    )


def case_correct(selected: Column, expected: Column, allowed: Column, forbidden: Column, quiet_when_empty: bool = True) -> Column:
    """All expected, none forbidden, none unexpected; a case without expectations wants no selection."""
    missing = F.size(F.array_except(expected, selected)) > 0
    surplus = F.size(F.array_except(selected, F.concat(expected, allowed))) > 0
    ok = ~missing & ~F.arrays_overlap(selected, forbidden) & ~surplus
    return ok & ((F.size(expected) > 0) | (F.size(selected) == 0)) if quiet_when_empty else ok


def leaderboard(runs: DataFrame) -> DataFrame:
    """Correct cases per system; ``runs(system, case_id, selected, expected, allowed, forbidden)``."""
    ok = case_correct(F.col("selected"), F.col("expected"), F.col("allowed"), F.col("forbidden"))
    return runs.groupBy("system").agg(F.count_if(ok).alias("correct"), F.count("*").alias("total"), F.avg(ok.cast("double")).alias("correct_rate"))


# --- detection ----------------------------------------------------------------


def label_findings(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of every finding and every missed label.

    ``findings(fixture, id, file, line)``, ``labels(fixture, role, id, file)`` with roles
    expected, tolerated and control. A label hit by several findings is one true positive.
    """
    key = ["fixture", "id", "file"]
    role = lambda r: labels.where(F.col("role") == r)
    expected = role("expected").select(*key).distinct()
    hits = findings.groupBy(*key).agg(F.min("line").alias("line"), F.count("*").alias("n"))
    marked = (
        hits.join(expected.withColumn("_e", F.lit(1)), key, "left")
        .join(role("tolerated").select(*key).distinct().withColumn("_t", F.lit(1)), key, "left")
        .join(role("control").select("fixture", "file").distinct().withColumn("_c", F.lit(1)), ["fixture", "file"], "left")
    )
    outcome = (
        F.when(F.col("_e").isNotNull(), "true_positive").when(F.col("_t").isNotNull(), "tolerated")
        .when(F.col("_c").isNotNull(), "false_positive").otherwise("unlabelled")
    )
    found = marked.select(*key, "line", outcome.alias("outcome"), F.when(F.col("_e").isNotNull(), 1).otherwise(F.col("n")).cast("bigint").alias("n"))
    missed = expected.join(hits, key, "left_anti").select(
        *key, F.lit(None).cast(findings.schema["line"].dataType).alias("line"), F.lit("false_negative").alias("outcome"), F.lit(1).cast("bigint").alias("n")
    )
    return found.unionByName(missed)


def detection_metrics(labelled: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Recall, precision over control files and the error rates, 4 decimals."""
    of = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(o)
    names = ["true_positive", "false_positive", "false_negative", "tolerated", "unlabelled"]
    sums = labelled.groupBy(*keys).agg(*[of(o) for o in names])
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    rate = lambda a, b, empty: F.round(F.coalesce(F.try_divide(a, b), F.lit(float(empty))), 4)
    return sums.select(
        *keys, *names, rate(tp, tp + fn, 0).alias("recall"), rate(tp, tp + fp, 1).alias("precision"),
        rate(fn, tp + fn, 0).alias("false_negative_rate"), rate(fp, tp + fp, 0).alias("false_positive_rate"),
    )


# --- readiness ----------------------------------------------------------------

_IMPERATIVE = r"(?i)\b(always|never|must|required|use|prefer|avoid|do not|don't)\b"


def readiness(repos: DataFrame, rules: DataFrame, catalog: DataFrame, workflows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Readiness of a repository from its rules, catalog and workflows.

    ``repos(repo, has_rule_dir)``, ``rules(repo, source_path, in_project, content)`` of
    actionable rules, ``catalog(repo, name, scope)``, ``workflows(repo, name, chain)``,
    ``metadata(repo, text)`` of the project's metadata files.
    """
    r = rules.groupBy("repo").agg(
        F.count_distinct(F.when(F.col("in_project"), F.col("source_path"))).alias("sources"), F.count("*").alias("actionable"),
        F.bool_or(matches(F.col("content"), _IMPERATIVE)).alias("imperative"),
    )
    c = catalog.groupBy("repo").agg(
        F.count("*").alias("items"), F.count_if(F.col("scope") == "project").alias("project_items")
    )
    rich = F.lit(True)
    for key in ("positive_triggers", "evidence", "negative_triggers", "workflow"):
        rich = rich & F.col("text").rlike(rf"(?m)^{key}:")
    m = metadata.groupBy("repo").agg(F.count("*").alias("metadata_files"), F.count_if(rich).alias("rich_files"))
    w = workflows.groupBy("repo").agg(F.count("*").alias("flows"), F.count_if(F.size("chain") > 0).alias("chained"))
    df = repos
    for part in (r, c, m, w):
        df = df.join(part, "repo", "left")
    df = df.na.fill(0, ["sources", "actionable", "items", "project_items", "metadata_files", "rich_files", "flows", "chained"])
    df = df.withColumn("imperative", F.coalesce("imperative", F.lit(False)))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    rule_score = (
        points(F.col("sources") > 0, 55) + points(F.col("actionable") >= 3, 20) + points(F.col("imperative"), 15)
        + points((F.col("sources") > 1) | F.col("has_rule_dir"), 10)
    )
    shared = F.col("items") - F.col("project_items")
    catalog_score = (
        points(F.col("items") > 0, 50) + points((shared > 0) | (F.col("project_items") >= 3), 25) + points(F.col("project_items") > 0, 10)
        + points(F.col("metadata_files") > 0, 5) + points(F.col("rich_files") > 0, 10)
    )
    flow_score = points(F.col("flows") > 0, 60) + points(F.col("chained") > 0, 25) + points(F.col("flows") >= 2, 15)
    override = F.when(F.col("project_items") >= 3, 100).when(F.col("project_items") == 2, 70).when(F.col("project_items") == 1, 40).otherwise(0)
    scored = df.select(
        "repo", F.least(F.lit(100), rule_score).alias("rule_score"), F.least(F.lit(100), catalog_score).alias("catalog_score"),
        F.least(F.lit(100), flow_score).alias("workflow_score"), override.alias("override_score"), "project_items",
    )
    scored = scored.withColumn(
        "overall", F.round((F.col("rule_score") + F.col("catalog_score") + F.col("workflow_score")) / 3).cast("int")
    )
    return scored.withColumn(
        "tier", tier(F.col("overall"), F.least("rule_score", "catalog_score", "workflow_score"), F.col("project_items"))
    ).drop("project_items")


def tier(overall: Column, weakest: Column, project_items: Column) -> Column:
    return (
        F.when(weakest < 50, "Not Ready").when((project_items == 0) & (overall >= 85), "Silver").when(overall >= 85, "Gold")
        .when(overall >= 70, "Silver").when(overall >= 50, "Bronze").otherwise("Not Ready")
    )


# --- rubric and latency -------------------------------------------------------


def rubric(checks: DataFrame, gates: DataFrame, weights: dict[str, float] = C.RUBRIC_WEIGHTS) -> DataFrame:
    """Weighted score per release and whether it is ready.

    ``checks(release, category, max, points)``, ``gates(release, gate, passed)``.
    """
    clipped = F.greatest(F.lit(0.0), F.least(F.col("max").cast("double"), F.col("points").cast("double")))
    per = checks.groupBy("release", "category").agg(F.sum("max").alias("max"), F.sum(clipped).alias("earned"))
    share = None
    for name, value in weights.items():
        share = F.when(F.col("category") == name, value) if share is None else share.when(F.col("category") == name, value)
    scored = per.withColumn("score", F.when(F.col("max") > 0, F.round(F.col("earned") / F.col("max") * share, 2)).otherwise(0.0))
    # category scores have two decimals; their sum is exact as a decimal
    exact = F.sum(F.col("score").cast("decimal(12,2)"))
    total = scored.groupBy("release").agg(F.round(exact, 1).cast("double").alias("score"))
    passed = gates.groupBy("release").agg(F.bool_and("passed").alias("gates_passed"), F.count_if(F.col("passed")).alias("gates"))
    out = total.join(passed, "release", "left").na.fill(0, ["gates"]).withColumn("gates_passed", F.coalesce("gates_passed", F.lit(False)))
    return out.withColumn("ready", (F.col("score") > C.RELEASE_READY_SCORE) & F.col("gates_passed"))


def latency_summary(runs: DataFrame) -> DataFrame:
    """Per suite and size: mean and p95 milliseconds, milliseconds per file, growth over the size before.

    ``runs(suite, size, files, ms)``. Sizes per suite are few, so the last window is small.
    """
    per = runs.groupBy("suite", "size").agg(
        F.count("*").alias("runs"), F.avg("ms").alias("mean_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"),
        (F.avg("ms") / F.greatest(F.lit(1), F.avg("files"))).alias("ms_per_file"),
    )
    order = Window.partitionBy("suite").orderBy("size")
    return per.withColumn("growth", F.try_divide("mean_ms", F.lag("mean_ms").over(order)))


def module_name(specifier: Column) -> Column:
    """Package of an import specifier, scope included; null for a path."""
    parts = F.split(specifier, "/")
    scoped = F.array_join(F.slice(parts, 1, 2), "/")
    return F.when(specifier.startswith(".") | specifier.startswith("/"), F.lit(None)).when(
        specifier.startswith("@"), scoped
    ).otherwise(F.element_at(parts, 1))


def distinct_modules(imports: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct packages imported per repository."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    named = imports.select("repo", module_name(F.col("specifier")).alias("module"))
    return named.groupBy("repo").agg(count("module").alias("modules"))
