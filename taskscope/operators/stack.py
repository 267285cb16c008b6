"""Technology stacks of repositories from their evidence, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import paths
from ..functions.text import literal_array, normalize, pattern


def detect_platforms(evidence: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """(repo, platform, kind, value, source) hits of the fixed detection table.

    ``evidence(repo, kind, value, source)``, ``contents(repo, kind, text)``. The express
    platform counts only where the nest platform was not found.
    """
    by_key: dict[tuple[str, str], list[str]] = {}
    for platform, kind, key in C.STACK_RULES:
        by_key.setdefault((kind, key), []).append(platform)
    keyed = F.concat_ws("\u0000", "kind", "value")
    known = F.create_map(*[x for (kind, key), ps in by_key.items() for x in (F.lit(f"{kind}\u0000{key}"), literal_array(ps))])
    hits = evidence.withColumn("_p", F.try_element_at(known, keyed)).where(F.col("_p").isNotNull())
    firsts = hits.groupBy("repo", "kind", "value").agg(F.min("source").alias("source"), F.first("_p").alias("_p"))
    found = firsts.select("repo", F.explode("_p").alias("platform"), "kind", "value", "source")
    if contents is not None:
        tests = F.array_compact(F.array(*[
            F.when((F.col("kind") == kind) & F.col("text").rlike(pattern(regex)), F.struct(F.lit(platform).alias("platform"), F.lit(what).alias("value")))
            for platform, kind, regex, what in C.STACK_CONTENT_RULES
        ]))
        seen = contents.select("repo", "kind", F.explode(tests).alias("_t")).select(
            "repo", F.col("_t.platform").alias("platform"), F.lit("content").alias("kind"), F.col("_t.value").alias("value"), F.col("kind").alias("source")
        )
        found = found.unionByName(seen.distinct())
    nest = found.where(F.col("platform") == "nestjs-backend").select("repo").distinct()
    express = found.where(F.col("platform") == "express-backend").join(nest, "repo", "left_anti")
    return found.where(F.col("platform") != "express-backend").unionByName(express)


def platform_sets(hits: DataFrame) -> DataFrame:
    return hits.groupBy("repo").agg(F.array_sort(F.collect_set("platform")).alias("platforms"))


def stack_fields(platforms: Column, has_manifest: Column) -> list[Column]:
    """The twelve labelled fields; a field without evidence is null."""
    out = []
    for field, options in C.STACK_FIELDS:
        value = None
        for platform, label in options:
            cond = F.array_contains(platforms, platform)
            value = F.when(cond, label) if value is None else value.when(cond, label)
        if field == "language":
            value = value.when(has_manifest, "JavaScript")
        out.append(value.alias(field))
    return out


def detect_stack(repos: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per repository; ``repos(repo, has_manifest)``."""
    sets = repos.join(platform_sets(hits), "repo", "left").withColumn("platforms", F.coalesce("platforms", F.array().cast("array<string>")))
    return sets.select("repo", "platforms", *stack_fields(F.col("platforms"), F.col("has_manifest")))


def undetected_fields(stack: DataFrame) -> DataFrame:
    """Stack fields of each repository without any evidence."""
    names = [f for f, _ in C.STACK_FIELDS]
    return stack.select("repo", F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in names])).alias("undetected"))


def applicable_families(stack: DataFrame) -> DataFrame:
    """(repo, family) pairs of the check families a stack asks for; ``not_run`` lists the others."""
    wanted = F.array_compact(F.array(*[
        F.lit(f) if p is None else F.when(F.array_contains("platforms", p), f) for f, p in C.FAMILY_PLATFORMS.items()
    ]))
    return stack.select("repo", wanted.alias("families"), F.array_except(literal_array(list(C.FAMILY_PLATFORMS)), wanted).alias("not_run"))


def recommend_packs(stack: DataFrame) -> DataFrame:
    """Recommended packs per repository in fixed order, filled with fallbacks up to three."""
    direct = F.array_compact(F.array(*[
        F.when(F.arrays_overlap("platforms", literal_array(ps)), pack) for pack, ps in C.PACK_RULES
    ]))
    filled = F.concat(direct, F.slice(literal_array(C.PACK_FALLBACKS), F.lit(1), F.greatest(F.lit(0), C.PACK_MINIMUM - F.size(direct))))
    return stack.select("repo", F.posexplode(filled).alias("pos", "pack")).select("repo", "pack", (F.col("pos") + 1).alias("rank"))


_LANGUAGE_WORDS = [("TypeScript", "typescript"), ("Python", "python"), ("Go", "go"), ("React", "react"), ("Next.js", "next"), ("React Native", "expo")]
_LANGUAGE_EXT = [
    ("TypeScript", [".ts", ".tsx"]), ("JavaScript", [".js", ".jsx", ".mjs", ".cjs"]), ("Python", [".py"]), ("Go", [".go"]), ("Rust", [".rs"]), ("Java", [".java"]),
]


def project_profile(packages: DataFrame, recent: DataFrame) -> DataFrame:
    """Profile text of a repository: packages, languages and recent files.

    ``packages(repo, ord, path, name, description, keywords, dependencies, scripts, config_files)``
    (arrays for the last four), ``recent(repo, rank, file)``.
    """
    some = lambda c: F.array_join(F.col(c), " ")
    signal = F.array_join(F.filter(F.array(
        F.coalesce("path", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), some("keywords"),
        some("dependencies"),
        F.when(F.size("scripts") > 0, F.concat(F.lit("scripts "), some("scripts"))).otherwise(""), some("config_files"),
    ), lambda v: v != ""), " ")
    deps = normalize(some("dependencies"))
    from_deps = F.array_compact(F.array(*[
        F.when(
            deps.contains(word) | (F.array_contains("config_files", "tsconfig.json") if label == "TypeScript" else F.lit(False))
            | (deps.contains("react native") if label == "React Native" else F.lit(False)), label,
        )
        for label, word in _LANGUAGE_WORDS
    ]))
    per_repo = packages.select("repo", "ord", signal.alias("signal"), from_deps.alias("langs")).groupBy("repo").agg(
        F.sort_array(F.collect_list(F.struct("ord", "signal", "langs"))).alias("_p")
    )
    ext = paths.extension(F.col("file"))
    label = None
    for name, exts in _LANGUAGE_EXT:
        label = F.when(ext.isin(exts), name) if label is None else label.when(ext.isin(exts), name)
    files = recent.groupBy("repo").agg(
        F.sort_array(F.collect_list(F.struct("rank", "file", label.alias("lang")))).alias("_f")
    )
    df = per_repo.join(files, "repo", "full_outer")
    none = F.array().cast("array<string>")
    signals = F.coalesce(F.transform("_p", lambda p: p["signal"]), none)
    langs = F.array_distinct(F.concat(
        F.coalesce(F.flatten(F.transform("_p", lambda p: p["langs"])), none), F.array_compact(F.coalesce(F.transform("_f", lambda f: f["lang"]), none)),
    ))
    langs = F.when((F.size(langs) == 0) & F.col("_p").isNotNull(), F.array(F.lit("JavaScript"))).otherwise(langs)
    names = F.coalesce(F.transform("_f", lambda f: f["file"]), none)
    text = F.array_join(F.filter(F.array(
        F.when(F.size(signals) > 0, F.concat(F.lit("[project packages: "), F.array_join(signals, " | "), F.lit("]"))).otherwise(""),
        F.when(F.size(langs) > 0, F.concat(F.lit("[project languages: "), F.array_join(langs, " "), F.lit("]"))).otherwise(""),
        F.when(F.size(names) > 0, F.concat(F.lit("[recent files: "), F.array_join(names, ", "), F.lit("]"))).otherwise(""),
    ), lambda v: v != ""), " ")
    return df.select("repo", text.alias("profile"))
