"""Selection: elbow cuts, diversification, banding, budgets, dedup and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import paths
from ..functions.skew import first_per, top_n
from ..functions.text import clean, first_pattern, matches, normalize, pattern


def normalised_score(df: DataFrame, columns: list[str] = ("confidence", "rank_score", "embedding_score", "score")) -> Column:
    """First non-null score; above 1 it is divided by 10, and no score at all is 0.75."""
    found = [F.col(c).cast("double") for c in columns if c in df.columns]
    raw = F.coalesce(*found) if found else F.lit(None).cast("double")
    scaled = F.when(raw > 1, F.least(F.lit(1.0), raw / 10)).otherwise(F.greatest(F.lit(0.0), raw))
    return F.when(raw.isNull(), 0.75).when(F.isnan(raw), 0.0).otherwise(scaled)


def elbow(
    df: DataFrame, keys: list[str], score: str, tie: list[str], minimum: int, maximum: int, gap: float, floor: float
) -> DataFrame:
    """Cut every group at its first score gap of at least ``gap``.

    Keeps at least ``minimum`` and at most ``maximum`` rows at or above ``floor``.
    """
    order = [F.desc(score), *[F.col(c) for c in tie]]
    best = top_n(df.where(F.col(score) >= floor), keys, order, maximum)
    w = Window.partitionBy(*keys).orderBy("rank")
    drop = F.lag(score).over(w) - F.col(score)
    cut = F.min(F.when((drop >= gap) & (F.col("rank") > minimum), F.col("rank"))).over(Window.partitionBy(*keys))
    return best.withColumn("_cut", cut.cast("int")).withColumn("_drop", drop).where(
        F.col("_cut").isNull() | (F.col("rank") < F.col("_cut"))
    ).drop("_cut", "_drop")


def diversify(df: DataFrame, keys: list[str], bucket: str, order: list[Column], k: int) -> DataFrame:
    """Round robin over buckets, buckets ordered by their best row; adds ``rank``.

    At most ``k`` rows of a bucket can be chosen, so each bucket is cut to ``k`` first.
    """
    per_bucket = top_n(df, [*keys, bucket], order, k, rank="_round")
    best = Window.partitionBy(*keys).orderBy(*order)
    ranked = per_bucket.withColumn("_place", F.row_number().over(best))
    lead = F.min("_place").over(Window.partitionBy(*keys, bucket))
    ranked = ranked.withColumn("_lead", lead)
    return top_n(ranked, keys, [F.col("_round"), F.col("_lead")], k).drop("_round", "_place", "_lead")


def complexity(prompt: Column) -> Column:
    text = F.lower(clean(prompt))
    actions = F.regexp_count(text, F.lit(pattern(C.COMPLEXITY_ACTIONS)))
    table = dict(C.COMPLEXITY_PATTERNS)
    return (
        F.when(matches(text, table["refactor"]), "refactor")
        .when((actions >= 5) | matches(text, table["large_feature"]), "large_feature")
        .when(matches(text, table["feature"]), "feature")
        .when(matches(text, table["small_fix"]), "small_fix")
        .otherwise("feature")
    )


def complexity_limit(label: Column) -> Column:
    out = None
    for name, limit in C.COMPLEXITY_LIMITS.items():
        out = F.when(label == name, limit) if out is None else out.when(label == name, limit)
    return out.otherwise(C.COMPLEXITY_LIMITS["feature"])


def file_bucket(path: Column) -> Column:
    return first_pattern(F.lower(clean(path)), C.FILE_BUCKETS, "other")


def select_files(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files for each task: complexity decides how many, buckets take turns.

    ``tasks(task_id, prompt)`` with an optional ``file_limit``, ``candidates(task_id, path, score, pos)``.
    A numeric limit keeps the first candidates in their order instead.
    """
    limits = tasks.select(
        "task_id", complexity_limit(complexity(F.col("prompt"))).alias("auto"), manual_limit(tasks, "file_limit").alias("manual")
    )
    most = max(C.COMPLEXITY_LIMITS.values())
    auto = candidates.join(limits.where(F.col("manual").isNull()).select("task_id", "auto"), "task_id")
    scored = auto.withColumn("_s", normalised_score(auto)).where((F.col("_s") >= 0.2) | (F.col("score") > 0))
    spread = diversify(scored.withColumn("bucket", file_bucket(F.col("path"))), ["task_id"], "bucket", [F.desc("_s"), F.col("path")], most)
    chosen = spread.where(F.col("rank") <= F.col("auto")).select("task_id", "path", "score", "rank")
    hand = candidates.join(limits.where(F.col("manual").isNotNull()).select("task_id", "manual"), "task_id")
    return chosen.unionByName(apply_limit(hand, ["task_id"], "manual", [F.col("pos")]).select("task_id", "path", "score", "rank"))


def manual_limit(df: DataFrame, column: str) -> Column:
    """Numeric limit of a setting; null for ``auto``, a missing or another value."""
    if column not in df.columns:
        return F.lit(None).cast("int")
    value = F.lower(F.trim(F.col(column).cast("string")))
    number = value.try_cast("double")
    return F.when((value == "auto") | number.isNull() | F.isnan(number), F.lit(None)).otherwise(
        F.greatest(F.lit(0), number.cast("int"))
    ).cast("int")


def apply_limit(df: DataFrame, keys: list[str], limit: str, order: list[Column], most: int | None = None) -> DataFrame:
    """First rows of each group up to the number in its ``limit`` column (null: all), and up to ``most`` where it is set."""
    if most is not None:
        ranked = top_n(df, keys, order, most)
    else:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(limit).isNull() | (F.col("rank") <= F.col(limit)))


def dedupe_catalog(catalog: DataFrame, group: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keep one item per normalised name: highest source priority, then first. Returns kept and removed."""
    keyed = catalog.withColumn("_key", normalize(F.col("name"))).where(F.col("_key") != "").withColumn("_prio", source_priority())
    order = [F.desc("_prio"), F.col("ord")]
    kept = first_per(keyed, [*group, "_key"], order)
    removed = keyed.join(kept.select(*group, "_key", F.col("ord").alias("_kept")), [*group, "_key"]).where(F.col("ord") != F.col("_kept"))
    return kept.drop("_key", "_prio"), removed.drop("_key", "_prio", "_kept")


def source_priority() -> Column:
    path = clean(F.col("path"))
    points = F.when(F.col("scope") == "project", 100).otherwise(0)
    for folder, value in ((".codex/skills/", 30), (".config/skillshare/skills/", 20), (".agents/skills/", 10)):
        points = points + F.when(path.contains("/" + folder), value).otherwise(0)
    return points


def finalise(df: DataFrame, limit: int, keys: list[str] = ("task_id",)) -> DataFrame:
    """Final choice of catalog items: explicit or rank score of at least 0.35, one per name."""
    keys = list(keys)
    keep = df.where(F.col("explicit") | (F.col("rank_score") >= C.ROUTER_THRESHOLD)).withColumn("_key", normalize(F.col("name")))
    order = [F.desc("rank_score"), F.desc("score"), F.desc(F.col("scope") == "project"), F.col("name")]
    return top_n(first_per(keep, [*keys, "_key"], order), keys, order, limit).drop("_key")


def preselect(df: DataFrame, score: str = "keyword_score", k: int | None = None, keys: list[str] = ("task_id",)) -> DataFrame:
    """Candidates with a score; the best ``k`` of each key where it is set."""
    found = df.where(F.col(score) > 0)
    return found if k is None else top_n(found, list(keys), [F.desc(score), F.col("name")], k)


def vector_gate(catalog: DataFrame, indexed: DataFrame, most: int | None = None) -> DataFrame:
    """Repositories whose catalog may be scored by vectors: those with an index, or, where ``most`` is set, with no more items."""
    counts = catalog.groupBy("repo").agg(F.count("*").alias("n"))
    return counts.join(indexed.select("repo").distinct().withColumn("has_index", F.lit(True)), "repo", "left").select(
        "repo", "n", (F.coalesce("has_index", F.lit(False)) | F.lit(most is None) | (F.col("n") <= F.lit(most))).alias("use_vectors")
    )


def recent(df: DataFrame, keys: list[str], ts: str, n: int, tie: list[str] = ()) -> DataFrame:
    """Last ``n`` rows of each group by time."""
    return top_n(df, keys, [F.desc(ts), *[F.desc(c) for c in tie]], n, rank="recency")


def recent_files(commits: DataFrame, n: int = 20) -> DataFrame:
    """``n`` most recent distinct files per repository; ``commits(repo, ord, file)``, newest first."""
    firsts = commits.where(F.trim("file") != "").groupBy("repo", "file").agg(F.min("ord").alias("ord"))
    return top_n(firsts, ["repo"], [F.col("ord"), F.col("file")], n)


def select_cases(cases: DataFrame, groups: list[str], n: int) -> DataFrame:
    """One case per wanted group in priority order, then the first cases up to ``n``.

    ``cases(case_id, fixture, ord)``. Only the first case of each group and the
    first ``n`` cases overall can be chosen, so both are cut before the ranking.
    """
    order = [F.col("ord"), F.col("case_id")]
    wanted = cases.where(F.col("fixture").isin(groups))
    firsts = first_per(wanted, ["fixture"], order)
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("fixture")).cast("bigint")
    picked = firsts.select("case_id", "fixture", "ord", F.lit(0).alias("phase"), place.alias("place"))
    head = cases.orderBy(*order).limit(n + len(groups))
    rest = head.join(picked.select("case_id"), "case_id", "left_anti").select(
        "case_id", "fixture", "ord", F.lit(1).alias("phase"), F.col("ord").cast("bigint").alias("place")
    )
    ranked = picked.unionByName(rest)
    return top_n(ranked.withColumn("_all", F.lit(1)), ["_all"], [F.col("phase"), F.col("place"), F.col("case_id")], n).drop("_all")


def assemble(parts: DataFrame, max_chars: int = 4000, marker: str = "truncated context") -> DataFrame:
    """Context text of each task from its selected sections.

    ``parts(task_id, section, title, style, ord, item)`` where ``section`` orders the
    sections and ``style`` is ``lines``, ``inline`` or ``comma``. Equal items appear once;
    a longer text is cut at ``max_chars - 80`` and marked. Selections bound the rows per task.
    """
    per_section = parts.where(F.col("item") != "").groupBy("task_id", "section", "title", "style").agg(
        F.sort_array(F.collect_list(F.struct("ord", "item"))).alias("_items")
    )
    items = F.array_distinct(F.transform("_items", lambda i: i["item"]))
    head = F.concat(F.lit("## "), F.col("title"))
    text = (
        F.when(F.col("style") == "lines", F.concat(head, F.lit("\n"), F.array_join(items, "\n")))
        .when(F.col("style") == "inline", F.concat(head, F.lit(": "), F.array_join(items, ", ")))
        .otherwise(F.concat(head, F.lit(", "), F.array_join(items, ", ")))
    )
    joined = per_section.withColumn("_text", text).groupBy("task_id").agg(
        F.sort_array(F.collect_list(F.struct("section", "_text"))).alias("_texts")
    )
    whole = F.array_join(F.transform("_texts", lambda t: t["_text"]), "\n\n")
    cut = F.rtrim(F.substring("_whole", 1, max(0, max_chars - 80)))
    note = F.lit(f"\n\n[{marker} to {max_chars} chars]")
    return joined.withColumn("_whole", whole).select(
        "task_id", F.when(F.length("_whole") <= max_chars, F.col("_whole")).otherwise(F.concat(cut, note)).alias("context")
    )


def display_names(files: DataFrame) -> DataFrame:
    """Base name of each chosen file, or its path when two of a task share the base name."""
    name = paths.basename(F.col("path"))
    same = F.count("*").over(Window.partitionBy("task_id", name))
    return files.withColumn("item", F.when(same > 1, F.col("path")).otherwise(name))


def is_ambiguous(prompt: Column) -> Column:
    """A prompt of at most two words, or of at most four that are all generic."""
    words = F.filter(F.split(normalize(prompt), " "), lambda w: w != "")
    return (F.size(words) <= 2) | ((F.size(words) <= 4) & F.forall(words, lambda w: w.isin(C.AMBIGUOUS_WORDS)))


def empty_reason(
    injecting: Column, has_context: Column, available: Column, enabled: Column
) -> Column:
    """Why a context is empty; null when it is not. ``available`` and ``enabled`` are section arrays."""
    order = F.array(*[F.lit(s) for s in ("rules", "files", "skills", "workflows")])
    missing = F.filter(order, lambda s: F.array_contains(enabled, s) & ~F.array_contains(available, s))
    both = F.filter(order, lambda s: F.array_contains(enabled, s) & F.array_contains(available, s))
    return (
        F.when(~injecting, "injection-disabled")
        .when(has_context, F.lit(None))
        .when(F.size(available) == 0, "no-context-candidates")
        .when(F.size(missing) > 0, F.concat(F.lit("enabled-sections-missing-candidates:"), F.array_join(missing, ",")))
        .when(F.size(both) > 0, "enabled-sections-empty-after-formatting")
        .otherwise(F.concat(F.lit("available-sections-disabled:"), F.array_join(available, ",")))
    )


def retrieval_mode(bridge: Column, model: Column) -> Column:
    """Bridge and embedding state with the fallback each implies, as a struct."""
    link = F.coalesce(F.nullif(bridge, F.lit("")), F.lit("mcp"))
    embedding = F.when(model == "disabled", "disabled").otherwise("enabled")
    fallback = link.isin("fallback", "fallback-failed") | (embedding == "disabled")
    return F.struct(
        link.alias("bridge"), embedding.alias("embedding"),
        F.when(fallback, "indexed-text-match").alias("file_fallback"),
        F.when(fallback, "lightweight-evidence-score").alias("skill_fallback"),
    )
