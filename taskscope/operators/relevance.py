"""Relevance of written rules to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import vectors
from ..functions.skew import first_per, top_n
from ..functions.topk import OFTEN, rank_safe
from ..functions.text import clean, clamp01, half_up, literal_map, matches, strip, tokenize
from .parsing import identifiers, is_documentation_only, is_environment_rule, phrases


def is_imperative(content: Column) -> Column:
    lower = F.lower(clean(content))
    out = F.lit(False)
    for word in C.IMPORTANT_WORDS:
        out = out | lower.contains(word)
    return out


def actionable(rules: DataFrame) -> DataFrame:
    """Rules that carry an instruction, as they are numbered."""
    return rules.where(~is_environment_rule(F.col("content")) & ~is_documentation_only(F.col("content")))


def dedupe_rules(rules: DataFrame, keys: list[str]) -> DataFrame:
    """First rule per source and lower-cased content within ``keys``, by ``pos``."""
    return first_per(
        rules.withColumn("_key", F.lower("content")), [*keys, "source_path", "_key"], [F.col("pos")]
    ).drop("_key")


def renumber(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Number the rules of each document again from 0; a document bounds its group."""
    order = Window.partitionBy(*keys).orderBy("pos")
    out = rules.withColumn("pos", F.row_number().over(order) - 1)
    return out.withColumn("rule_id", F.concat(F.lit("r"), (F.col("pos") + 1).cast("string")))


def _task_terms(tasks: DataFrame) -> DataFrame:
    """Distinct task tokens and their aliases, one row per term and origin."""
    toks = tasks.select("repo", "task_id", F.array_distinct(tokenize(F.col("prompt"))).alias("toks"))
    # a second projection keeps the tokenizer from being run once per reference
    exact = F.transform(
        "toks", lambda t, i: F.struct(i.alias("at"), F.lit(0).alias("kind"), t.alias("token"), t.alias("label"))
    )
    aliases = literal_map(C.TOKEN_ALIASES)

    def alias_terms(t: Column, i: Column) -> Column:
        found = F.coalesce(F.try_element_at(aliases, t), F.array().cast("array<string>"))
        return F.transform(
            F.array_except(found, F.col("toks")),
            lambda a: F.struct(
                i.alias("at"), F.lit(1).alias("kind"), a.alias("token"), F.concat(t, F.lit("->"), a).alias("label")
            ),
        )

    known = F.transform(
        F.filter(
            F.transform("toks", lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
            lambda z: z["t"].isin(list(C.TOKEN_ALIASES)),
        ),
        lambda z: alias_terms(z["t"], z["i"]),
    )
    return toks.select(
        "repo", "task_id", F.size("toks").alias("n_tokens"), F.explode(F.concat(exact, F.flatten(known))).alias("_t")
    ).select("repo", "task_id", "n_tokens", "_t.at", "_t.kind", "_t.token", "_t.label")


def _open_file_hits(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """(task, rule) pairs where a dotted rule token appears in the open files.

    A dotted token contains one three-character window around its first dot, so
    the substring test becomes an equi-join on that window plus a check.
    """
    text = F.array_join("open_files", " ")
    opened = tasks.where(F.size("open_files") > 0).select("repo", "task_id", text.alias("open_text"))
    opened = opened.withColumn("_toks", tokenize(F.col("open_text")))
    windows = F.array_distinct(
        F.concat(
            F.regexp_extract_all("open_text", F.lit(r"(?=(.\..))"), F.lit(1)),
            F.flatten(F.transform("_toks", lambda t: F.regexp_extract_all(t, F.lit(r"(?=(.\..))"), F.lit(1)))),
        )
    )
    left = opened.select("repo", "task_id", "open_text", "_toks", F.explode(windows).alias("window"))
    dotted = rules.select(
        "repo", "rule_id", "pos", F.explode(F.array_distinct(F.filter(tokenize(F.col("content")), lambda t: t.contains(".")))).alias("token")
    ).withColumn("window", F.regexp_extract("token", r"^[^.]*?(.\..)", 1))
    hit = F.array_contains("_toks", F.col("token")) | F.col("open_text").contains(F.col("token"))
    return left.join(dotted, ["repo", "window"]).where(hit).select("repo", "task_id", "rule_id", "pos").distinct()


def _rule_tokens(rules: DataFrame) -> DataFrame:
    return rules.select(
        "repo", "rule_id", "pos", is_imperative(F.col("content")).alias("imperative"),
        F.explode(F.array_distinct(tokenize(F.col("content")))).alias("token"),
    )


def _raw(overlap: Column, imperative: Column, n: Column, opened: Column) -> Column:
    share = F.when(n > 0, overlap / n).otherwise(0.0)
    return half_up(clamp01(share + F.when(imperative & (overlap > 0), 0.5).otherwise(0.0) + F.when(opened, 0.2).otherwise(0.0)), 3)


def _weighted_terms(tasks: DataFrame) -> DataFrame:
    return _task_terms(tasks).withColumn("weight", F.when(F.col("kind") == 0, 1.0).otherwise(0.5))


def _reasons(df: DataFrame) -> DataFrame:
    """Reasons from the words ``why`` of a pair and its flags."""

    def labels(kind: int, prefix: str) -> Column:
        found = F.transform(F.filter("why", lambda w: w["kind"] == kind), lambda w: w["label"])
        return F.when(F.size(found) > 0, F.concat(F.lit(prefix), F.array_join(found, "/")))

    reasons = F.array_compact(F.array(
        labels(0, "task:"), labels(1, "semantic:"), F.when(F.col("_urgent"), "imperative"), F.when(F.col("_opened"), "open-file"),
    ))
    return df.withColumn("reasons", reasons).drop("why", "_urgent", "_opened")


def score_rules(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Lexical score of every rule that shares something with a task.

    ``tasks(repo, task_id, prompt, open_files)``, ``rules(repo, rule_id, content, pos)``.
    Exact overlap counts 1 and alias overlap 0.5 over the number of distinct task
    tokens; an imperative rule with any overlap gets 0.5 more and a rule naming an
    open file 0.2 more. Pairs without any signal score 0 and are not emitted;
    ``zero_counts`` counts them. Tasks without tokens are served by ``idle_rules``.
    """
    word = F.struct("kind", "at", "label")
    parts = _weighted_terms(tasks).join(_rule_tokens(rules), ["repo", "token"]).select(
        "repo", "task_id", "rule_id", "pos", "n_tokens", "imperative", F.lit(False).alias("opened"), "weight", word.alias("word"),
    )
    if "open_files" in tasks.columns:
        files = _open_file_hits(tasks, rules).select(
            "repo", "task_id", "rule_id", "pos", F.lit(None).cast("int").alias("n_tokens"), F.lit(False).alias("imperative"),
            F.lit(True).alias("opened"), F.lit(0.0).alias("weight"), F.lit(None).cast(parts.schema["word"].dataType).alias("word"),
        )
        parts = parts.unionByName(files)
    # all pairs are asked for, so their words are gathered in the same pass; a task bounds the words of its pair
    grouped = parts.groupBy("repo", "task_id", "rule_id", "pos").agg(
        F.sum("weight").alias("overlap"), F.max("n_tokens").alias("n"), F.max("imperative").alias("imperative"), F.max("opened").alias("opened"),
        F.sort_array(F.collect_list("word")).alias("why"),
    )
    overlap, imperative, opened = F.col("overlap"), F.col("imperative"), F.col("opened")
    scored = grouped.select(
        "repo", "task_id", "rule_id", "pos", _raw(overlap, imperative, F.col("n"), opened).alias("score"), (imperative & (overlap > 0)).alias("_urgent"), opened.alias("_opened"), "why",
    )
    return _reasons(scored)


def _best(tasks: DataFrame, rules: DataFrame, k: int, often: int) -> DataFrame:
    """The ``k`` best rules of every task among those that share something with it."""
    terms = _weighted_terms(tasks).select(F.col("repo").alias("group"), "task_id", F.col("n_tokens").alias("n"), "token", "weight")
    index = _rule_tokens(rules).select(
        F.col("repo").alias("group"), F.col("rule_id").alias("item"), F.struct("pos", "rule_id").alias("order"), F.col("imperative").alias("bonus"), "token", F.lit(1).alias("points"),
    )
    hits = None
    if "open_files" in tasks.columns:
        hits = _open_file_hits(tasks, rules)
    named = None if hits is None else hits.select(F.col("repo").alias("group"), "task_id", F.col("rule_id").alias("item"))
    closed = lambda overlap, bonus, n: _raw(overlap, bonus, n, F.lit(False))
    pairs = rank_safe(terms, index, k, closed, named, often)
    pairs = pairs.select(F.col("group").alias("repo"), "task_id", F.col("item").alias("rule_id"), "order.pos", F.col("bonus").alias("imperative"), "n", "overlap")
    if hits is not None:
        # an open file counts for tasks without tokens too, and for rules that share no token
        marked = hits.select("repo", "task_id", "rule_id", "pos", F.lit(True).alias("opened"))
        pairs = pairs.join(marked, ["repo", "task_id", "rule_id", "pos"], "full_outer")
    else:
        pairs = pairs.withColumn("opened", F.lit(False))
    overlap = F.coalesce("overlap", F.lit(0.0))
    imperative, opened = F.coalesce("imperative", F.lit(False)), F.coalesce("opened", F.lit(False))
    scored = pairs.select(
        "repo", "task_id", "rule_id", "pos", _raw(overlap, imperative, F.coalesce("n", F.lit(0)), opened).alias("score"), (imperative & (overlap > 0)).alias("_urgent"), opened.alias("_opened"),
    )
    return top_n(scored, ["repo", "task_id"], [F.desc("score"), F.col("pos"), F.col("rule_id")], k)


def _explained(pairs: DataFrame, tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``reasons`` to scored pairs; words are looked up for these pairs only, inside the row."""
    words = _task_terms(tasks).groupBy("repo", "task_id").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "label", "token"))).alias("_words"))
    content = rules.select("repo", "rule_id", F.array_distinct(tokenize(F.col("content"))).alias("_have"))
    both = pairs.join(content, ["repo", "rule_id"], "left").join(words, ["repo", "task_id"], "left")
    shared = F.filter(F.coalesce("_words", F.array()), lambda w: F.array_contains("_have", w["token"]))
    return _reasons(both.withColumn("why", shared)).drop("_words", "_have")


def zero_counts(tasks: DataFrame, rules: DataFrame, scored: DataFrame) -> DataFrame:
    """How many rules of its repository scored 0 for each task."""
    total = rules.groupBy("repo").agg(F.count("*").alias("n_rules"))
    hit = scored.groupBy("repo", "task_id").agg(F.count("*").alias("n_scored"))
    return (
        tasks.select("repo", "task_id").join(total, "repo").join(hit, ["repo", "task_id"], "left")
        .select("repo", "task_id", (F.col("n_rules") - F.coalesce("n_scored", F.lit(0))).alias("n_zero"))
    )


def idle_rules(rules: DataFrame) -> DataFrame:
    """The shared ranking of every task without tokens: imperative rules score 0.5."""
    return rules.where(is_imperative(F.col("content"))).select(
        "repo", "rule_id", "pos", F.lit(0.5).alias("score"), F.array(F.lit("imperative")).alias("reasons")
    )


def band(col: Column) -> Column:
    return F.when(col >= C.BAND_HIGH, "high").when(col >= C.BAND_MID, "mid").otherwise("dropped")


def top_rules(tasks: DataFrame, rules: DataFrame, k: int, often: int = OFTEN) -> DataFrame:
    """Best ``k`` rules per task, zero scores included, ties by ``pos``; adds ``band``.

    Tokens of more than ``often`` rules don't make a row for each pair that shares them (``rank_safe``).

    When fewer than ``k`` rules scored, the first rules in document order fill the
    list; the first ``2k`` rules of a repository are enough candidates for that.
    """
    best = _explained(_best(tasks, rules, k, often), tasks, rules)
    got = best.groupBy("repo", "task_id").agg(F.count("*").alias("_got"), F.collect_list("rule_id").alias("_have"))
    head = top_n(rules.select("repo", "rule_id", "pos"), ["repo"], [F.col("pos"), F.col("rule_id")], 2 * k)
    head = head.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("pos", "rule_id"))).alias("_head"))
    empty = tasks.where(F.size(tokenize(F.col("prompt"))) == 0).select("repo", "task_id")
    idle = top_n(idle_rules(rules), ["repo"], [F.col("pos"), F.col("rule_id")], k).drop("rank")
    quiet = empty.join(idle, "repo").select("repo", "task_id", "rule_id", "pos", "score", "reasons")
    best = best.drop("rank").join(empty, ["repo", "task_id"], "left_anti").unionByName(quiet)
    short = (
        tasks.select("repo", "task_id").join(got, ["repo", "task_id"], "left")
        .where(F.coalesce("_got", F.lit(0)) < k).join(head, "repo")
    )
    have = F.coalesce("_have", F.array().cast("array<string>"))
    fill = short.select("repo", "task_id", F.explode(F.filter("_head", lambda h: ~F.array_contains(have, h["rule_id"].cast("string")))).alias("_h"))
    fill = fill.select(
        "repo", "task_id", F.col("_h.rule_id").alias("rule_id"), F.col("_h.pos").alias("pos"),
        F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("reasons"),
    )
    fill = fill.join(quiet.select("repo", "task_id", "rule_id"), ["repo", "task_id", "rule_id"], "left_anti")
    full = top_n(best.unionByName(fill), ["repo", "task_id"], [F.desc("score"), F.col("pos"), F.col("rule_id")], k)
    return full.withColumn("band", band(F.col("score")))


def rescore(scored: DataFrame, similarities: DataFrame) -> DataFrame:
    """Raise rule scores by vector similarity.

    ``similarities(task_id, rule_id, similarity)`` holds cosines. A semantic score of
    0.5 or more replaces a lower lexical one; from 0.45 on it is given as a reason.
    """
    semantic = vectors.to_score(F.col("similarity"))
    joined = scored.join(similarities, ["task_id", "rule_id"], "left").withColumn("_s", semantic)
    score = F.when(F.col("_s") >= 0.5, F.greatest("score", "_s")).otherwise(F.col("score"))
    why = F.when(
        F.col("_s") >= 0.45,
        F.array_distinct(F.concat("reasons", F.array(F.concat(F.lit("embedding:"), F.format_number("_s", 2))))),
    ).otherwise(F.col("reasons"))
    return joined.select(
        *[c for c in scored.columns if c not in ("score", "reasons")], half_up(clamp01(score), 3).alias("score"),
        half_up(F.col("_s"), 3).alias("embedding_score"), why.alias("reasons"),
    )


def rule_priority(content: Column) -> Column:
    lower = F.lower(clean(content))
    return F.when(matches(lower, C.PRIORITY_WORDS), 10).otherwise(0) + F.when(matches(lower, C.PRIORITY_TOOLS), 4).otherwise(0)


def order_rules(scored: DataFrame, limit: int, keys: list[str] = ("task_id",)) -> DataFrame:
    """First ``limit`` rules of each task by priority, score and position."""
    order = [F.desc(rule_priority(F.col("content"))), F.desc("score"), F.col("pos")]
    return top_n(scored, list(keys), order, limit)


# --- query expansion ----------------------------------------------------------


def related_terms(prompt: Column) -> Column:
    """Vocabulary terms of every concept group a task touches and does not name."""
    tokens = F.array_distinct(tokenize(prompt))
    def forms(t: Column) -> Column:
        plural = t.endswith("s") & (F.length(t) > 3)
        return F.when(plural, F.array(t, t.substr(F.lit(1), F.length(t) - 1))).otherwise(F.array(t))

    keys = F.array_distinct(F.flatten(F.transform(tokens, forms)))
    # A key adds its groups in key order, as the concept table lists them.
    groups: dict[str, list[str]] = {}
    for group in C.DOMAIN_VOCABULARY:
        for term in group:
            groups[term] = groups.get(term, []) + group
    table = literal_map(groups)
    known = F.filter(keys, lambda k: k.isin(list(groups)))
    added = F.flatten(F.transform(known, lambda k: F.try_element_at(table, k)))
    return F.array_except(F.array_distinct(added), keys)


def expand_task(tasks: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Append the related terms of a task to its text as ``expanded``."""
    out = tasks.withColumn("related", related_terms(F.col(prompt)))
    text = F.concat(F.col(prompt), F.lit("\n\nRelated backend terms: "), F.array_join("related", ", "))
    return out.withColumn("expanded", F.when(F.size("related") > 0, text).otherwise(F.col(prompt)))


def graph_queries(tasks: DataFrame, seeds: DataFrame, scored: DataFrame, limit: int = 10) -> DataFrame:
    """Search phrases of a task: its text, then seed names, else terms of its best rules.

    ``seeds(task_id, path, rank)``, ``scored(task_id, content, score, pos)``. Distinct
    ignoring case, at least 3 characters, first ``limit``.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    from_seeds = seeds.where(F.col("rank") <= 5).select(
        "task_id", F.lit(1).alias("src"), F.col("rank").cast("int").alias("a"), F.lit(0).alias("b"), stem.alias("query")
    )
    best = top_n(scored.where(F.col("score") >= C.BAND_MID), ["task_id"], [F.desc("score"), F.col("pos")], 4)
    best = best.join(seeds.select("task_id").distinct(), "task_id", "left_anti")
    terms = F.concat(identifiers(F.col("content")), phrases(F.col("content")))
    from_rules = best.select("task_id", F.lit(2).alias("src"), F.col("rank").alias("a"), F.posexplode(terms).alias("b", "query"))
    whole = tasks.select("task_id", F.lit(0).alias("src"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("prompt").alias("query"))
    every = whole.unionByName(from_seeds).unionByName(from_rules.select("task_id", "src", "a", "b", "query"))
    every = every.withColumn("query", strip(F.col("query"))).where(F.length("query") >= 3)
    order = F.struct("src", "a", "b")
    distinct = every.groupBy("task_id", F.lower("query").alias("_k")).agg(
        F.min_by("query", order).alias("query"), F.min(order).alias("_o")
    )
    return top_n(distinct, ["task_id"], [F.col("_o")], limit, rank="place").select("task_id", "place", "query")


# --- evaluation scorers -------------------------------------------------------


def _prompt_tokens(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode(F.array_distinct(tokenize(F.col("prompt"), "eval"))).alias("token"))


def _trigger_points(catalog: DataFrame) -> DataFrame:
    """Points of each trigger token: 2 for each occurrence of one longer than 5, else 1."""
    text = F.concat_ws(" ", "id", "description", F.array_join("positive_prompts", " "))
    counted = catalog.select("id", F.explode(tokenize(text, "eval")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    return counted.select("id", "token", (F.col("n") * F.when(F.length("token") > 5, 2).otherwise(1)).alias("points"))


def baseline_score(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Raw trigger overlap: 2 per trigger token longer than 5, else 1; repeats count.

    Only pairs with a positive score are emitted: all of them; ``top_baseline`` gives the best ones.
    """
    return _prompt_tokens(cases).join(_trigger_points(catalog), "token").groupBy("case_id", "id").agg(F.sum("points").alias("score"))


def _top_pairs(cases: DataFrame, index: DataFrame, k: int, score, often: int) -> DataFrame:
    terms = _prompt_tokens(cases).select(F.lit(0).alias("group"), F.col("case_id").alias("task_id"), F.lit(0).alias("n"), "token", F.lit(1).alias("weight"))
    items = index.select(F.lit(0).alias("group"), F.col("id").alias("item"), F.col("id").alias("order"), F.lit(False).alias("bonus"), "token", "points")
    pairs = rank_safe(terms, items, k, score, often=often).select(F.col("task_id").alias("case_id"), F.col("item").alias("id"), "overlap")
    return top_n(pairs.withColumn("_s", score(F.col("overlap"), F.lit(False), F.lit(0))), ["case_id"], [F.desc("_s"), F.col("id")], k)


def top_baseline(cases: DataFrame, catalog: DataFrame, k: int, often: int = OFTEN) -> DataFrame:
    """The ``k`` best of ``baseline_score`` for each case, ties by id: (case_id, rank, id, score)."""
    best = _top_pairs(cases, _trigger_points(catalog), k, lambda overlap, bonus, n: overlap, often)
    return best.select("case_id", "rank", "id", F.col("overlap").cast("bigint").alias("score"))


def _proxy(overlap: Column) -> Column:
    return half_up(F.greatest(F.lit(0.45), F.least(F.lit(0.92), 0.5 + overlap * 0.1)), 6)


def _proxy_tokens(catalog: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "id", "description")
    return catalog.select("id", F.explode(F.array_distinct(tokenize(text, "eval"))).alias("token"))


def proxy_semantic(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stand-in similarity from token overlap, for all pairs with any overlap (others: 0.5)."""
    overlap = _prompt_tokens(cases).join(_proxy_tokens(catalog), "token").groupBy("case_id", "id").agg(F.count("*").alias("overlap"))
    return overlap.select("case_id", "id", _proxy(F.col("overlap")).alias("semantic"))


def top_proxy(cases: DataFrame, catalog: DataFrame, k: int, often: int = OFTEN) -> DataFrame:
    """The ``k`` best of ``proxy_semantic`` for each case, ties by id: (case_id, rank, id, semantic)."""
    best = _top_pairs(cases, _proxy_tokens(catalog).withColumn("points", F.lit(1)), k, lambda overlap, bonus, n: _proxy(overlap), often)
    return best.select("case_id", "rank", "id", F.col("_s").alias("semantic"))
