"""Rule scores, vectors, expansion, selection and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import relevance, retrieval, select
from . import bindings as B, sql as Q
from .registry import Tables, plain, query

_SCORE_SQL = f"""
WITH tasks AS ({plain(B.OPEN_TASKS).replace("array('src/user.service.ts', 'lib/x.ts')", "['src/user.service.ts', 'lib/x.ts']").replace("array()", "[]")}),
rules AS ({plain(B.RULES)}),
tt AS (SELECT task_id, array_to_string(open_files, ' ') AS opened, {Q.rule_tokens("array_to_string(open_files, ' ')")} AS opened_toks, list_distinct({Q.rule_tokens('prompt')}) AS toks FROM tasks),
rt AS (SELECT rule_id, pos, content, list_distinct({Q.rule_tokens('content')}) AS rtoks, {Q.contains_any('lower(content)', C.IMPORTANT_WORDS)} AS imp FROM rules),
pairs AS (SELECT task_id, rule_id, pos, len(toks) AS n, imp, len(list_intersect(toks, rtoks)) AS exact,
   (SELECT count(*) FROM {Q.alias_table()} WHERE list_contains(toks, token) AND NOT list_contains(toks, alias) AND list_contains(rtoks, alias)) AS sem,
   len(list_filter(rtoks, lambda r: contains(r, '.') AND (list_contains(opened_toks, r) OR contains(opened, r)))) > 0 AS opened_hit
   FROM tt, rt),
scored AS (SELECT *, round(least(1, greatest(0, CASE WHEN n > 0 THEN (exact + sem * 0.5) / n ELSE 0 END + CASE WHEN imp AND (exact > 0 OR sem > 0 OR n = 0) THEN 0.5 ELSE 0 END + CASE WHEN opened_hit THEN 0.2 ELSE 0 END)), 3) AS score FROM pairs)
"""


@query("rule_scores", "J1", _SCORE_SQL + """
SELECT task_id, rule_id, score, (CASE WHEN exact > 0 THEN 't' ELSE '' END || CASE WHEN sem > 0 THEN 's' ELSE '' END || CASE WHEN imp AND (exact > 0 OR sem > 0) THEN 'i' ELSE '' END || CASE WHEN opened_hit THEN 'o' ELSE '' END) AS why
FROM scored WHERE exact > 0 OR sem > 0 OR opened_hit
""")
def rule_scores(t: Tables):
    scored = relevance.score_rules(t.derive(B.OPEN_TASKS), t.derive(B.RULES))
    why = F.array_join(F.transform("reasons", lambda r: F.substring(r, 1, 1)), "")
    return scored.select("task_id", "rule_id", "score", why.alias("why"))


@query("top_rules_per_task", "T1 J1 K1 P2", _SCORE_SQL + """
SELECT task_id, rule_id, score, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.1 THEN 'mid' ELSE 'dropped' END AS band, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, pos, rule_id) AS rank FROM scored) WHERE rank <= 3
""")
def top_rules_per_task(t: Tables):
    return relevance.top_rules(t.derive(B.OPEN_TASKS), t.derive(B.RULES), 3).select("task_id", "rule_id", "score", "band", "rank")


@query("rules_without_score", "J1", _SCORE_SQL + """
SELECT task_id, count(*) FILTER (WHERE NOT (exact > 0 OR sem > 0 OR opened_hit)) AS n_zero FROM scored GROUP BY task_id
""")
def rules_without_score(t: Tables):
    tasks, rules = t.derive(B.OPEN_TASKS), t.derive(B.RULES)
    return relevance.zero_counts(tasks, rules, relevance.score_rules(tasks, rules)).select("task_id", "n_zero")


_SCORED_RULES = """
SELECT conv_id * 100 + turn AS task_id, 'r' || CAST(turn AS VARCHAR(20)) AS rule_id, turn AS pos, round(CAST((conv_id * 37 + turn * 11) % 100 AS DOUBLE) / 100, 3) AS score,
       text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' You must wait.' WHEN 1 THEN ' Call query_graph first.' ELSE '' END AS content, conv_id FROM {conversations}
"""


@query("rescored_rules", "J3", f"""
WITH r AS ({plain(_SCORED_RULES)}), s AS (SELECT *, least(1, greatest(0, (((conv_id * 13 + pos * 29) % 201 - 100) / 100.0 + 1) / 2)) AS sem FROM r)
SELECT task_id, rule_id, round(CASE WHEN sem >= 0.5 THEN greatest(score, sem) ELSE score END, 3) AS score, round(sem, 3) AS embedding_score, CASE WHEN sem >= 0.45 THEN 1 ELSE 0 END AS reasons FROM s
""")
def rescored_rules(t: Tables):
    scored = t.derive(_SCORED_RULES).withColumn("reasons", F.array().cast("array<string>"))
    sims = scored.select("task_id", "rule_id", (((F.col("conv_id") * 13 + F.col("pos") * 29) % 201 - 100) / 100.0).alias("similarity"))
    out = relevance.rescore(scored, sims)
    return out.select("task_id", "rule_id", "score", "embedding_score", F.size("reasons").alias("reasons"))


@query("ordered_rules", "K5", f"""
WITH r AS ({plain(_SCORED_RULES)}), k AS (SELECT *, CASE WHEN regexp_matches(lower(content), {Q.quote(C.PRIORITY_WORDS)}) THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(content), {Q.quote(C.PRIORITY_TOOLS)}) THEN 4 ELSE 0 END AS prio FROM r)
SELECT conv_id, task_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY prio DESC, score DESC, pos) AS rank FROM k) WHERE rank <= 5
""")
def ordered_rules(t: Tables):
    return relevance.order_rules(t.derive(_SCORED_RULES), 5, ["conv_id"]).select("conv_id", "task_id", "rank")


_VOCAB = " UNION ALL ".join(f"SELECT {g} AS g, {i} AS i, '{term}' AS term" for g, terms in enumerate(C.DOMAIN_VOCABULARY) for i, term in enumerate(terms))


@query("expanded_tasks", "F14", f"""
WITH tasks AS ({plain(B.TASKS)}), vocab AS ({_VOCAB}),
tt AS (SELECT task_id, list_distinct({Q.rule_tokens('prompt')}) AS toks FROM tasks),
keys AS (SELECT task_id, unnest(list_concat(toks, list_transform(list_filter(toks, lambda x: x LIKE '%s' AND length(x) > 3), lambda x: x[:-2]))) AS k FROM tt),
dk AS (SELECT DISTINCT task_id, k FROM keys),
added AS (SELECT DISTINCT d.task_id, v2.term FROM dk d JOIN vocab v ON v.term = d.k JOIN vocab v2 ON v2.g = v.g
          WHERE NOT EXISTS (SELECT 1 FROM dk x WHERE x.task_id = d.task_id AND x.k = v2.term))
SELECT t.task_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS related FROM tasks t LEFT JOIN added USING (task_id) GROUP BY t.task_id
""")
def expanded_tasks(t: Tables):
    out = relevance.expand_task(t.derive(B.TASKS))
    return out.select("task_id", F.array_join(F.array_sort("related"), ",").alias("related"))


@query("graph_queries", "F15", f"""
WITH r AS ({plain(_SCORED_RULES)}), tasks AS (SELECT DISTINCT conv_id AS task_id, 'find conv ' || conv_id AS prompt FROM r),
seeds AS (SELECT conv_id AS task_id, 'lib/Seed' || turn || '.spec.ts' AS path, turn - 2 AS rank FROM conversations WHERE turn >= 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, pos) AS rk FROM r WHERE score >= 0.1 AND conv_id NOT IN (SELECT task_id FROM seeds)) WHERE rk <= 4),
terms AS (SELECT conv_id AS task_id, rk, unnest(l) AS q, generate_subscripts(l, 1) AS b FROM (SELECT conv_id, rk, list_concat(regexp_extract_all(content, '`([^`]+)`', 1),
  list_concat(regexp_extract_all(content, '\\b[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+\\b', 0), list_concat(regexp_extract_all(content, '(?i)\\b[a-z0-9]+(?:[-_.][a-z0-9]+)+\\b', 0),
  list_transform(range(1, len({Q.graph_terms('content')})), lambda i: {Q.graph_terms('content')}[i] || ' ' || {Q.graph_terms('content')}[i + 1])))) AS l FROM best)),
every AS (SELECT task_id, 0 AS src, 0 AS a, 0 AS b, prompt AS q FROM tasks UNION ALL SELECT task_id, 1, rank, 0, regexp_replace(split_part(path, '/', 2), '\\.[^.]+$', '') FROM seeds WHERE rank <= 5
          UNION ALL SELECT task_id, 2, rk, b, q FROM terms),
firsts AS (SELECT *, row_number() OVER (PARTITION BY task_id, lower(trim(q)) ORDER BY src, a, b) AS k FROM every WHERE length(trim(q)) >= 3)
SELECT task_id, CAST(place AS INTEGER) AS place, trim(q) AS query FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY src, a, b) AS place FROM firsts WHERE k = 1) WHERE place <= 10
""")
def graph_queries(t: Tables):
    rules = t.derive(_SCORED_RULES).drop("task_id").withColumnRenamed("conv_id", "task_id")
    tasks = rules.select("task_id").distinct().select("task_id", F.concat(F.lit("find conv "), F.col("task_id").cast("string")).alias("prompt"))
    # long conversations have seeds, short ones fall back on their rules
    seeds = t.conversations.where("turn >= 3").select(
        F.col("conv_id").alias("task_id"), F.concat(F.lit("lib/Seed"), F.col("turn").cast("string"), F.lit(".spec.ts")).alias("path"), (F.col("turn") - 2).alias("rank")
    )
    return relevance.graph_queries(tasks, seeds, rules)


_EVAL_CATALOG = "SELECT 'b' || CAST(item_id AS VARCHAR(20)) AS id, text AS description, split_part(text, ' ', 1) AS trig FROM {benchmark}"


@query("baseline_scores", "F16", f"""
WITH c AS ({plain(_EVAL_CATALOG)}), cases AS (SELECT conv_id * 100 + turn AS case_id, list_distinct({Q.eval_tokens('text')}) AS toks FROM conversations WHERE role = 'user'),
tg AS (SELECT id, unnest({Q.eval_tokens("id || ' ' || description || ' ' || trig")}) AS tok FROM c)
SELECT case_id, id, CAST(sum(CASE WHEN length(tok) > 5 THEN 2 ELSE 1 END) AS BIGINT) AS score FROM (SELECT case_id, unnest(toks) AS tok FROM cases) JOIN tg USING (tok) GROUP BY ALL
""")
def baseline_scores(t: Tables):
    catalog = t.derive(_EVAL_CATALOG).withColumn("positive_prompts", F.array("trig"))
    return relevance.baseline_score(_eval_cases(t), catalog)


def _eval_cases(t: Tables):
    return t.conversations.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), F.col("text").alias("prompt"))


@query("top_baseline_scores", "F16", f"""
WITH c AS ({plain(_EVAL_CATALOG)}), cases AS (SELECT conv_id * 100 + turn AS case_id, list_distinct({Q.eval_tokens('text')}) AS toks FROM conversations WHERE role = 'user'),
tg AS (SELECT id, unnest({Q.eval_tokens("id || ' ' || description || ' ' || trig")}) AS tok FROM c),
s AS (SELECT case_id, id, CAST(sum(CASE WHEN length(tok) > 5 THEN 2 ELSE 1 END) AS BIGINT) AS score FROM (SELECT case_id, unnest(toks) AS tok FROM cases) JOIN tg USING (tok) GROUP BY ALL)
SELECT case_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3
""")
def top_baseline_scores(t: Tables):
    return relevance.top_baseline(_eval_cases(t), t.derive(_EVAL_CATALOG).withColumn("positive_prompts", F.array("trig")), 3, often=8)


@query("proxy_similarities", "F17", f"""
WITH c AS ({plain(_EVAL_CATALOG)}), cases AS (SELECT conv_id * 100 + turn AS case_id, unnest(list_distinct({Q.eval_tokens('text')})) AS tok FROM conversations WHERE role = 'user'),
tg AS (SELECT id, unnest(list_distinct({Q.eval_tokens("id || ' ' || description")})) AS tok FROM c)
SELECT case_id, id, round(greatest(0.45, least(0.92, CAST(0.5 + count(*) * 0.1 AS DOUBLE))), 6) AS semantic FROM cases JOIN tg USING (tok) GROUP BY ALL
""")
def proxy_similarities(t: Tables):
    return relevance.proxy_semantic(_eval_cases(t), t.derive(_EVAL_CATALOG))


@query("top_proxy_similarities", "F17", f"""
WITH c AS ({plain(_EVAL_CATALOG)}), cases AS (SELECT conv_id * 100 + turn AS case_id, unnest(list_distinct({Q.eval_tokens('text')})) AS tok FROM conversations WHERE role = 'user'),
tg AS (SELECT id, unnest(list_distinct({Q.eval_tokens("id || ' ' || description")})) AS tok FROM c),
s AS (SELECT case_id, id, round(greatest(0.45, least(0.92, CAST(0.5 + count(*) * 0.1 AS DOUBLE))), 6) AS semantic FROM cases JOIN tg USING (tok) GROUP BY ALL)
SELECT case_id, CAST(rank AS INTEGER) AS rank, id, semantic FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY semantic DESC, id) AS rank FROM s) WHERE rank <= 3
""")
def top_proxy_similarities(t: Tables):
    return relevance.top_proxy(_eval_cases(t), t.derive(_EVAL_CATALOG), 3, often=8)


@query("vector_top_k", "J2 K1", """
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings),
s AS (SELECT query_id, vec_id AS id, round(greatest(0, least(1, (list_cosine_similarity(list_transform(v, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)) + 1) / 2)), 3) AS score FROM q, embeddings)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5
""")
def vector_top_k(t: Tables):
    index = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.similarity_top_k(queries, index, 5)


@query("vector_file_candidates", "F11", """
WITH s AS (SELECT q.vec_id AS task_id, e.vec_id AS path, round(greatest(0, least(1, (list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) + 1) / 2)), 3) AS sc FROM embeddings q, embeddings e)
SELECT task_id, path, round(sc * 10) AS score, 'embedding' AS source FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sc DESC, path) AS rank FROM s WHERE sc >= 0.45) WHERE rank <= 10
""")
def vector_file_candidates(t: Tables):
    index = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_candidates(queries, index).select("task_id", "path", "score", "source")


# --- selection ----------------------------------------------------------------


@query("elbow_selection", "K2", f"""
WITH s AS ({plain(B.SCORED_PARTS)}), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, name) AS rank FROM s WHERE score >= 0.55),
g AS (SELECT *, lag(score) OVER (PARTITION BY task_id ORDER BY rank) - score AS drop FROM r WHERE rank <= 8),
c AS (SELECT *, min(CASE WHEN drop >= 0.0125 AND rank > 1 THEN rank END) OVER (PARTITION BY task_id) AS cut FROM g)
SELECT task_id, name, score, CAST(rank AS INTEGER) AS rank FROM c WHERE cut IS NULL OR rank < cut
""")
def elbow_selection(t: Tables):
    out = select.elbow(t.derive(B.SCORED_PARTS), ["task_id"], "score", ["name"], 1, 8, 0.0125, 0.55)
    return out.select("task_id", "name", "score", "rank")


@query("diversified_selection", "K3", f"""
WITH s AS ({plain(B.SCORED_PARTS)}), r AS (SELECT *, row_number() OVER (PARTITION BY task_id, bucket ORDER BY score DESC, name) AS round, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, name) AS place FROM s),
b AS (SELECT *, min(place) OVER (PARTITION BY task_id, bucket) AS lead FROM r)
SELECT task_id, name, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round, lead) AS rank FROM b) WHERE rank <= 8
""")
def diversified_selection(t: Tables):
    out = select.diversify(t.derive(B.SCORED_PARTS), ["task_id"], "bucket", [F.desc("score"), F.col("name")], 8)
    return out.select("task_id", "name", "rank")


@query("normalised_scores", "K4", """
SELECT c_custkey, CASE WHEN s IS NULL THEN 0.75 WHEN s > 1 THEN least(1, s / 10) ELSE greatest(0, s) END AS score FROM (
  SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 0.4 END, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey / 4.0 END) AS s FROM customer)
""")
def normalised_scores(t: Tables):
    df = t.customer.select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, 0.4).alias("confidence"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("rank_score"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") / 4.0).alias("score"),
    )
    return df.select("c_custkey", select.normalised_score(df).alias("score"))


_LIMIT = "CASE conv_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN '2' ELSE 'x' END"


@query("selected_files", "K3 K4 K12 P9 P10", f"""
WITH c AS ({plain(B.CANDIDATES)}), f AS (SELECT task_id, path || CASE pos % 3 WHEN 0 THEN '.spec.ts' WHEN 1 THEN '/services/x' ELSE '' END AS path, score, pos FROM c),
tasks AS (SELECT conv_id AS task_id, any_value({_LIMIT}) AS lim, string_agg(CASE WHEN turn = 0 THEN CASE conv_id % 3 WHEN 0 THEN 'fix a bug' WHEN 1 THEN 'refactor it' ELSE text END END, '') AS prompt FROM conversations GROUP BY conv_id),
k AS (SELECT *, len(regexp_extract_all(lower(prompt), {Q.quote(C.COMPLEXITY_ACTIONS)})) AS acts FROM tasks),
l AS (SELECT task_id, CASE WHEN lim = '2' THEN 2 END AS manual, CASE WHEN regexp_matches(lower(prompt), {Q.quote(C.COMPLEXITY_PATTERNS[0][1])}) THEN 15 WHEN acts >= 5 OR regexp_matches(lower(prompt), {Q.quote(C.COMPLEXITY_PATTERNS[1][1])}) THEN 12
   WHEN regexp_matches(lower(prompt), {Q.quote(C.COMPLEXITY_PATTERNS[2][1])}) THEN 8 WHEN regexp_matches(lower(prompt), {Q.quote(C.COMPLEXITY_PATTERNS[3][1])}) THEN 3 ELSE 8 END AS auto FROM k),
s AS (SELECT f.*, auto, CASE WHEN score > 1 THEN least(1, score / 10) ELSE greatest(0, score) END AS ns, {Q.case_first('lower(path)', C.FILE_BUCKETS, 'other')} AS bucket FROM f JOIN l USING (task_id) WHERE manual IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, bucket ORDER BY ns DESC, path) AS round, row_number() OVER (PARTITION BY task_id ORDER BY ns DESC, path) AS place FROM s WHERE ns >= 0.2 OR score > 0),
b AS (SELECT *, min(place) OVER (PARTITION BY task_id, bucket) AS lead FROM r),
a AS (SELECT task_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round, lead, place) AS rank FROM b) WHERE rank <= auto),
m AS (SELECT task_id, path, rank FROM (SELECT f.*, manual, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS rank FROM f JOIN l USING (task_id) WHERE manual IS NOT NULL) WHERE rank <= manual)
SELECT task_id, path, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM m)
""")
def selected_files(t: Tables):
    files = t.derive(B.CANDIDATES).select(
        "task_id", F.concat("path", F.expr("CASE pos % 3 WHEN 0 THEN '.spec.ts' WHEN 1 THEN '/services/x' ELSE '' END")).alias("path"), "score", "pos"
    )
    prompt = F.expr("CASE conv_id % 3 WHEN 0 THEN 'fix a bug' WHEN 1 THEN 'refactor it' ELSE text END")
    tasks = t.conversations.groupBy(F.col("conv_id").alias("task_id")).agg(
        F.max(F.expr(_LIMIT)).alias("file_limit"), F.max(F.when(F.col("turn") == 0, prompt)).alias("prompt")
    )
    return select.select_files(tasks, files).select("task_id", "path", "rank")


@query("assembled_context", "K6", """
WITH f AS (SELECT conv_id AS task_id, turn, 'd' || turn % 3 || '/f' || (turn * 7) % 4 || '.ts' AS path FROM conversations),
n AS (SELECT *, split_part(path, '/', 2) AS base, count(*) OVER (PARTITION BY task_id, split_part(path, '/', 2)) AS c FROM f),
fi AS (SELECT task_id, min(turn) AS o, CASE WHEN c > 1 THEN path ELSE base END AS item FROM n GROUP BY ALL),
ft AS (SELECT task_id, '## Files, ' || string_agg(item, ', ' ORDER BY o) AS t FROM fi GROUP BY task_id),
ri AS (SELECT conv_id AS task_id, min(turn) AS o, '- ' || text AS item FROM conversations GROUP BY ALL),
rt AS (SELECT task_id, '## Rules' || chr(10) || string_agg(item, chr(10) ORDER BY o) AS t FROM ri GROUP BY task_id),
w AS (SELECT rt.task_id, rt.t || chr(10) || chr(10) || ft.t AS t FROM rt JOIN ft USING (task_id))
SELECT task_id, CASE WHEN length(t) <= 900 THEN t ELSE rtrim(substr(t, 1, 820)) || chr(10) || chr(10) || '[truncated context to 900 chars]' END AS context FROM w
""")
def assembled_context(t: Tables):
    conv = t.conversations.withColumnRenamed("conv_id", "task_id")
    files = conv.select("task_id", "turn", F.expr("'d' || CAST(turn % 3 AS STRING) || '/f' || CAST((turn * 7) % 4 AS STRING) || '.ts'").alias("path"))
    named = select.display_names(files).select(
        "task_id", F.lit(2).alias("section"), F.lit("Files").alias("title"), F.lit("comma").alias("style"), F.col("turn").alias("ord"), "item"
    )
    rules = conv.select(
        "task_id", F.lit(1).alias("section"), F.lit("Rules").alias("title"), F.lit("lines").alias("style"), F.col("turn").alias("ord"),
        F.concat(F.lit("- "), "text").alias("item"),
    )
    return select.assemble(rules.unionByName(named), 900)


_DUP_CATALOG = """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Tool ' ELSE 'tool-' END || CAST(s_suppkey % 37 AS VARCHAR(20)) AS name, s_suppkey AS ord,
  CASE WHEN s_suppkey % 5 = 0 THEN 'project' ELSE 'global' END AS scope,
  CASE s_suppkey % 4 WHEN 0 THEN '/h/.codex/skills/a' WHEN 1 THEN '/h/.config/skillshare/skills/a' WHEN 2 THEN '/h/.agents/skills/a' ELSE '/x' END AS path FROM {supplier}
"""
_DUP_SQL = f"""
WITH c AS ({plain(_DUP_CATALOG)}), p AS (SELECT *, {Q.normalized('name')} AS k, CASE WHEN scope = 'project' THEN 100 ELSE 0 END + CASE WHEN contains(path, '.codex/skills/') THEN 30 WHEN contains(path, 'skillshare') THEN 20 WHEN contains(path, '.agents/skills/') THEN 10 ELSE 0 END AS prio FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio DESC, ord) AS rn FROM p)
"""


@query("deduplicated_catalog", "K7", _DUP_SQL + "SELECT name, ord, rn = 1 AS kept FROM r")
def deduplicated_catalog(t: Tables):
    kept, removed = select.dedupe_catalog(t.derive(_DUP_CATALOG))
    return kept.select("name", "ord", F.lit(True).alias("kept")).unionByName(removed.select("name", "ord", F.lit(False).alias("kept")))


@query("final_selection", "K13", f"""
WITH s AS (SELECT task_id, CASE WHEN p_size % 2 = 0 THEN 'P ' ELSE 'p-' END || pos % 11 AS name, score AS rank_score, round(1 - score, 3) AS score, p_size % 17 = 0 AS explicit, CASE WHEN pos % 3 = 0 THEN 'project' ELSE 'global' END AS scope, pos FROM ({plain(B.SCORED_PARTS)})),
f AS (SELECT *, row_number() OVER (PARTITION BY task_id, {Q.normalized('name')} ORDER BY rank_score DESC, score DESC, scope = 'project' DESC, name) AS k FROM s WHERE explicit OR rank_score >= 0.35)
SELECT task_id, name, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rank_score DESC, score DESC, scope = 'project' DESC, name) AS rank FROM f WHERE k = 1) WHERE rank <= 3
""")
def final_selection(t: Tables):
    df = t.derive(B.SCORED_PARTS).select(
        "task_id", F.expr("CASE WHEN p_size % 2 = 0 THEN 'P ' ELSE 'p-' END || CAST(pos % 11 AS STRING)").alias("name"), F.col("score").alias("rank_score"),
        F.round(1 - F.col("score"), 3).alias("score"), (F.col("p_size") % 17 == 0).alias("explicit"),
        F.when(F.col("pos") % 3 == 0, "project").otherwise("global").alias("scope"),
    )
    return select.finalise(df, 3).select("task_id", "name", "rank")


@query("preselected_candidates", "K14", f"""
SELECT task_id, name FROM ({plain(B.SCORED_PARTS)}) WHERE score > 0
""")
def preselected_candidates(t: Tables):
    return select.preselect(t.derive(B.SCORED_PARTS), "score").select("task_id", "name")


@query("vector_gate", "K14", """
SELECT p_brand AS repo, count(*) AS n, count(*) <= 80 OR bool_or(p_size = 50 AND p_partkey % 3 = 0) AS use_vectors FROM part GROUP BY p_brand
""")
def vector_gate(t: Tables):
    indexed = t.part.where("p_size = 50 AND p_partkey % 3 = 0").select(F.col("p_brand").alias("repo"))
    return select.vector_gate(t.part.select(F.col("p_brand").alias("repo")), indexed, most=80)


@query("recent_events", "K11", """
SELECT user_id, event_id, CAST(rank AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20
""")
def recent_events(t: Tables):
    return select.recent(t.events, ["user_id"], "ts", 20, ["event_id"]).select("user_id", "event_id", "recency")


@query("recent_files", "K11", """
WITH f AS (SELECT l_suppkey AS repo, 'p' || l_partkey AS file, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL)
SELECT repo, file, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ord, file) AS rank FROM f) WHERE rank <= 20
""")
def recent_files(t: Tables):
    commits = t.lineitem.select(
        F.col("l_suppkey").alias("repo"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    )
    return select.recent_files(commits).select("repo", "file", "rank")


@query("selected_cases", "K10", """
WITH c AS (SELECT o_orderkey AS case_id, o_orderpriority AS fixture, o_orderkey AS ord FROM orders),
g AS (SELECT * FROM (VALUES ('2-HIGH', 1), ('1-URGENT', 2), ('9-NONE', 3)) v(fixture, place)),
p AS (SELECT case_id, fixture, 0 AS phase, place, ord FROM (SELECT c.*, place, row_number() OVER (PARTITION BY fixture ORDER BY ord) AS k FROM c JOIN g USING (fixture)) WHERE k = 1),
a AS (SELECT case_id, fixture, 1 AS phase, ord AS place, ord FROM c WHERE case_id NOT IN (SELECT case_id FROM p))
SELECT case_id, fixture, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY phase, place, case_id) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM a)) WHERE rank <= 20
""")
def selected_cases(t: Tables):
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("fixture"), F.col("o_orderkey").alias("ord"))
    return select.select_cases(cases, ["2-HIGH", "1-URGENT", "9-NONE"], 20).select("case_id", "fixture", "rank")


@query("prompt_classes", "P9 P13", f"""
WITH t AS ({plain(B.TASKS)}), w AS (SELECT task_id, lower(prompt) AS p, {Q.words('prompt')} AS words, len(regexp_extract_all(lower(prompt), {Q.quote(C.COMPLEXITY_ACTIONS)})) AS acts FROM t UNION ALL
  SELECT -task_id, CASE turn % 3 WHEN 0 THEN 'Fix auth' WHEN 1 THEN 'add cache test error' ELSE 'add cache test now' END, {Q.words("CASE turn % 3 WHEN 0 THEN 'Fix auth' WHEN 1 THEN 'add cache test error' ELSE 'add cache test now' END")}, 0 FROM t)
SELECT task_id, CASE WHEN regexp_matches(lower(p), {Q.quote(C.COMPLEXITY_PATTERNS[0][1])}) THEN 'refactor' WHEN acts >= 5 OR regexp_matches(lower(p), {Q.quote(C.COMPLEXITY_PATTERNS[1][1])}) THEN 'large_feature'
  WHEN regexp_matches(lower(p), {Q.quote(C.COMPLEXITY_PATTERNS[2][1])}) THEN 'feature' WHEN regexp_matches(lower(p), {Q.quote(C.COMPLEXITY_PATTERNS[3][1])}) THEN 'small_fix' ELSE 'feature' END AS complexity,
  len(words) <= 2 OR (len(words) <= 4 AND len(list_filter(words, lambda x: x NOT IN {Q.in_list(C.AMBIGUOUS_WORDS)})) = 0) AS ambiguous FROM w
""")
def prompt_classes(t: Tables):
    tasks = t.derive(B.TASKS)
    short = F.expr("CASE turn % 3 WHEN 0 THEN 'Fix auth' WHEN 1 THEN 'add cache test error' ELSE 'add cache test now' END")
    every = tasks.select("task_id", "prompt").unionByName(tasks.select((-F.col("task_id")).alias("task_id"), short.alias("prompt")))
    return every.select("task_id", select.complexity(F.col("prompt")).alias("complexity"), select.is_ambiguous(F.col("prompt")).alias("ambiguous"))


@query("file_buckets", "P10", f"""
WITH f AS ({plain(B.FILES)}) SELECT {Q.case_first('lower(path)', C.FILE_BUCKETS, 'other')} AS bucket, count(*) AS n FROM f GROUP BY 1
""")
def file_buckets(t: Tables):
    return t.derive(B.FILES).groupBy(select.file_bucket(F.col("path")).alias("bucket")).agg(F.count("*").alias("n"))


@query("empty_context_reasons", "P12 P14", """
WITH e AS (SELECT event_id, event_id % 11 <> 0 AS injecting, event_id % 7 = 0 AS has,
  list_filter([CASE WHEN event_id % 2 = 0 THEN 'rules' END, CASE WHEN event_id % 3 = 0 THEN 'files' END], lambda x: x IS NOT NULL) AS av,
  list_filter([CASE WHEN user_id % 2 = 0 THEN 'rules' END, CASE WHEN user_id % 5 = 0 THEN 'skills' END], lambda x: x IS NOT NULL) AS en,
  CASE event_type WHEN 'click' THEN 'fallback' WHEN 'view' THEN '' END AS bridge, CASE WHEN user_id % 3 = 0 THEN 'disabled' ELSE 'ready' END AS model FROM events)
SELECT event_id, CASE WHEN NOT injecting THEN 'injection-disabled' WHEN has THEN NULL WHEN len(av) = 0 THEN 'no-context-candidates'
  WHEN len(list_filter(en, lambda x: NOT list_contains(av, x))) > 0 THEN 'enabled-sections-missing-candidates:' || array_to_string(list_filter(en, lambda x: NOT list_contains(av, x)), ',')
  WHEN len(list_filter(en, lambda x: list_contains(av, x))) > 0 THEN 'enabled-sections-empty-after-formatting' ELSE 'available-sections-disabled:' || array_to_string(av, ',') END AS reason,
  coalesce(nullif(bridge, ''), 'mcp') AS bridge, CASE WHEN bridge = 'fallback' OR model = 'disabled' THEN 'indexed-text-match' END AS file_fallback FROM e
""")
def empty_context_reasons(t: Tables):
    e = t.events
    av = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "rules"), F.when(F.col("event_id") % 3 == 0, "files")))
    en = F.array_compact(F.array(F.when(F.col("user_id") % 2 == 0, "rules"), F.when(F.col("user_id") % 5 == 0, "skills")))
    bridge = F.when(F.col("event_type") == "click", "fallback").when(F.col("event_type") == "view", "")
    mode = select.retrieval_mode(bridge, F.when(F.col("user_id") % 3 == 0, "disabled").otherwise("ready"))
    reason = select.empty_reason(F.col("event_id") % 11 != 0, F.col("event_id") % 7 == 0, av, en)
    return e.select("event_id", reason.alias("reason"), mode["bridge"].alias("bridge"), mode["file_fallback"].alias("file_fallback"))
