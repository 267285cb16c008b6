"""Compliance verdicts, reports and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import compliance, evaluate
from ..sources import labels as label_source
from . import bindings as B, sql as Q
from .finding_queries import FINDINGS, findings
from .registry import Tables, plain, query

# turns of a conversation: the user's text is the rule, the other turns the changed lines
_RULES = """
SELECT conv_id AS change_id, 'r' || CAST(turn AS VARCHAR(20)) AS rule_id, turn,
  CASE turn % 6 WHEN 0 THEN 'Keep it. Never use ' || text WHEN 2 THEN 'Always call ' || '`' || split_part(text, ' ', 4) || '.x` for ' || text
    WHEN 4 THEN 'You must run query_graph with ' || text ELSE 'Write `' || split_part(text, ' ', 5) || '` tests and no mocks; Do it: ' || text END AS content FROM {conversations} WHERE role = 'user'
"""
_LINES = """
SELECT conv_id AS change_id, turn AS ord, 'src/f' || CAST(turn AS VARCHAR(20)) || '.ts' AS file, CAST(turn * 10 AS INT) AS line, text || ' ' || split_part(text, ' ', 4) || '.x ' || role AS content FROM {conversations} WHERE role <> 'user'
"""
_SIGNALS = "SELECT conv_id AS change_id, text || CASE conv_id % 3 WHEN 0 THEN ' code-review-graph query_graph' ELSE ' rtk ls' END AS signal FROM {conversations} WHERE role = 'assistant'"

_STOP = Q.in_list(C.COMPLIANCE_STOP_WORDS)
_KEYWORD_SQL = f"""
WITH r AS ({plain(_RULES)}), l AS ({plain(_LINES)}), s AS ({plain(_SIGNALS)}),
cl AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(content, '([.;])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda c: c <> '') AS cs FROM r),
bd AS (SELECT *, list_filter(cs, lambda c: regexp_matches(c, '\\bno\\s|\\bnever\\b|\\bkhong\\b', 'i')) AS bad FROM cl),
tx AS (SELECT change_id, rule_id, content, CASE WHEN len(bad) > 0 THEN 'forbidden' ELSE 'required' END AS kind, CASE WHEN len(bad) > 0 THEN array_to_string(bad, ' ') ELSE content END AS txt FROM bd),
al AS (SELECT *, list_concat(regexp_extract_all(txt, '`([^`]+)`', 1), list_filter({Q.rule_tokens('txt')}, lambda t: length(t) >= 3 AND t NOT IN {_STOP} AND (regexp_matches(t, '[./_-]') OR regexp_matches(t, '^[a-z][a-z0-9]*$')))) AS w FROM tx),
ex AS (SELECT change_id, rule_id, content, kind, unnest(w) AS kw, generate_subscripts(w, 1) AS i FROM al),
dk AS (SELECT change_id, rule_id, kw, min(i) AS i FROM ex GROUP BY ALL),
kp AS (SELECT *, row_number() OVER (PARTITION BY change_id, rule_id ORDER BY i) AS p FROM dk),
k8 AS (SELECT * FROM kp),
ru AS (SELECT tx.*, regexp_matches(content, '\\bquery_graph\\b') OR regexp_matches(content, '\\bmust\\s+run\\b', 'i') AS runtime FROM tx),
hit AS (SELECT k.change_id, k.rule_id, kw, p, l.ord, l.file, l.line FROM k8 k JOIN ru ON ru.change_id = k.change_id AND ru.rule_id = k.rule_id AND NOT runtime JOIN l ON l.change_id = k.change_id AND regexp_matches(l.content, '(?i)\\b' || regexp_escape(kw) || '\\b')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change_id, rule_id ORDER BY p, ord) AS b FROM hit) WHERE b = 1),
v AS (SELECT ru.change_id, ru.rule_id, ru.content, ru.kind, runtime, best.kw, best.file, best.line,
  CASE WHEN runtime AND EXISTS (SELECT 1 FROM s WHERE s.change_id = ru.change_id AND contains(signal, 'query_graph')) THEN 'followed'
       WHEN NOT EXISTS (SELECT 1 FROM k8 WHERE k8.change_id = ru.change_id AND k8.rule_id = ru.rule_id) OR NOT EXISTS (SELECT 1 FROM l WHERE l.change_id = ru.change_id) THEN 'unmeasurable'
       WHEN runtime THEN CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.change_id = ru.change_id) THEN 'unknown' ELSE 'unmeasurable' END
       WHEN ru.kind = 'forbidden' THEN CASE WHEN best.kw IS NOT NULL THEN 'ignored' ELSE 'followed' END ELSE CASE WHEN best.kw IS NOT NULL THEN 'followed' ELSE 'unknown' END END AS status
  FROM ru LEFT JOIN best ON best.change_id = ru.change_id AND best.rule_id = ru.rule_id)
"""


@query("rule_keywords", "A1 A2", _KEYWORD_SQL + """
SELECT tx.change_id, tx.rule_id, tx.kind, coalesce(string_agg(kw, '|' ORDER BY p), '') AS keywords FROM tx LEFT JOIN k8 ON k8.change_id = tx.change_id AND k8.rule_id = tx.rule_id GROUP BY ALL
""")
def rule_keywords(t: Tables):
    out = compliance.classify_clauses(t.derive(_RULES))
    return out.select("change_id", "rule_id", "kind", F.array_join("keywords", "|").alias("keywords"))


@query("keyword_evidence", "J11", _KEYWORD_SQL + "SELECT change_id, rule_id, kw AS keyword, file, line FROM best")
def keyword_evidence(t: Tables):
    rules = compliance.classify_clauses(t.derive(_RULES)).where("NOT runtime")
    return compliance.keyword_evidence(rules, t.derive(_LINES)).select("change_id", "rule_id", "keyword", "file", "line")


@query("runtime_matches", "J14", _KEYWORD_SQL + "SELECT DISTINCT ru.change_id, ru.rule_id, 'query_graph' AS runtime_keyword FROM ru JOIN s ON s.change_id = ru.change_id AND contains(signal, 'query_graph') WHERE contains(content, 'query_graph')")
def runtime_matches(t: Tables):
    return compliance.match_runtime(compliance.classify_clauses(t.derive(_RULES)), t.derive(_SIGNALS))


def _verdicts(t: Tables):
    return compliance.verdicts(t.derive(_RULES).drop("turn"), t.derive(_LINES), t.derive(_SIGNALS))


@query("compliance_verdicts", "A3", _KEYWORD_SQL + "SELECT change_id, rule_id, status, CASE WHEN runtime THEN 'runtime' ELSE kind END AS kind, file, line FROM v")
def compliance_verdicts(t: Tables):
    return _verdicts(t).select("change_id", "rule_id", "status", "kind", "file", "line")


@query("compliance_reports", "A4", _KEYWORD_SQL + """
, c AS (SELECT change_id, count(*) FILTER (WHERE status = 'followed') AS followed, count(*) FILTER (WHERE status = 'ignored') AS ignored, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'unmeasurable') AS unmeasurable FROM v GROUP BY 1)
SELECT *, followed + ignored AS measured, round(100 * followed / nullif(followed + ignored, 0))::BIGINT AS efficiency FROM c
""")
def compliance_reports(t: Tables):
    return compliance.report(_verdicts(t))


# findings of order lines as structural items, next to rules of order comments
_ITEM_SQL = f"""
WITH f AS ({plain(FINDINGS)}), i AS (SELECT repo * 1000 + line AS change_id, category, severity, confidence, 'ignored' AS status FROM f
 UNION ALL SELECT (o_custkey % 100) * 1000 + o_orderkey % 300, CASE o_orderkey % 4 WHEN 0 THEN 'Security' WHEN 1 THEN 'Database' WHEN 2 THEN 'Testing' ELSE 'Architecture' END, CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END, 'heuristic',
   CASE o_orderstatus WHEN 'F' THEN 'followed' WHEN 'O' THEN 'unknown' ELSE 'unmeasurable' END FROM orders),
cats AS (SELECT unnest({Q.str_list(C.REPORT_CATEGORIES)}) AS category), ch AS (SELECT DISTINCT change_id FROM i),
fl AS (SELECT change_id, category, bool_or(status = 'ignored' AND severity IN ('HIGH', 'CRITICAL')) AS fail, bool_or(status IN ('ignored', 'unknown')) AS warn FROM i WHERE status <> 'unmeasurable' GROUP BY ALL),
st AS (SELECT ch.change_id, cats.category, CASE WHEN fail IS NULL THEN 'NOT_EVALUATED' WHEN fail THEN 'FAIL' WHEN warn THEN 'WARNING' ELSE 'PASS' END AS status FROM ch CROSS JOIN cats LEFT JOIN fl ON fl.change_id = ch.change_id AND fl.category = cats.category),
iss AS (SELECT change_id, category, CASE WHEN status = 'unknown' AND severity = 'HIGH' THEN 'MEDIUM' ELSE severity END AS severity, confidence FROM i WHERE status IN ('ignored', 'unknown')),
lost AS (SELECT change_id, category, sum(round({Q.weight('severity', C.SEVERITY_POINTS)} * CASE confidence WHEN 'certain' THEN 1 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.4 END))::BIGINT AS lost FROM iss GROUP BY ALL),
card AS (SELECT st.*, CASE WHEN status <> 'NOT_EVALUATED' THEN greatest(0, 100 - coalesce(lost, 0)) END::BIGINT AS score FROM st LEFT JOIN lost ON lost.change_id = st.change_id AND lost.category = st.category)
"""


def _items(t: Tables):
    structural = compliance.structural_verdicts(findings(t).withColumn("change_id", (F.col("repo") * 1000 + F.col("line")).cast("bigint")))
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'hash the password' WHEN 1 THEN 'add an index' WHEN 2 THEN 'write a test' ELSE 'keep layers' END")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'followed' WHEN 'O' THEN 'unknown' ELSE 'unmeasurable' END")
    none = F.lit(None).cast("string")
    written = t.orders.select(
        (F.col("o_custkey") % 100 * 1000 + F.col("o_orderkey") % 300).alias("change_id"), F.col("o_orderkey").cast("string").alias("rule_id"), text.alias("content"), status.alias("status"),
        F.lit("required").alias("kind"), F.array().cast("array<string>").alias("keywords"), none.alias("evidence"), none.alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit(False).alias("structural"), none.alias("category"), none.alias("severity"), none.alias("confidence"),
    )
    return written.unionByName(structural)


@query("category_status", "A5 U2 P11", _ITEM_SQL + "SELECT change_id, category, status FROM st")
def category_status(t: Tables):
    return compliance.category_status(_items(t))


@query("compliance_issues", "A6", _ITEM_SQL + "SELECT change_id, category, severity, confidence, count(*) AS n FROM iss GROUP BY ALL")
def compliance_issues(t: Tables):
    return compliance.issues(_items(t)).groupBy("change_id", "category", "severity", "confidence").agg(F.count("*").alias("n"))


@query("category_scorecards", "A7", _ITEM_SQL + "SELECT change_id, category, status, score FROM card")
def category_scorecards(t: Tables):
    v = _items(t)
    return compliance.scorecard(compliance.issues(v), compliance.category_status(v))


@query("overall_scores", "A7", _ITEM_SQL + "SELECT change_id, round(avg(score))::BIGINT AS overall, count(score) AS evaluated FROM card GROUP BY 1")
def overall_scores(t: Tables):
    v = _items(t)
    return compliance.overall_score(compliance.scorecard(compliance.issues(v), compliance.category_status(v)))


@query("classified_rules", "P11", f"""
WITH r AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' use prisma' WHEN 1 THEN ' redis cache' WHEN 2 THEN ' write a test' WHEN 3 THEN ' rate limit' ELSE '' END AS content FROM documents)
SELECT doc_id, {Q.case_first('content', [(c, p) for c, _, p in C.RULE_CATEGORIES], 'Architecture', 'i')} AS category, {Q.case_first('content', [(s, p) for _, s, p in C.RULE_CATEGORIES], 'INFO', 'i')} AS severity FROM r
""")
def classified_rules(t: Tables):
    tail = F.expr("CASE doc_id % 5 WHEN 0 THEN ' use prisma' WHEN 1 THEN ' redis cache' WHEN 2 THEN ' write a test' WHEN 3 THEN ' rate limit' ELSE '' END")
    c = compliance.classify_rule(F.concat("text", tail))
    return t.documents.select("doc_id", c["category"].alias("category"), c["severity"].alias("severity"))


@query("dropped_rules", "U3", """
SELECT conv_id AS change_id, text AS content, role AS source_path, count(*) AS n FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations k WHERE k.turn % 2 = 0 AND k.conv_id = c.conv_id AND k.text = c.text AND k.role = c.role) GROUP BY ALL
""")
def dropped_rules(t: Tables):
    scheduled = t.conversations.select(F.col("conv_id").alias("change_id"), F.col("text").alias("content"), F.col("role").alias("source_path"))
    kept = t.conversations.where("turn % 2 = 0").select(F.col("conv_id").alias("change_id"), F.col("text").alias("content"), F.col("role").alias("source_path"))
    return compliance.dropped_rules(scheduled, kept).groupBy("change_id", "content", "source_path").agg(F.count("*").alias("n"))


# --- evaluation ---------------------------------------------------------------

# labels: a document with a quality label is a fixture entry, the text length the prediction
_LABELLED = """
SELECT d.source AS fixture, 'CHK' AS id, 'd' || CAST(l.doc_id AS VARCHAR(20)) AS file, CASE WHEN quality = 1 THEN 'expected' WHEN toxic = 1 THEN 'tolerated' ELSE 'control' END AS role FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""
_PREDICTED = "SELECT source AS fixture, 'CHK' AS id, 'd' || CAST(doc_id AS VARCHAR(20)) AS file, CAST(n_chars AS INT) AS line FROM {documents} WHERE n_chars % 3 < 2 UNION ALL SELECT source, 'CHK', 'd' || CAST(doc_id AS VARCHAR(20)), CAST(n_chars + 1 AS INT) FROM {documents} WHERE n_chars % 7 = 0"
_LABEL_SQL = f"""
WITH l AS ({plain(_LABELLED)}), p AS ({plain(_PREDICTED)}), h AS (SELECT fixture, id, file, min(line) AS line, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT h.fixture, h.id, h.file, h.line, CASE WHEN e.file IS NOT NULL THEN 'true_positive' WHEN t.file IS NOT NULL THEN 'tolerated' WHEN c.file IS NOT NULL THEN 'false_positive' ELSE 'unlabelled' END AS outcome, CASE WHEN e.file IS NOT NULL THEN 1 ELSE h.n END::BIGINT AS n
  FROM h LEFT JOIN (SELECT DISTINCT fixture, id, file FROM l WHERE role = 'expected') e USING (fixture, id, file) LEFT JOIN (SELECT DISTINCT fixture, id, file FROM l WHERE role = 'tolerated') t USING (fixture, id, file) LEFT JOIN (SELECT DISTINCT fixture, file FROM l WHERE role = 'control') c USING (fixture, file)
  UNION ALL SELECT DISTINCT fixture, id, file, NULL::INT, 'false_negative', 1::BIGINT FROM l WHERE role = 'expected' AND NOT EXISTS (SELECT 1 FROM h WHERE h.fixture = l.fixture AND h.file = l.file AND h.id = l.id))
"""


def _labelled(t: Tables):
    return evaluate.label_findings(t.derive(_PREDICTED), t.derive(_LABELLED))


@query("labelled_findings", "J15", _LABEL_SQL + "SELECT fixture, id, file, line, outcome, n FROM o")
def labelled_findings(t: Tables):
    return _labelled(t)


@query("detection_metrics", "A15", _LABEL_SQL + """
, s AS (SELECT fixture, sum(CASE WHEN outcome = 'true_positive' THEN n ELSE 0 END)::BIGINT AS true_positive, sum(CASE WHEN outcome = 'false_positive' THEN n ELSE 0 END)::BIGINT AS false_positive, sum(CASE WHEN outcome = 'false_negative' THEN n ELSE 0 END)::BIGINT AS false_negative,
  sum(CASE WHEN outcome = 'tolerated' THEN n ELSE 0 END)::BIGINT AS tolerated, sum(CASE WHEN outcome = 'unlabelled' THEN n ELSE 0 END)::BIGINT AS unlabelled FROM o GROUP BY 1)
SELECT *, round(coalesce(true_positive / nullif(true_positive + false_negative, 0), 0), 4) AS recall, round(coalesce(true_positive / nullif(true_positive + false_positive, 0), 1), 4) AS precision,
  round(coalesce(false_negative / nullif(true_positive + false_negative, 0), 0), 4) AS false_negative_rate, round(coalesce(false_positive / nullif(true_positive + false_positive, 0), 0), 4) AS false_positive_rate FROM s
""")
def detection_metrics(t: Tables):
    return evaluate.detection_metrics(_labelled(t), ["fixture"])


# orders as cases over the brands of their lines
_CASES = """
SELECT o_orderkey AS case_id, o_orderpriority AS system, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 's' || CAST(o_custkey % 4 AS VARCHAR(20)) END AS expected, 's' || CAST(o_custkey % 6 AS VARCHAR(20)) AS allowed, 's' || CAST(o_custkey % 7 AS VARCHAR(20)) AS forbidden FROM {orders}
"""
_CHOSEN = """
SELECT l_orderkey AS case_id, 's' || CAST(l_partkey % 4 AS VARCHAR(20)) AS id, min(CAST(l_linenumber AS INT)) AS rank, max(CAST(l_quantity AS DOUBLE) / 50) AS confidence FROM {lineitem} GROUP BY 1, 2
"""
_ROUTE_SQL = f"""
WITH c AS ({plain(_CASES)}), ch AS (SELECT case_id, id, confidence, row_number() OVER (PARTITION BY case_id ORDER BY rank, id) AS rank FROM ({plain(_CHOSEN)}) WHERE rank <= 3),
s AS (SELECT c.*, coalesce(list(ch.id ORDER BY ch.rank) FILTER (WHERE ch.id IS NOT NULL), []) AS ids, coalesce(list(ch.confidence ORDER BY ch.rank) FILTER (WHERE ch.id IS NOT NULL), []) AS conf FROM c LEFT JOIN ch USING (case_id) GROUP BY ALL),
m AS (SELECT *, CASE WHEN expected = '' THEN (len(ids) = 0)::INT ELSE coalesce((ids[1] = expected)::INT, 0) END AS top1, CASE WHEN expected = '' THEN 0 ELSE 1 END AS rt, CASE WHEN expected <> '' AND list_contains(ids, expected) THEN 1 ELSE 0 END AS rh,
  len(ids) AS ft, len(list_filter(ids, lambda x: x <> expected AND x <> allowed)) AS fh, 1 AS gt, CASE WHEN list_contains(ids, forbidden) THEN 0 ELSE 1 END AS gh, len(ids) + CASE WHEN len(ids) = 0 AND expected = '' THEN 1 ELSE 0 END AS ct,
  len(list_filter(range(1, len(ids) + 1), lambda i: (ids[i] = expected OR ids[i] = allowed) = (conf[i] >= 0.65))) + CASE WHEN len(ids) = 0 AND expected = '' THEN 1 ELSE 0 END AS chh FROM s)
"""


def _case_tables(t: Tables):
    some = lambda c: F.filter(F.array(c), lambda v: v != "")
    cases = t.derive(_CASES).select("case_id", "system", *[some(c).alias(c) for c in ("expected", "allowed", "forbidden")])
    return cases, t.derive(_CHOSEN)


@query("routing_metrics", "A14", _ROUTE_SQL + """
SELECT count(*) AS cases, round(sum(top1) / count(*), 6) AS top1_accuracy, round(sum(rh) / sum(rt), 6) AS top3_recall, round(sum(fh) / sum(ft), 6) AS false_positive_rate, round(sum(gh) / sum(gt), 6) AS negative_gate_accuracy, round(sum(chh) / sum(ct), 6) AS calibration FROM m
""")
def routing_metrics(t: Tables):
    cases, chosen = _case_tables(t)
    out = evaluate.routing_metrics(cases.drop("system"), chosen)
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns if c != "cases"])


@query("leaderboard", "A16", _ROUTE_SQL + """
, k AS (SELECT system, (expected = '' OR list_contains(ids, expected)) AND NOT list_contains(ids, forbidden) AND len(list_filter(ids, lambda x: x <> expected AND x <> allowed)) = 0 AND (expected <> '' OR len(ids) = 0) AS ok FROM m)
SELECT system, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, round(avg(ok::INT), 6) AS correct_rate FROM k GROUP BY 1
""")
def leaderboard(t: Tables):
    cases, chosen = _case_tables(t)
    ids = chosen.where("rank <= 3").groupBy("case_id").agg(F.collect_set("id").alias("selected"))
    runs = cases.join(ids, "case_id", "left").withColumn("selected", F.coalesce("selected", F.array().cast("array<string>")))
    out = evaluate.leaderboard(runs)
    return out.withColumn("correct_rate", F.round("correct_rate", 6))


@query("case_items", "S12", """
SELECT case_id, role, item FROM (SELECT o_orderkey::VARCHAR AS case_id, 'expected' AS role, 's' || o_custkey % 4 AS item FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey::VARCHAR, 'allowed', 's' || o_custkey % 6 FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'forbidden', 's' || o_custkey % 7 FROM orders)
""")
def case_items(t: Tables):
    from ..session import shared_folder

    cases, _ = _case_tables(t)
    path = shared_folder(t.spark, "cases")
    cases.select(F.col("case_id").cast("string"), "expected", "allowed", F.col("forbidden").alias("rejected")).write.json(path)
    return label_source.case_items(label_source.read_cases(t.spark, path))


@query("middle_risk", "A11", f"""
WITH s AS ({plain(B.SCORED_PARTS)}), r AS (SELECT task_id, score, row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY task_id) AS n FROM s),
c AS (SELECT task_id, any_value(n) AS rules, count(*) FILTER (WHERE score >= 0.1) AS relevant, count(*) FILTER (WHERE score >= 0.1 AND pos BETWEEN floor(n * 0.25) AND ceil(n * 0.75)) AS in_middle FROM r GROUP BY 1)
SELECT *, coalesce(round(100 * in_middle / nullif(relevant, 0)), 0)::BIGINT AS risk_percent FROM c
""")
def middle_risk(t: Tables):
    from ..operators.relevance import renumber

    scored = renumber(t.derive(B.SCORED_PARTS), ["task_id"])
    return evaluate.middle_risk(scored, ["task_id"])


_READY = """
SELECT p_partkey % 211 AS repo, p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN 'a/AGENTS.md' WHEN 1 THEN 'AGENTS.md' ELSE '~/AGENTS.md' END AS source_path, CASE WHEN p_size % 5 = 0 THEN 'Always lint' ELSE 'Lint it' END AS content FROM {part}
"""
_READY_SQL = f"""
WITH p AS ({plain(_READY)}), repos AS (SELECT repo, bool_or(p_size = 7) AS d FROM (SELECT p_partkey % 211 AS repo, p_size FROM part) GROUP BY 1),
r AS (SELECT repo, count(DISTINCT CASE WHEN source_path NOT LIKE '~%' THEN source_path END) AS src, count(*) AS act, bool_or(content LIKE 'Always%') AS imp FROM p WHERE p_size < 25 GROUP BY 1),
c AS (SELECT repo, count(*) AS items, count(*) FILTER (WHERE p_size % 4 = 0) AS proj FROM p WHERE p_size BETWEEN 20 AND 40 GROUP BY 1),
m AS (SELECT repo, count(*) AS meta, count(*) FILTER (WHERE p_size % 2 = 0) AS rich FROM p WHERE p_size > 40 GROUP BY 1),
w AS (SELECT repo, count(*) AS flows, count(*) FILTER (WHERE p_size % 2 = 0) AS ch FROM p WHERE p_size BETWEEN 10 AND 18 GROUP BY 1),
j AS (SELECT repo, d, coalesce(src, 0) AS src, coalesce(act, 0) AS act, coalesce(imp, false) AS imp, coalesce(items, 0) AS items, coalesce(proj, 0) AS proj, coalesce(meta, 0) AS meta, coalesce(rich, 0) AS rich, coalesce(flows, 0) AS flows, coalesce(ch, 0) AS ch
  FROM repos LEFT JOIN r USING (repo) LEFT JOIN c USING (repo) LEFT JOIN m USING (repo) LEFT JOIN w USING (repo)),
s AS (SELECT repo, proj, (src > 0)::INT * 55 + (act >= 3)::INT * 20 + imp::INT * 15 + (src > 1 OR d)::INT * 10 AS rule_score, (items > 0)::INT * 50 + (items > proj OR proj >= 3)::INT * 25 + (proj > 0)::INT * 10 + (meta > 0)::INT * 5 + (rich > 0)::INT * 10 AS catalog_score,
  (flows > 0)::INT * 60 + (ch > 0)::INT * 25 + (flows >= 2)::INT * 15 AS workflow_score, CASE WHEN proj >= 3 THEN 100 WHEN proj = 2 THEN 70 WHEN proj = 1 THEN 40 ELSE 0 END AS override_score FROM j),
o AS (SELECT *, round((rule_score + catalog_score + workflow_score) / 3)::INT AS overall FROM s)
"""


@query("readiness", "A12 A13", _READY_SQL + """
SELECT repo, rule_score, catalog_score, workflow_score, override_score, overall, CASE WHEN least(rule_score, catalog_score, workflow_score) < 50 THEN 'Not Ready' WHEN proj = 0 AND overall >= 85 THEN 'Silver' WHEN overall >= 85 THEN 'Gold' WHEN overall >= 70 THEN 'Silver' WHEN overall >= 50 THEN 'Bronze' ELSE 'Not Ready' END AS tier FROM o
""")
def readiness(t: Tables):
    p = t.derive(_READY)
    repos = t.part.groupBy((F.col("p_partkey") % 211).alias("repo")).agg(F.bool_or(F.col("p_size") == 7).alias("has_rule_dir"))
    rules = p.where("p_size < 25").withColumn("in_project", ~F.col("source_path").startswith("~"))
    items = p.where("p_size BETWEEN 20 AND 40").select("repo", F.lit("x").alias("name"), F.when(F.col("p_size") % 4 == 0, "project").otherwise("global").alias("scope"))
    meta = p.where("p_size > 40").select("repo", F.expr("CASE WHEN p_size % 2 = 0 THEN concat('positive_triggers:', chr(10), 'evidence:', chr(10), 'negative_triggers:', chr(10), 'workflow: x') ELSE 'evidence:' END").alias("text"))
    flows = p.where("p_size BETWEEN 10 AND 18").select("repo", F.lit("w").alias("name"), F.expr("CASE WHEN p_size % 2 = 0 THEN array('planner') ELSE array() END").cast("array<string>").alias("chain"))
    return evaluate.readiness(repos, rules, items, flows, meta)


_CATS = list(C.RUBRIC_WEIGHTS)


@query("release_rubric", "A17", f"""
WITH c AS (SELECT o_custkey % 20 AS release, {Q.str_list(_CATS)}[o_orderkey % 10 + 1] AS category, 5 AS mx, least(5, greatest(0, o_orderkey % 7 + 1)) AS pts FROM orders),
p AS (SELECT release, category, sum(mx) AS mx, sum(pts) AS earned FROM c GROUP BY ALL), s AS (SELECT release, sum(round(earned / mx * {Q.weight('category', C.RUBRIC_WEIGHTS)}, 2)::DECIMAL(12,2)) AS score FROM p GROUP BY 1),
g AS (SELECT c_custkey % 20 AS release, bool_and(c_acctbal > -900) AS gates_passed, count(*) FILTER (WHERE c_acctbal > -900) AS gates FROM customer GROUP BY 1)
SELECT s.release, round(score, 1)::DOUBLE AS score, gates_passed, gates, round(score, 1) > 70 AND gates_passed AS ready FROM s JOIN g USING (release)
""")
def release_rubric(t: Tables):
    names = F.array(*[F.lit(c) for c in _CATS])
    checks = t.orders.select(
        (F.col("o_custkey") % 20).alias("release"), F.element_at(names, (F.col("o_orderkey") % 10 + 1).cast("int")).alias("category"), F.lit(5).alias("max"), (F.col("o_orderkey") % 7 + 1).alias("points")
    )
    gates = t.customer.select((F.col("c_custkey") % 20).alias("release"), F.col("c_custkey").cast("string").alias("gate"), (F.col("c_acctbal") > -900).alias("passed"))
    return evaluate.rubric(checks, gates)


@query("latency_summary", "A18", """
WITH p AS (SELECT event_type AS suite, user_id % 5 AS size, count(*) AS runs, avg(value) AS mean_ms, quantile_cont(value, 0.95) AS p95_ms, avg(value) / greatest(1, avg(event_id % 50)) AS ms_per_file FROM events GROUP BY ALL)
SELECT suite, size, runs, round(mean_ms, 4) AS mean_ms, round(p95_ms, 4) AS p95_ms, round(ms_per_file, 4) AS ms_per_file, round(mean_ms / nullif(lag(mean_ms) OVER (PARTITION BY suite ORDER BY size), 0), 4) AS growth FROM p
""")
def latency_summary(t: Tables):
    runs = t.events.select(F.col("event_type").alias("suite"), (F.col("user_id") % 5).alias("size"), (F.col("event_id") % 50).alias("files"), F.col("value").alias("ms"))
    out = evaluate.latency_summary(runs)
    return out.select("suite", "size", "runs", *[F.round(c, 4).alias(c) for c in ("mean_ms", "p95_ms", "ms_per_file", "growth")])


@query("distinct_modules", "A19", """
WITH i AS (SELECT l_suppkey AS repo, CASE l_partkey % 4 WHEN 0 THEN './x' WHEN 1 THEN '@scope' || l_partkey % 30 || '/pkg' ELSE 'lib' || l_partkey % 50 END AS m FROM lineitem)
SELECT repo, count(DISTINCT CASE WHEN m NOT LIKE '.%' THEN m END) AS modules FROM i GROUP BY 1
""")
def distinct_modules(t: Tables):
    spec = F.expr("CASE l_partkey % 4 WHEN 0 THEN './x' WHEN 1 THEN concat('@scope', l_partkey % 30, '/pkg/deep') ELSE concat('lib', l_partkey % 50, '/sub') END")
    return evaluate.distinct_modules(t.lineitem.select(F.col("l_suppkey").alias("repo"), spec.alias("specifier")))
