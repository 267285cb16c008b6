"""Parsing of texts: tokenizers, rules, statements, schemas, catalogs, mentions, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import paths
from ..functions.text import tokenize
from ..operators import checks_text, parsing
from ..sources import listings
from . import bindings as B, sql as Q
from .registry import Tables, plain, query


@query("token_frequencies", "T1", f"""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest({Q.rule_tokens('text')}) AS token FROM documents) GROUP BY token
""")
def token_frequencies(t: Tables):
    toks = t.documents.select("doc_id", F.explode(tokenize(F.col("text"))).alias("token"))
    per_doc = toks.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("token_profiles", "T2", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS profile, token, count(*) AS n FROM (SELECT unnest({fn('text')}) AS token FROM conversations) GROUP BY token"
    for name, fn in [("words", Q.words), ("catalog", Q.catalog_tokens), ("file", Q.file_tokens), ("eval", Q.eval_tokens), ("graph", Q.graph_terms)]
))
def token_profiles(t: Tables):
    def labelled(profile: str):
        return F.transform(
            tokenize(F.col("text"), profile), lambda w: F.struct(F.lit(profile).alias("profile"), w.alias("token"))
        )

    profiles = F.concat(*[labelled(p) for p in ("words", "catalog", "file", "eval", "graph")])
    rows = t.conversations.select(F.explode(profiles).alias("r")).select("r.profile", "r.token")
    return rows.groupBy("profile", "token").agg(F.count("*").alias("n"))


_RULE_SQL = f"""
WITH docs AS ({plain(B.RULE_DOCS)}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
kinds AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines),
tagged AS (SELECT *, CASE WHEN regexp_matches(bare, '^## Source:\\s+(.+)$') THEN 'S' WHEN bare = '' OR regexp_matches(bare, '^-{{3,}}$') THEN 'X'
                          WHEN regexp_matches(line, '^\\s{{0,3}}([-*+]|\\d+[.)])\\s+|^#{{1,6}}\\s+') THEN 'B' ELSE 'P' END AS kind FROM kinds),
islands AS (SELECT *, sum(CASE WHEN kind = 'P' AND prev = 'P' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island,
                   last_value(CASE WHEN kind = 'S' THEN trim(regexp_extract(bare, '^## Source:\\s+(.+)$', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS src
            FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM tagged)),
folded AS (SELECT doc_id, island, min(i) AS i, any_value(kind) AS kind, coalesce(any_value(src), 'unknown') AS source_path,
                  string_agg(CASE WHEN kind = 'B' THEN line ELSE bare END, ' ' ORDER BY i) AS raw FROM islands WHERE kind IN ('B', 'P') GROUP BY doc_id, island),
cleaned AS (SELECT doc_id, i, kind, source_path, trim(regexp_replace(regexp_replace(regexp_replace(
                CASE WHEN kind = 'P' THEN regexp_replace(raw, '\\s+', ' ', 'g') ELSE raw END,
                '^\\s{{0,3}}[-*+]\\s+', ''), '^\\s{{0,3}}\\d+[.)]\\s+', ''), '^#+\\s+', '')) AS content FROM folded),
kept AS (SELECT * FROM cleaned WHERE length(content) >= CASE WHEN kind = 'P' THEN 20 ELSE 4 END),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source_path, lower(content) ORDER BY i) AS rn FROM kept) WHERE rn = 1),
rules AS (SELECT doc_id, source_path, content, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM firsts)
"""


@query("parsed_rules", "T3 K8", _RULE_SQL + """
SELECT doc_id, 'r' || (pos + 1) AS rule_id, source_path, content, CAST(pos AS INTEGER) AS pos FROM rules
""")
def parsed_rules(t: Tables):
    return parsing.parse_rules(t.derive(B.RULE_DOCS).select("doc_id", "text"))


_ENV = " OR ".join(f"regexp_matches(content, {Q.quote(p)}, 'i')" for p in C.ENVIRONMENT_RULE_PATTERNS)
_HEAD = " OR ".join(f"regexp_matches(v, {Q.quote(p)}, 'i')" for p in C.DOCUMENTATION_HEADINGS)


@query("actionable_rules", "P1", _RULE_SQL + f"""
, stripped AS (SELECT *, trim(regexp_replace(regexp_replace(trim(content), '^#+\\s+', ''), '^\\*\\*(.*)\\*\\*$', '\\1')) AS v FROM rules)
, judged AS (SELECT *, v = '' OR regexp_matches(v, '^<!--.*-->$')
    OR (NOT regexp_matches(regexp_replace(v, '^@', ''), '\\s') AND regexp_matches(v, {Q.quote(C.FILE_REFERENCE_PATTERN)}, 'i'))
    OR {_HEAD}
    OR (length(v) <= 80 AND NOT regexp_matches(v, '[`.:;]') AND len({Q.rule_tokens('v')}) <= 4
        AND NOT list_has_any({Q.rule_tokens('v')}, {Q.str_list(C.ACTION_TOKENS)})) AS documentation
   FROM stripped)
SELECT doc_id, content, 'r' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rule_id FROM judged WHERE NOT documentation AND NOT ({_ENV})
""")
def actionable_rules(t: Tables):
    rules = parsing.parse_rules(t.derive(B.RULE_DOCS).select("doc_id", "text"), only_actionable=True)
    return rules.select("doc_id", "content", "rule_id")


_STMT_SQL = f"""
WITH files AS ({plain(B.SQL_FILES)}),
lines AS (SELECT repo, path, regexp_replace(unnest(string_split(text, chr(10))), '--.*$', '') AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files),
grouped AS (SELECT *, coalesce(sum(CASE WHEN contains(l, ';') THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM lines),
statements AS (SELECT repo, path, g, trim(regexp_replace(string_agg(l, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS stmt, min(i) FILTER (WHERE trim(l) <> '') AS line
               FROM grouped GROUP BY repo, path, g)
"""


@query("sql_statements", "T4", _STMT_SQL + """
SELECT repo, path, stmt, CAST(line AS INTEGER) AS line FROM statements WHERE stmt <> ''
""")
def sql_statements(t: Tables):
    return parsing.split_sql(t.spread(t.derive(B.SQL_FILES))).drop("ord")


def _not_then(head: str, tail: str) -> str:
    return f"(regexp_matches(stmt, {Q.quote(head)}, 'i') AND NOT regexp_matches(stmt, {Q.quote(head + tail)}, 'i'))"


@query("migration_findings", "C1", _STMT_SQL + f"""
, hits AS (
  SELECT repo, path, stmt, line, 'PG-001' AS id, 'HIGH' AS severity, 1 AS variant FROM statements WHERE regexp_matches(path, 'migrat', 'i')
    AND {_not_then(r"ALTER\s+TABLE\s+\S+\s+ADD\s+COLUMN\b[^;]*\bNOT\s+NULL\b", r"[^;]*\bDEFAULT\b")}
  UNION ALL SELECT repo, path, stmt, line, 'PG-001', 'HIGH', 2 FROM statements WHERE regexp_matches(path, 'migrat', 'i')
    AND regexp_matches(stmt, 'ALTER\\s+TABLE\\s+\\S+\\s+ALTER\\s+COLUMN\\s+\\S+\\s+TYPE\\b', 'i')
  UNION ALL SELECT repo, path, stmt, line, 'PG-001', 'HIGH', 3 FROM statements WHERE regexp_matches(path, 'migrat', 'i')
    AND {_not_then(r"ALTER\s+TABLE\s+\S+\s+ADD\s+CONSTRAINT\b[^;]*\b(FOREIGN\s+KEY|CHECK)\b", r"[^;]*\bNOT\s+VALID\b")}
  UNION ALL SELECT repo, path, stmt, line, 'PG-002', 'MEDIUM', 4 FROM statements WHERE regexp_matches(path, 'migrat', 'i')
    AND {_not_then(r"CREATE\s+(UNIQUE\s+)?INDEX\b", r"[^;]*\bCONCURRENTLY\b")}
  UNION ALL SELECT repo, path, stmt, line, 'PG-003', 'CRITICAL', 5 FROM statements WHERE regexp_matches(path, 'migrat', 'i')
    AND regexp_matches(stmt, '\\b(DELETE\\s+FROM|UPDATE)\\s+[\\w".]+\\s*[^;]*;', 'i')
    AND NOT regexp_matches(stmt, '\\b(DELETE\\s+FROM|UPDATE)\\s+[\\w".]+\\s*[^;]*\\bWHERE\\b', 'i')
  UNION ALL SELECT repo, path, stmt, line, 'PG-004', 'MEDIUM', 6 FROM statements
    WHERE {_not_then(r'SELECT\s+\*\s+FROM\s+[\w".]+', r"[^;]*\b(LIMIT|WHERE|COUNT)\b")}
)
SELECT repo, path AS file, id, severity, CAST(line AS INTEGER) AS line, stmt AS evidence FROM hits
""")
def migration_findings(t: Tables):
    found = checks_text.check_sql(t.spread(t.derive(B.SQL_FILES)))
    return found.select("repo", "file", "id", "severity", "line", "evidence")


_BLOCK_SQL = f"""
WITH files AS ({plain(B.SCHEMA_FILES)}),
lines AS (SELECT repo, file, trim(regexp_replace(unnest(string_split(text, chr(10))), '//.*$', '')) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files),
starts AS (SELECT *, regexp_matches(l, '^(datasource|generator|model|enum|type|view)\\s+([A-Za-z_]\\w*)\\s*\\{{') AS st FROM lines WHERE l <> ''),
blocks AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY repo, file ORDER BY i) AS b,
                  sum(CASE WHEN l = '}}' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, file ORDER BY i) AS e FROM starts),
heads AS (SELECT repo, file, b, i AS line, regexp_extract(l, '^(\\w+)', 1) AS kind, regexp_extract(l, '^\\w+\\s+([A-Za-z_]\\w*)', 1) AS name FROM blocks WHERE st),
body AS (SELECT x.repo, x.file, h.kind, h.name AS model, h.line AS mline, x.i AS line, x.l AS text FROM blocks x JOIN heads h USING (repo, file, b) WHERE NOT x.st AND x.l <> '}}' AND x.e < x.b),
fields AS (SELECT *, regexp_extract(text, '^([A-Za-z_]\\w*)\\s+', 1) AS name, regexp_extract(text, '^[A-Za-z_]\\w*\\s+([A-Za-z_]\\w*)', 1) AS type,
                  regexp_matches(text, '^[A-Za-z_]\\w*\\s+[A-Za-z_]\\w*\\[\\]') AS is_list,
                  regexp_matches(text, '(^|[^@])@id\\b') AS has_id, regexp_matches(text, '(^|[^@])@unique\\b') AS has_unique
           FROM body WHERE kind = 'model' AND text NOT LIKE '@@%' AND regexp_matches(text, '^[A-Za-z_]\\w*\\s+[A-Za-z_]')),
attrs AS (SELECT * FROM body WHERE kind = 'model' AND text LIKE '@@%')
"""


@query("schema_fields", "T5", _BLOCK_SQL + """
SELECT repo, file, model, name AS field, type, is_list, CAST(line AS INTEGER) AS line,
       array_to_string(regexp_extract_all(text, '@@?[A-Za-z_][\\w.]*(\\([^)]*\\))?', 0), ' ') AS attributes FROM fields
""")
def schema_fields(t: Tables):
    models = parsing.schema_models(parsing.parse_schema_blocks(t.spread(t.derive(B.SCHEMA_FILES))))
    return parsing.schema_fields(models).select(
        "repo", "file", "model", "field", "type", "is_list", "line", F.array_join("attributes", " ").alias("attributes")
    )


@query("schema_findings", "C2", _BLOCK_SQL + f"""
, marked AS (SELECT f.*, EXISTS (SELECT 1 FROM attrs a WHERE a.repo = f.repo AND a.file = f.file AND a.model = f.model AND (a.text LIKE '@@index%' OR a.text LIKE '@@unique%') AND contains(a.text, f.name)) AS indexed,
                    EXISTS (SELECT 1 FROM fields o WHERE o.repo = f.repo AND o.file = f.file AND o.model = f.model AND contains(o.text, 'fields: [' || f.name || ']')) AS backs
             FROM fields f)
SELECT repo, file, 'PRISMA-001' AS id, 'MEDIUM' AS severity, 'high' AS confidence, CAST(line AS INTEGER) AS line, text AS evidence FROM marked
  WHERE regexp_matches(name, '_?id$', 'i') AND type IN {Q.in_list(C.PRISMA_SCALARS)} AND backs AND NOT has_id AND NOT has_unique AND NOT indexed
UNION ALL SELECT repo, file, 'PRISMA-002', CASE WHEN lower(name) = 'email' THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN lower(name) = 'email' THEN 'medium' ELSE 'low' END, CAST(line AS INTEGER), text FROM marked
  WHERE type IN {Q.in_list(C.PRISMA_SCALARS)} AND NOT is_list AND regexp_matches(name, '(^|[a-z])(email|slug|uuid|code|externalId|token|username)$', 'i') AND NOT has_id AND NOT has_unique AND NOT indexed
UNION ALL SELECT repo, file, 'PRISMA-003', 'MEDIUM', 'high', CAST(line AS INTEGER), text FROM marked WHERE type = 'Float' AND regexp_matches(name, 'price|amount|total|balance|cost|fee|salary', 'i')
UNION ALL SELECT h.repo, h.file, 'PRISMA-004', 'MEDIUM', 'high', CAST(h.line AS INTEGER), 'model ' || h.name FROM heads h WHERE h.kind = 'model'
  AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.repo = h.repo AND f.file = h.file AND f.model = h.name AND f.has_id)
  AND NOT EXISTS (SELECT 1 FROM attrs a WHERE a.repo = h.repo AND a.file = h.file AND a.model = h.name AND a.text LIKE '@@id%')
  AND EXISTS (SELECT 1 FROM fields f JOIN heads o ON o.repo = f.repo AND o.file = f.file AND o.name = f.type AND o.kind = 'model' WHERE f.repo = h.repo AND f.file = h.file AND f.model = h.name)
UNION ALL SELECT repo, file, 'PRISMA-005', 'HIGH', 'certain', CAST(mline AS INTEGER), 'url = ' || regexp_replace(regexp_replace(trim(regexp_extract(text, '=(.*)$', 1)), '^["'']', ''), '["'']$', '') FROM body
  WHERE kind = 'datasource' AND regexp_matches(text, '^url\\s*=') AND NOT regexp_matches(text, '^url\\s*=\\s*env\\(')
""")
def schema_findings(t: Tables):
    return checks_text.check_schema(t.spread(t.derive(B.SCHEMA_FILES))).select(
        "repo", "file", "id", "severity", "confidence", "line", "evidence"
    )


def _credential_sql() -> str:
    fmt = " OR ".join(f"regexp_matches(value, {Q.quote(p)})" for _, p in C.CREDENTIAL_FORMATS)
    host = "regexp_extract(value, '://[^\\s/@]*@([^\\s:/?#]+)', 1)"
    return f"""
WITH src AS (SELECT source AS repo, 'doc' || doc_id AS file, {B.CREDENTIAL_TEXT} AS text FROM documents),
lines AS (SELECT repo, file, unnest(regexp_split_to_array(text, '\r?\n')) AS l, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS line FROM src),
found AS (SELECT repo, file, line, unnest(list_concat(
   regexp_extract_all(regexp_replace(l, '"[^"''\n]*"', '"' , 'g'), 'zzz', 0),
   regexp_extract_all(l, '(?:[A-Za-z_][A-Za-z0-9_]*["'']?\\s*[:=]\\s*)?(?:"[^"''\n]*"|''[^"''\n]*'')', 0))) AS m FROM lines),
lits AS (SELECT repo, file, line, nullif(regexp_extract(m, '^([A-Za-z_][A-Za-z0-9_]*)["'']?\\s*[:=]\\s*["'']', 1), '') AS prop,
                regexp_extract(m, '["'']([^"''\n]*)["'']$', 1) AS value FROM found),
judged AS (SELECT *, coalesce(regexp_matches(prop, {Q.quote(C.SECRET_PROPERTY_PATTERN)}), false) AS named, {host} AS host,
   regexp_matches(value, {Q.quote(C.CREDENTIAL_URI)}) AS uri, ({fmt}) AS issued,
   length(value) >= {C.MIN_SECRET_LENGTH} AND NOT regexp_matches(value, '\\s') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '^[A-Z][A-Z0-9_]*$') AS shaped,
   (SELECT -sum(n / length(value) * log2(n / length(value))) FROM (SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(value, '')) AS c) WHERE c <> '' GROUP BY c)) AS bits FROM lits)
SELECT repo, file, CAST(line AS INTEGER) AS line, value AS evidence,
       CASE WHEN issued OR (uri AND (named OR NOT (host IN {Q.in_list(C.DEVELOPMENT_HOSTS)} OR NOT contains(host, '.')))) THEN 'certain' ELSE 'high' END AS confidence
FROM judged WHERE issued OR (uri AND (named OR NOT (host IN {Q.in_list(C.DEVELOPMENT_HOSTS)} OR NOT contains(host, '.'))))
   OR (named AND lower(prop) IN {Q.in_list(C.DIRECT_KEY_PROPERTIES)} AND value <> '') OR (named AND shaped AND bits >= {C.MIN_SECRET_ENTROPY})
"""


@query("credential_findings", "C3", _credential_sql())
def credential_findings(t: Tables):
    files = t.derive(f"SELECT source AS repo, 'doc' || CAST(doc_id AS VARCHAR(20)) AS file, {B.CREDENTIAL_TEXT} AS text FROM {{documents}}")
    found = checks_text.check_credentials(checks_text.literals_in_text(files))
    return found.select("repo", "file", "line", "evidence", "confidence")


@query("deployment_findings", "C4", f"""
WITH src AS ({plain(B.SOURCE_TEXTS)}),
per AS (SELECT repo, bool_or(regexp_matches(text, {Q.quote(C.SHUTDOWN_PATTERN)})) AS shutdown, bool_or(regexp_matches(text, {Q.quote(C.HEALTH_PATTERN)})) AS health,
               min(CASE WHEN regexp_matches(file, {Q.quote(C.ENTRYPOINT_PATTERN)}) THEN file END) AS entry, count(*) AS n FROM src GROUP BY repo),
box AS (SELECT * FROM per WHERE repo IN (SELECT repo FROM ({plain(B.REPO_FILES)}) WHERE path IN {Q.in_list(C.CONTAINER_FILES)}))
SELECT repo, 'SCALE-006' AS id, coalesce(entry, '(project)') AS file, CASE WHEN entry IS NULL THEN 0 ELSE 1 END AS line, n || ' scanned file(s)' AS evidence FROM box WHERE NOT shutdown
UNION ALL SELECT repo, 'SCALE-007', coalesce(entry, '(project)'), CASE WHEN entry IS NULL THEN 0 ELSE 1 END, n || ' scanned file(s)' FROM box WHERE NOT health
""")
def deployment_findings(t: Tables):
    found = checks_text.check_deployment(t.derive(B.SOURCE_TEXTS), t.derive(B.REPO_FILES))
    return found.select("repo", "id", "file", "line", "evidence")


@query("corpus_counters", "C5", f"""
WITH src AS ({plain(B.COUNTER_TEXTS)}),
homes AS (SELECT repo, unnest(regexp_extract_all(text, {Q.quote(C.HOME_PATH_PATTERN)}, 1)) AS u FROM src),
lines AS (SELECT repo, unnest(string_split(text, chr(10))) AS l FROM src),
ids AS (SELECT DISTINCT repo, unnest(regexp_extract_all(text, {Q.quote(C.CHECK_ID_PATTERN)}, 1)) AS id FROM src)
SELECT r.repo,
  (SELECT count(*) FROM homes h WHERE h.repo = r.repo AND NOT regexp_matches(u, {Q.quote(C.HOME_PLACEHOLDERS)})) AS home_paths,
  (SELECT count(*) FROM lines x WHERE x.repo = r.repo AND regexp_matches(l, 'shell:\\s*true') AND NOT regexp_matches(l, {Q.quote(C.SHELL_TRUE_QUOTED)}) AND NOT regexp_matches(l, '^\\s*(//|\\*)')) AS shell_true,
  (SELECT coalesce(sum(len(regexp_extract_all(l, '\\bold_[a-z]+\\b'))), 0)::BIGINT FROM lines x WHERE x.repo = r.repo AND NOT regexp_matches(l, 'new[_-]')) AS legacy_terms,
  (SELECT count(*) FROM ids i WHERE i.repo = r.repo) AS check_ids
FROM (SELECT DISTINCT repo FROM src) r
""")
def corpus_counters(t: Tables):
    return checks_text.count_patterns(t.derive(B.COUNTER_TEXTS), legacy=r"\bold_[a-z]+\b", alias="new[_-]")


@query("catalog_documents", "T6 T7 T8", f"""
SELECT doc_id, 'pack ' || lang AS name, CASE WHEN doc_id % 2 = 0 THEN 'Use for vercel deploys' ELSE 'Realtime chat of {{}}' END AS description,
  array_to_string(list_filter(['alpha', lang || ' build', CASE WHEN doc_id % 2 = 0 THEN 'vercel' END], lambda x: x IS NOT NULL), '|')
  || CASE WHEN doc_id % 2 = 0 THEN '|deploy|deployed' ELSE '|forum|topic|new topic|trending|chat|chatting|message|realtime|websocket' END AS positive_prompts,
  CASE WHEN doc_id % 2 = 0 THEN 'src/' || lang || '.ts|vercel.json|next.config.js|next.config.ts' ELSE 'src/' || lang || '.ts|package.json|webapp/package.json|services/*/package.json' END AS files,
  'pg|dep' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '|next|vercel' ELSE '|next|react|socket.io|ws|@nestjs/websockets' END AS dependencies,
  source AS requires
FROM documents
""".replace("{}", "rooms"))
def catalog_documents(t: Tables):
    docs = parsing.parse_catalog_docs(t.derive(B.CATALOG_DOCS))
    merged = docs.withColumn("meta", parsing.merge_meta(F.col("meta"), parsing.infer_meta(F.col("name"), F.col("description"))))
    joined = lambda f: F.array_join(F.col("meta")[f], "|").alias(f)
    return merged.select("doc_id", "name", "description", joined("positive_prompts"), joined("files"), joined("dependencies"), joined("requires"))


@query("workflow_documents", "T9", """
SELECT doc_id, 'flow-' || doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN 'Flow ' || doc_id ELSE 'Plan ' || lang END AS title,
  array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['tester'] ELSE [] END, list_filter({AGENTS}, lambda a: NOT (a = 'tester' AND doc_id % 2 = 0)
     AND (a = 'planner' OR (a = 'code-reviewer' AND doc_id % 2 = 1) OR regexp_matches(text, '(?i)\\b' || a || '\\b')))), ',') AS chain
FROM documents
""".replace("{AGENTS}", Q.str_list(C.AGENT_NAMES)))
def workflow_documents(t: Tables):
    parsed = parsing.parse_workflow_docs(t.derive(B.WORKFLOW_DOCS))
    return parsed.select("doc_id", "name", "title", F.array_join("chain", ",").alias("chain"))


@query("import_specifiers", "T10", """
WITH src AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS h FROM pages)
SELECT DISTINCT page_id, CASE WHEN length(h) % 2 = 0 THEN './x' || h ELSE '..' || h END AS specifier FROM src WHERE NOT contains(h, chr(39))
""")
def import_specifiers(t: Tables):
    return parsing.extract_imports(t.derive(B.PAGE_SOURCES))


@query("path_mentions", "T11", """
WITH m AS (SELECT conv_id * 100 + turn AS task_id, (conv_id * 7 + turn) % 50 AS k, conv_id % 3 AS c FROM conversations WHERE role = 'user')
SELECT task_id, 'path' AS kind, 'src/modules/m' || k || '/a.controller.ts' AS mention, 0 AS pos FROM m WHERE c = 0
UNION ALL SELECT task_id, 'file', 'a.controller.ts', 0 FROM m WHERE c = 0
UNION ALL SELECT task_id, 'path', 'lib/f' || k || '.ts', 0 FROM m WHERE c = 1
UNION ALL SELECT task_id, 'path', 'users/x', 1 FROM m WHERE c = 1
UNION ALL SELECT task_id, 'file', 'f' || k || '.ts', 0 FROM m WHERE c = 1
UNION ALL SELECT task_id, 'file', 'b.service.ts', 1 FROM m WHERE c = 1
UNION ALL SELECT task_id, 'path', 'src/modules/m' || k, 0 FROM m WHERE c = 2
""")
def path_mentions(t: Tables):
    return parsing.mentions(t.derive(B.MENTION_TASKS).select("task_id", "prompt"))


@query("identifiers_and_phrases", "T12", f"""
WITH d AS (SELECT doc_id, text, replace(text, '. ', '.') AS glued FROM documents),
ids AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(glued, '`([^`]+)`', 1),
   list_concat(regexp_extract_all(glued, '\\b[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+\\b', 0), regexp_extract_all(glued, '(?i)\\b[a-z0-9]+(?:[-_.][a-z0-9]+)+\\b', 0)))) AS term, 'identifier' AS kind FROM d),
terms AS (SELECT doc_id, {Q.graph_terms('text')} AS w FROM d),
pairs AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term, 'phrase' AS kind FROM terms)
SELECT doc_id, kind, term, count(*) AS n FROM (SELECT * FROM ids UNION ALL SELECT * FROM pairs) GROUP BY ALL
""")
def identifiers_and_phrases(t: Tables):
    glued = F.replace(F.col("text"), F.lit(". "), F.lit("."))
    tagged = lambda col, kind: F.transform(col, lambda v: F.struct(v.alias("term"), F.lit(kind).alias("kind")))
    every = F.concat(tagged(parsing.identifiers(glued), "identifier"), tagged(parsing.phrases(F.col("text")), "phrase"))
    rows = t.documents.select("doc_id", F.explode(every).alias("r")).select("doc_id", "r.kind", "r.term")
    return rows.groupBy("doc_id", "kind", "term").agg(F.count("*").alias("n"))


@query("file_search_text", "T13", """
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || 'UserService.spec.ts' AS path FROM pages)
SELECT page_id, path || ' ' || regexp_replace(regexp_replace(regexp_replace(path, '\\.[^.]+$', ''), '[._/-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g') AS text FROM p
""")
def file_search_text(t: Tables):
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("UserService.spec.ts"))
    return t.pages.select("page_id", paths.search_text(path).alias("text"))


@query("project_hint_tokens", "T16", f"""
SELECT DISTINCT repo, token FROM (SELECT c_nationkey::VARCHAR AS repo, unnest({Q.words("c_name || ' ' || c_mktsegment")}) AS token FROM customer)
""")
def project_hint_tokens(t: Tables):
    return parsing.hint_tokens(t.customer.withColumn("repo", F.col("c_nationkey").cast("string")), ["c_name", "c_mktsegment"])


@query("answer_ids", "T17", f"""
WITH words AS (SELECT conv_id * 100 + turn AS output_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_.@-]+')) AS w, generate_subscripts(regexp_split_to_array(text, '[^A-Za-z0-9_.@-]+'), 1) AS i FROM conversations),
keyed AS (SELECT output_id, regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') AS k, min(i) AS i FROM words GROUP BY ALL),
ids AS ({plain(B.ANSWER_IDS).replace('SPLIT', "unnest(string_split(text, ' '))")}),
hits AS (SELECT output_id, id, row_number() OVER (PARTITION BY output_id ORDER BY i, id) AS place FROM keyed JOIN ids ON regexp_replace(lower(id), '[^a-z0-9]+', '', 'g') = k WHERE k <> '')
SELECT output_id, id, CAST(place AS INTEGER) AS place FROM hits WHERE place <= 3
""")
def answer_ids(t: Tables):
    outputs = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("output_id"), "text")
    return parsing.ids_in_text(outputs, t.derive(B.ANSWER_IDS.replace("SPLIT", "explode(split(text, ' '))")))


@query("run_log_counts", "T18", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE 0 END AS failed, event_id AS passed FROM events WHERE event_id % 5 <> 0
""")
def run_log_counts(t: Tables):
    logs = t.derive(B.RUN_LOGS).select("event_id", parsing.log_counts(F.col("log")).alias("c"))
    return logs.where(F.col("c").isNotNull()).select("event_id", "c.failed", "c.passed")


@query("payload_signals", "T14", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'code-review-graph|query_graph' WHEN 1 THEN 'rtk' WHEN 2 THEN 'agentmemory' ELSE '' END AS signals,
  CASE event_id % 4 WHEN 0 THEN 'code-review-graph.query_graph' WHEN 1 THEN 'rtk run "' || user_id || '"' ELSE '' END AS tool_signals,
  CASE event_id % 4 WHEN 1 THEN 'rtk run "' || user_id || '"' ELSE '' END AS command_signals FROM events
""")
def payload_signals(t: Tables):
    found = parsing.extract_signals(t.derive(B.PAYLOADS))
    return found.select("event_id", *[F.array_join(c, "|").alias(c) for c in ("signals", "tool_signals", "command_signals")])


@query("tool_call_events", "T15", """
SELECT event_id, 'graph' AS server, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'unknown' END AS tool,
       'graph.' || CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'unknown' END AS tool_name FROM events WHERE event_type IN ('click', 'view')
""")
def tool_call_events(t: Tables):
    return parsing.tool_calls(t.derive(B.RPC_LINES), "graph")


@query("catalog_listing", "S14", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS u FROM pages)
SELECT page_id, 'n ' || u AS name, u AS url, 'about ' || u AS description FROM l WHERE NOT regexp_matches(u, '[()\\[\\]]')
""")
def catalog_listing(t: Tables):
    return listings.parse_listing(t.derive(B.LISTING_DOCS))
