"""Checks over code facts, and what happens to their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..operators import checks_facts, findings as fnd
from . import sql as Q
from .fact_bindings import BINDINGS, facts
from .registry import QUERIES, Tables, plain, query


def _ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({plain(BINDINGS[n])})" for n in names)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("repo", "id", "severity", "confidence", "file", "line", "evidence")


def _rows(check: str, severity: str, confidence: str, body: str, evidence: str, line: str = "line") -> str:
    sev = severity if " " in severity else f"'{severity}'"
    conf = confidence if " " in confidence else f"'{confidence}'"
    return f"SELECT repo, '{check}' AS id, {sev} AS severity, {conf} AS confidence, file, CAST({line} AS INTEGER) AS line, {evidence} AS evidence {body}"


_ROUTES = f"""
ctrl AS (SELECT repo, file, class, min(first_string) AS base FROM decorators WHERE owner_kind = 'class' AND name = 'Controller' GROUP BY ALL),
hnd AS (SELECT repo, class, member, file, line, name, first_string FROM (SELECT *, row_number() OVER (PARTITION BY repo, class, member, file ORDER BY line, name, first_string NULLS FIRST) AS k FROM decorators WHERE owner_kind = 'method' AND name IN {Q.in_list(C.HTTP_DECORATORS)}) WHERE k = 1),
routes AS (SELECT h.repo, h.class, h.member, h.file, h.line, h.name AS verb, coalesce(h.first_string, '') AS path, concat_ws('/', nullif(coalesce(base, ''), ''), nullif(coalesce(h.first_string, ''), '')) AS route FROM hnd h JOIN ctrl USING (repo, file, class))
"""


def _no(kind: str, cond: str, alias: str = "r") -> str:
    member = f" AND d.member = {alias}.member" if kind == "method" else ""
    return f"NOT EXISTS (SELECT 1 FROM decorators d WHERE d.repo = {alias}.repo AND d.file = {alias}.file AND d.class = {alias}.class{member} AND d.owner_kind = '{kind}' AND {cond})"


_MARKS = f"d.name IN {Q.in_list(['UseGuards', *C.PUBLIC_DECORATORS])}"
_THROTTLED = f"(d.name IN ('Throttle', 'RateLimit') OR (d.name = 'UseGuards' AND regexp_matches(d.arg_text, {Q.quote(C.RATE_LIMIT_GUARD_PATTERN)})))"
_SERIAL = "(d.name = 'SerializeOptions' OR (d.name = 'UseInterceptors' AND contains(d.arg_text, 'ClassSerializerInterceptor')))"


@query("route_findings", "D3 D4 D7", _ctes("decorators", "params", "members") + "," + _ROUTES + "\nUNION ALL\n".join([
    _rows("SEC-002", "CASE WHEN verb = 'Get' THEN 'MEDIUM' ELSE 'HIGH' END", "CASE WHEN verb = 'Get' THEN 'low' ELSE 'high' END",
          f"FROM routes r WHERE {_no('class', _MARKS)} AND {_no('method', _MARKS)} AND NOT regexp_matches(route, {Q.quote(C.PUBLIC_ROUTE_PATTERN)}) AND NOT regexp_matches(member, {Q.quote(C.PUBLIC_ROUTE_PATTERN)})", "member"),
    _rows("SEC-007", "MEDIUM", "medium",
          f"FROM routes r WHERE verb <> 'Get' AND (regexp_matches(path, {Q.quote(C.AUTH_ROUTE_PATTERN)}) OR regexp_matches(member, {Q.quote(C.AUTH_ROUTE_PATTERN)})) AND {_no('class', _THROTTLED)} AND {_no('method', _THROTTLED)}", "member"),
    _rows("SEC-004", "MEDIUM", "CASE WHEN is_any OR type_name IS NULL THEN 'certain' ELSE 'high' END", f"""FROM params p WHERE EXISTS (SELECT 1 FROM routes r WHERE r.repo = p.repo AND r.file = p.file AND r.class = p.class AND r.member = p.member)
      AND EXISTS (SELECT 1 FROM decorators d WHERE d.repo = p.repo AND d.file = p.file AND d.class = p.class AND d.member = p.member AND d.param = p.param AND d.owner_kind = 'param' AND d.name = 'Body')
      AND (is_any OR type_name IS NULL OR (EXISTS (SELECT 1 FROM members m WHERE m.repo = p.repo AND m.class = p.type_name AND m.kind = 'property')
        AND NOT EXISTS (SELECT 1 FROM decorators d WHERE d.repo = p.repo AND d.class = p.type_name AND d.owner_kind = 'property' AND regexp_matches(d.name, {Q.quote(C.VALIDATOR_PATTERN)}))))""",
          "CASE WHEN is_any OR type_name IS NULL THEN param ELSE type_name END"),
]))
def route_findings(t: Tables):
    f = facts(t)
    return _shown(checks_facts.union([
        checks_facts.check_missing_guards(f["decorators"]), checks_facts.check_unthrottled(f["decorators"]),
        checks_facts.check_unvalidated_body(f["decorators"], f["params"], f["members"]),
    ]))


_ENTITY_CTES = f"""
fields AS (SELECT DISTINCT repo, class, member AS field, type_arg AS entity FROM members WHERE kind = 'ctor_param' AND type_name IN {Q.in_list(C.REPOSITORY_TYPES)}),
ment AS (SELECT repo, class, member, arg_min(entity, line) AS entity FROM returns JOIN fields f USING (repo, class) WHERE f.field = via_field AND via_method IN {Q.in_list([*C.ENTITY_READ_METHODS, 'save'])} AND entity IS NOT NULL GROUP BY ALL),
cols AS (SELECT DISTINCT repo, class AS entity, member AS col FROM members m WHERE kind = 'property' AND (regexp_matches(member, {Q.quote(C.SENSITIVE_COLUMN_PATTERN)}) OR lower(member) IN {Q.in_list(C.SENSITIVE_EXACT_NAMES)})
   AND EXISTS (SELECT 1 FROM decorators d WHERE d.repo = m.repo AND d.file = m.file AND d.class = m.class AND d.owner_kind = 'class' AND d.name IN ('Entity', 'ViewEntity'))
   AND NOT EXISTS (SELECT 1 FROM decorators d WHERE d.repo = m.repo AND d.file = m.file AND d.class = m.class AND d.member = m.member AND d.owner_kind = 'property' AND d.name = 'Exclude'))
"""


@query("entity_facts", "D1 P8", _ctes("members", "decorators", "returns") + "," + _ENTITY_CTES + """
SELECT repo, 'column' AS kind, entity || '.' || col AS name FROM cols UNION ALL SELECT repo, 'method', class || '.' || member || '>' || entity FROM ment
""")
def entity_facts(t: Tables):
    f = facts(t)
    cols = checks_facts.entity_columns(f["decorators"], f["members"]).select("repo", F.lit("column").alias("kind"), F.concat_ws(".", "entity", "column").alias("name"))
    methods = checks_facts.method_entities(f["returns"], f["members"])
    return cols.unionByName(methods.select("repo", F.lit("method").alias("kind"), F.concat("class", F.lit("."), "member", F.lit(">"), "entity").alias("name")))


@query("exposed_entity_findings", "D2", _ctes("members", "decorators", "returns") + "," + _ENTITY_CTES + "," + _ROUTES + ", svc AS (SELECT DISTINCT repo, file, class, member AS via_field, type_name AS service FROM members WHERE kind = 'ctor_param') "
       + _rows("SEC-001", "HIGH", "medium", f"""FROM (SELECT r.*, s.service FROM returns r JOIN svc s ON s.repo = r.repo AND s.file = r.file AND s.class = r.class AND s.via_field = r.via_field
  JOIN ment m ON m.repo = r.repo AND m.class = s.service AND m.member = r.via_method WHERE EXISTS (SELECT 1 FROM cols c WHERE c.repo = r.repo AND c.entity = m.entity)
  AND EXISTS (SELECT 1 FROM routes x WHERE x.repo = r.repo AND x.file = r.file AND x.class = r.class AND x.member = r.member)
  AND NOT EXISTS (SELECT 1 FROM members d WHERE d.repo = r.repo AND d.file = r.file AND d.class = r.class AND d.member = r.member AND d.kind = 'method' AND regexp_matches(d.return_type_text, 'Dto\\b'))
  AND {_no('class', _SERIAL)} AND {_no('method', _SERIAL)}) q""", "class || '.' || member"))
def exposed_entity_findings(t: Tables):
    f = facts(t)
    return _shown(checks_facts.check_exposed_entity(f["decorators"], f["members"], f["returns"]))


_IN_HANDLER = "EXISTS (SELECT 1 FROM routes r WHERE r.repo = c.repo AND r.file = c.file AND r.class = c.class AND r.member = c.member)"


@query("expression_findings", "D5 D6 D8 D9", _ctes("catch_props", "object_props", "calls", "decorators", "functions") + "," + _ROUTES + """
, ob AS (SELECT repo, file, object_id, min(line) AS line, max(CASE WHEN prop = 'origin' THEN trim(value_text) END) AS origin, max(CASE WHEN prop = 'credentials' THEN value_text END) AS cred FROM object_props WHERE prop IN ('origin', 'credentials') GROUP BY ALL)
""" + "\nUNION ALL\n".join([
    _rows("SEC-005", "MEDIUM", "high", "FROM catch_props WHERE prop IN ('stack', 'message') AND value_text = catch_var || '.' || prop", "value_text"),
    _rows("SEC-006", "HIGH", "certain", "FROM ob WHERE cred = 'true' AND origin IN ('\"*\"', 'true')", "origin"),
    _rows("SEC-008", "HIGH", "high", f"FROM calls c WHERE method IN {Q.in_list(C.SHELL_FUNCTIONS)} AND arg0_kind <> 'string' AND (method IN ('exec', 'execSync') OR shell_true)", "arg0_text"),
    _rows("SEC-009", "HIGH", "medium", f"""FROM calls c WHERE method IN {Q.in_list(C.FS_PATH_FUNCTIONS)} AND {_IN_HANDLER}
      AND EXISTS (SELECT 1 FROM decorators d WHERE d.repo = c.repo AND d.file = c.file AND d.class = c.class AND d.member = c.member AND d.owner_kind = 'param' AND d.name IN ('Param', 'Query', 'Body') AND regexp_matches(arg0_text, '\\b' || d.param || '\\b'))
      AND NOT EXISTS (SELECT 1 FROM functions f WHERE f.repo = c.repo AND f.fn_id = c.fn_id AND regexp_matches(body_text, {Q.quote(C.PATH_SANITIZER_PATTERN)}))""", "arg0_text"),
]))
def expression_findings(t: Tables):
    f = facts(t)
    return _shown(checks_facts.union([
        checks_facts.check_error_exposure(f["catch_props"]), checks_facts.check_cors(f["object_props"]), checks_facts.check_shell(f["calls"]),
        checks_facts.check_request_path(f["decorators"], f["calls"], f["functions"]),
    ]))


_REPO_CALLS = f"""
rc AS (SELECT * FROM (SELECT c.*, CASE WHEN root_this AND field IS NOT NULL AND (EXISTS (SELECT 1 FROM members m WHERE m.repo = c.repo AND m.class = c.class AND m.member = c.field AND m.kind = 'ctor_param' AND m.type_name IN {Q.in_list(C.REPOSITORY_TYPES)}) OR regexp_matches(field, 'repo(sitory)?$', 'i')) THEN field
   WHEN root_this AND field IS NULL AND EXISTS (SELECT 1 FROM classes k WHERE k.repo = c.repo AND k.class = c.class AND k.base_class IN {Q.in_list(C.REPOSITORY_TYPES)}) THEN 'this'
   WHEN NOT root_this AND regexp_matches(base_text, '^\\w+$') AND regexp_matches(base_text, 'repo(sitory)?$', 'i') THEN base_text END AS target FROM calls c) WHERE target IS NOT NULL)
"""


def _many_writes(source: str, methods, transaction: str) -> str:
    return f"""FROM (SELECT repo, fn_id, count(*) AS n, min({{'line': line, 'file': file, 'col': col}}) AS s FROM {source} WHERE method IN {Q.in_list(methods)} GROUP BY ALL HAVING count(*) >= 2) w, LATERAL (SELECT s.line AS line, s.file AS file) x
  WHERE NOT EXISTS (SELECT 1 FROM functions f WHERE f.repo = w.repo AND f.fn_id = w.fn_id AND regexp_matches(body_text, {Q.quote(transaction)}))"""


def _no_opt(*keys: str) -> str:
    return f"NOT list_has_any(string_split(opts, ','), {Q.str_list(keys)})"


@query("repository_findings", "D10 D11 D12", _ctes("calls", "members", "classes", "functions") + "," + _REPO_CALLS + "\nUNION ALL\n".join([
    _rows("TORM-001", "MEDIUM", "certain", f"FROM rc WHERE method IN ('find', 'findBy') AND arg0_kind <> 'function' AND {_no_opt('take', 'skip', 'cursor', 'limit')}", "target || '.' || method"),
    _rows("TORM-002", "HIGH", "high", f"FROM rc WHERE method IN {Q.in_list(C.REPO_READ_METHODS)} AND loop_depth > 0", "target || '.' || method"),
    _rows("TORM-003", "MEDIUM", "medium", _many_writes("rc", C.REPO_WRITE_METHODS, r"(?i)\.transaction\s*\(|queryRunner|manager\s*\.\s*(save|remove|insert|update)"), "n || ' writes'"),
]))
def repository_findings(t: Tables):
    f = facts(t)
    return _shown(checks_facts.check_repository_calls(f["calls"], f["members"], f["classes"], f["functions"]))


@query("entity_findings", "D13 D14", _ctes("decorators") + """
, ent AS (SELECT DISTINCT repo, file, class FROM decorators WHERE owner_kind = 'class' AND name IN ('Entity', 'ViewEntity')),
pr AS (SELECT d.* FROM decorators d JOIN ent USING (repo, file, class) WHERE owner_kind = 'property'),
per AS (SELECT repo, class, member, file, min(line) AS line, bool_or(name = 'ManyToOne') AS rel, bool_or(name = 'Column') AS col, bool_or(name IN ('Index', 'PrimaryColumn', 'PrimaryGeneratedColumn', 'Unique')) AS ix, bool_or(contains(trues, 'unique')) AS uq FROM pr GROUP BY ALL),
bare AS (SELECT * FROM per p WHERE NOT ix AND NOT uq AND NOT EXISTS (SELECT 1 FROM decorators d WHERE d.repo = p.repo AND d.file = p.file AND d.class = p.class AND d.owner_kind = 'class' AND d.name = 'Index' AND contains(d.arg_text, '"' || p.member || '"')))
""" + "\nUNION ALL\n".join([
    _rows("TORM-004", "MEDIUM", "certain", f"FROM (SELECT repo, class, member, file, min(line) AS line FROM pr WHERE name IN {Q.in_list(C.RELATION_DECORATORS)} AND contains(trues, 'eager') GROUP BY ALL)", "class || '.' || member"),
    _rows("TORM-005", "MEDIUM", "high", "FROM bare WHERE rel", "class || '.' || member"),
    _rows("TORM-005", "LOW", "low", f"FROM bare WHERE NOT rel AND col AND regexp_matches(member, {Q.quote(C.LOOKUP_COLUMN_PATTERN)}) AND lower(member) <> 'id'", "class || '.' || member"),
]))
def entity_findings(t: Tables):
    return _shown(checks_facts.check_entities(facts(t)["decorators"]))


@query("query_text_findings", "D15 D16 D17", _ctes("calls", "object_props", "constants") + """
, tp AS (SELECT *, unnest(regexp_extract_all(arg0_text, '\\$\\{([^}]*)\\}', 1)) AS sp FROM calls WHERE arg0_kind = 'template' AND method IN ('query', 'where', 'andWhere', 'orWhere', 'having')),
un AS (SELECT DISTINCT repo, file, line, col, arg0_text, method FROM tp WHERE NOT (regexp_matches(sp, '^[A-Za-z_$][A-Za-z0-9_$]*(\\.[A-Za-z0-9_$]+)*$') AND EXISTS (SELECT 1 FROM constants k WHERE k.repo = tp.repo AND k.file = tp.file AND k.name = regexp_extract(sp, '^[A-Za-z_$][A-Za-z0-9_$]*'))))
""" + "\nUNION ALL\n".join([
    _rows("TORM-006", "MEDIUM", "high", "FROM calls WHERE method IN ('getMany', 'getRawMany') AND contains(base_text, 'createQueryBuilder(') AND NOT regexp_matches(base_text, '\\.(take|limit|skip|offset)\\s*\\(')", "base_text"),
    _rows("TORM-007", "HIGH", "certain", "FROM object_props WHERE prop = 'synchronize' AND value_text = 'true'", "prop"),
    _rows("TORM-008", "CRITICAL", "high", "FROM calls WHERE arg0_kind = 'concat' AND contains(arg0_text, '\"') AND method IN ('query', 'where', 'andWhere', 'orWhere', 'having')", "arg0_text"),
    _rows("TORM-008", "CRITICAL", "high", "FROM un", "arg0_text"),
]))
def query_text_findings(t: Tables):
    f = facts(t)
    return _shown(checks_facts.union([
        checks_facts.check_query_builder(f["calls"]), checks_facts.check_synchronize(f["object_props"]), checks_facts.check_interpolated_sql(f["calls"], f["constants"]),
    ]))


@query("client_findings", "D11 D12 D18", _ctes("calls", "members", "classes", "functions") + f"""
, pc AS (SELECT c.* FROM calls c WHERE (root_this AND (EXISTS (SELECT 1 FROM members m WHERE m.repo = c.repo AND m.class = c.class AND m.member = c.field AND m.kind = 'ctor_param' AND regexp_matches(m.type_name, {Q.quote(C.PRISMA_TYPE_PATTERN)}))
   OR (field IS NOT NULL AND EXISTS (SELECT 1 FROM classes k WHERE k.repo = c.repo AND k.class = c.class AND regexp_matches(k.base_class, {Q.quote(C.PRISMA_TYPE_PATTERN)}))))) OR regexp_matches(callee_path, '(^|\\.)prisma(\\.|$)', 'i'))
""" + "\nUNION ALL\n".join([
    _rows("PRISMA-010", "MEDIUM", "certain", f"FROM pc WHERE method = 'findMany' AND {_no_opt('take', 'cursor')}", "callee_path"),
    _rows("PRISMA-011", "HIGH", "high", f"FROM pc WHERE method IN {Q.in_list(C.PRISMA_READ_METHODS)} AND loop_depth > 0", "callee_path"),
    _rows("PRISMA-012", "MEDIUM", "medium", f"FROM pc WHERE method IN {Q.in_list(C.PRISMA_READ_METHODS)} AND include_depth >= 2 AND {_no_opt('select')}", "callee_path"),
    _rows("PRISMA-013", "HIGH", "certain", f"FROM calls WHERE method IN {Q.in_list(C.PRISMA_RAW_METHODS)}", "callee_path"),
    _rows("PRISMA-014", "MEDIUM", "medium", _many_writes("pc", C.PRISMA_WRITE_METHODS, r"\$transaction\s*\(|\btx\s*\."), "n || ' writes'"),
]))
def client_findings(t: Tables):
    f = facts(t)
    return _shown(checks_facts.prisma(f))


@query("postgres_findings", "D19", _ctes("calls", "strings") + " " + "\nUNION ALL\n".join([
    _rows("PG-010", "MEDIUM", "high", f"FROM calls WHERE method = 'Pool' AND callee_path = 'new Pool' AND {_no_opt(*C.POOL_LIMIT_KEYS)}", "callee_path"),
    _rows("PG-011", "LOW", "medium", f"FROM calls WHERE method = 'Pool' AND callee_path = 'new Pool' AND NOT {_no_opt(*C.POOL_LIMIT_KEYS)} AND {_no_opt('idleTimeoutMillis')}", "callee_path"),
    _rows("PG-012", "CRITICAL", "CASE WHEN build = 'concat' THEN 'high' ELSE 'medium' END", "FROM strings WHERE build IN ('concat', 'template') AND regexp_matches(value, '\\b(select|insert\\s+into|update|delete\\s+from)\\b', 'i') AND regexp_matches(value, '\\bwhere\\b', 'i')", "value"),
]))
def postgres_findings(t: Tables):
    return _shown(checks_facts.postgresql(facts(t)))


@query("performance_findings", "D20", _ctes("calls", "decorators", "loops") + "," + _ROUTES + "\nUNION ALL\n".join([
    _rows("PERF-001", "HIGH", "high", f"FROM calls WHERE loop_depth > 0 AND CASE WHEN base_text IS NULL AND NOT root_this THEN method = 'fetch' ELSE method IN {Q.in_list(C.NETWORK_CALLS)} AND regexp_matches(coalesce(base_text, ''), {Q.quote(C.NETWORK_BASE_PATTERN)}) END", "concat_ws('.', base_text, method)"),
    _rows("PERF-002", f"CASE WHEN method IN {Q.in_list(C.CRYPTO_SYNC_CALLS)} THEN 'HIGH' ELSE 'MEDIUM' END", "high", f"FROM calls c WHERE method IN {Q.in_list(C.CRYPTO_SYNC_CALLS + C.SYNC_FS_CALLS)} AND {_IN_HANDLER}", "method"),
    _rows("PERF-003", "MEDIUM", "low", f"FROM loops WHERE kind IN ('for', 'for-of') AND await_count > 0 AND NOT regexp_matches(body_text, {Q.quote(C.SEQUENTIAL_LOOP_PATTERN)})", "kind", "start_line"),
    _rows("PERF-004", "MEDIUM", "medium", f"FROM calls WHERE base_text = 'Promise' AND method = 'all' AND arg0_kind = 'map' AND NOT regexp_matches(coalesce(field, ''), {Q.quote(C.BOUNDED_MAP_PATTERN)}) AND regexp_matches(arg0_text, {Q.quote(C.IO_BODY_PATTERN)})", "arg0_text"),
]))
def performance_findings(t: Tables):
    return _shown(checks_facts.performance(facts(t)))


@query("scalability_findings", "D21", _ctes("members", "decorators", "calls", "sources") + f"""
, held AS (SELECT * FROM members WHERE ((init_kind = 'new' AND init_ctor IN {Q.in_list(C.MUTABLE_CONTAINERS)}) OR init_kind IN ('array', 'empty_object')) AND regexp_matches(member, {Q.quote(C.STATEFUL_NAME_PATTERN)}))
""" + "\nUNION ALL\n".join([
    _rows("SCALE-001", "MEDIUM", "medium", "FROM held h WHERE kind = 'variable' OR (kind = 'property' AND EXISTS (SELECT 1 FROM decorators d WHERE d.repo = h.repo AND d.file = h.file AND d.class = h.class AND d.owner_kind = 'class' AND d.name = 'Injectable'))", "concat_ws('.', class, member)"),
    _rows("SCALE-002", "MEDIUM", "high", "FROM calls c WHERE method = 'forRoot' AND regexp_matches(base_text, 'Throttler', 'i') AND EXISTS (SELECT 1 FROM sources s WHERE s.repo = c.repo AND s.file = c.file AND regexp_matches(text, 'throttl|rate ?limit', 'i') AND NOT regexp_matches(text, 'redis|memcach|storage\\s*:|ThrottlerStorage', 'i'))", "base_text"),
    _rows("SCALE-003", "MEDIUM", "medium", f"FROM calls WHERE method IN {Q.in_list(C.LOCAL_WRITE_CALLS)} AND base_text IS NOT NULL AND NOT regexp_matches(arg0_text, {Q.quote(C.TEMP_TARGET_PATTERN)}) AND regexp_matches(arg0_text, {Q.quote(C.USER_CONTENT_PATTERN)})", "arg0_text"),
    _rows("SCALE-004", "MEDIUM", "medium", f"FROM (SELECT repo, class, member, file, min(line) AS line FROM decorators WHERE owner_kind = 'method' AND name IN {Q.in_list(C.JOB_DECORATORS)} GROUP BY ALL) d WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.repo = d.repo AND s.file = d.file AND regexp_matches(text, {Q.quote(C.JOB_COORDINATION_PATTERN)}))", "member"),
    _rows("SCALE-005", "HIGH", "high", f"FROM calls WHERE method = 'session' AND base_text IS NULL AND NOT root_this AND {_no_opt('store')}", "method"),
]))
def scalability_findings(t: Tables):
    return _shown(checks_facts.scalability(facts(t)))


# --- findings of order lines: priority is the severity, return flag the confidence

FINDINGS = """
SELECT l_suppkey AS repo, 'CHK-' || CAST(l_partkey % 7 AS VARCHAR(20)) AS id, CASE l_partkey % 3 WHEN 0 THEN 'Security' WHEN 1 THEN 'Database' ELSE 'Scalability' END AS category,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE l_returnflag WHEN 'A' THEN 'certain' WHEN 'N' THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN l_linenumber % 2 = 0 THEN 'prisma' ELSE 'typeorm' END AS analyzer,
  'title' AS title, 'detail ' || l_returnflag AS detail, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) AS evidence,
  'f' || CAST(l_partkey % 20 AS VARCHAR(20)) || '.ts' AS file, CAST(l_orderkey % 300 AS INT) AS line, CAST(0 AS INT) AS col, l_quantity > 40 AS ranged, CAST(l_orderkey % 300 + l_quantity - 40 AS INT) AS end_line
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
_SW, _CW = Q.weight("severity", C.SEVERITY_WEIGHT), Q.weight("confidence", C.CONFIDENCE_WEIGHT)
_FINDING_SQL = f"WITH f AS (SELECT *, {_SW} AS sw, {_CW} AS cw FROM ({plain(FINDINGS)}))"


def findings(t: Tables) -> DataFrame:
    df = t.derive(FINDINGS)
    span = F.when(F.col("ranged"), F.struct(F.col("line").alias("start_line"), F.col("end_line").alias("end_line")))
    return df.withColumn("superseded", span).drop("ranged", "end_line")


@query("threshold_findings", "P3", _FINDING_SQL + " SELECT repo, count(*) AS n FROM f WHERE sw >= 4 AND cw >= 3 GROUP BY repo")
def threshold_findings(t: Tables):
    return fnd.at_least(findings(t), "HIGH", "high").groupBy("repo").agg(F.count("*").alias("n"))


@query("selected_findings", "P4", _FINDING_SQL + """
SELECT repo, count(*) FILTER (WHERE category = 'Security' AND sw >= 3) AS shown, count(*) FILTER (WHERE NOT (category = 'Security' AND sw >= 3)) AS hidden FROM f WHERE analyzer = 'prisma' GROUP BY repo
""")
def selected_findings(t: Tables):
    shown, hidden = fnd.select_findings(findings(t), ["security"], ["prisma"], "MEDIUM")
    counts = shown.groupBy("repo").agg(F.count("*").alias("shown"))
    return hidden.join(counts, "repo", "left").select("repo", F.coalesce("shown", F.lit(0)).alias("shown"), "hidden")


@query("gated_repositories", "P5", _FINDING_SQL + """
SELECT repo, NOT bool_or(sw >= 5) AS passed, NOT bool_or(sw >= 4 AND analyzer = 'prisma' AND line < 5) AS change_passed FROM f GROUP BY repo
""")
def gated_repositories(t: Tables):
    df = findings(t)
    items = df.withColumn("structural", (F.col("analyzer") == "prisma") & (F.col("line") < 5))
    return fnd.gate(df, "CRITICAL").join(fnd.gate(items, "HIGH", True).withColumnRenamed("passed", "change_passed"), "repo")


@query("changed_file_findings", "P6", _FINDING_SQL + """
SELECT repo, file, count(*) AS n FROM f WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = f.repo AND 'f' || s.s_nationkey || '.ts' = f.file) GROUP BY ALL
""")
def changed_file_findings(t: Tables):
    changed = t.supplier.select(F.col("s_suppkey").alias("repo"), F.concat(F.lit("f"), F.col("s_nationkey").cast("string"), F.lit(".ts")).alias("file"))
    return fnd.scope(findings(t), changed).groupBy("repo", "file").agg(F.count("*").alias("n"))


_KEPT_SQL = _FINDING_SQL + """
, kept AS (SELECT * FROM f WHERE NOT ranged OR NOT EXISTS (SELECT 1 FROM f s WHERE NOT s.ranged AND s.cw >= 3 AND s.repo = f.repo AND s.file = f.file AND s.line BETWEEN f.line AND f.end_line)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, line, id ORDER BY sw DESC, cw DESC, title, evidence, col) AS k FROM kept) WHERE k = 1)
"""


@query("suppressed_findings", "J10", _KEPT_SQL + "SELECT repo, file, id, line, evidence FROM kept")
def suppressed_findings(t: Tables):
    return fnd.suppress(findings(t)).select("repo", "file", "id", "line", "evidence")


@query("deduplicated_findings", "A8 J10 K9", _KEPT_SQL + "SELECT repo, file, id, line, severity, confidence, evidence FROM best")
def deduplicated_findings(t: Tables):
    return fnd.order_findings(fnd.dedupe_findings(findings(t))).select("repo", "file", "id", "line", "severity", "confidence", "evidence")


@query("finding_summary", "A9", _KEPT_SQL + "SELECT repo, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in C.SEVERITIES) + " FROM best GROUP BY repo")
def finding_summary(t: Tables):
    return fnd.summarise(fnd.dedupe_findings(findings(t)))


@query("registry_findings", "X1 P7", f"""
WITH calls AS ({plain(BINDINGS['calls'])}), props AS ({plain(BINDINGS['object_props'])})
SELECT repo, id, count(*) AS n FROM (
  SELECT repo, 'TORM-006' AS id FROM calls WHERE repo % 2 = 0 AND method IN ('getMany', 'getRawMany') AND contains(base_text, 'createQueryBuilder(') AND NOT contains(base_text, '.limit(')
  UNION ALL SELECT repo, 'TORM-007' FROM props WHERE prop = 'synchronize' AND value_text = 'true') GROUP BY ALL
""")
def registry_findings(t: Tables):
    f = facts(t)
    registry = fnd.Registry()
    registry.register("builder", lambda x: checks_facts.check_query_builder(x["calls"]), "typeorm")
    registry.register("config", lambda x: checks_facts.check_synchronize(x["object_props"]))
    registry.register("broken", lambda x: x["missing"])
    registry.register("failing", lambda x: checks_facts.check_query_builder(x["calls"]).withColumn("line", F.raise_error(F.lit("fails on every row")).cast("int")))
    platforms = t.part.where("p_partkey % 11 % 2 = 0").select((F.col("p_partkey") % 11).alias("repo"), F.lit("typeorm").alias("platform")).distinct()
    found, _, errors = registry.run(f, platforms)
    if set(errors) != {"broken", "failing"}:
        raise ValueError(errors)
    return found.groupBy("repo", "id").agg(F.count("*").alias("n"))


_FAMILIES = {
    "security": ["route_findings", "exposed_entity_findings", "expression_findings"], "typeorm": ["repository_findings", "entity_findings", "query_text_findings"],
    "prisma": ["client_findings"], "postgresql": ["postgres_findings"], "performance": ["performance_findings"], "scalability": ["scalability_findings"],
}


def _all_families() -> str:
    """The rows of all checks; a family with a technology of its own judges even repositories only."""
    parts = []
    for family, names in _FAMILIES.items():
        gate = " WHERE repo % 2 = 0" if family in ("typeorm", "prisma", "postgresql") else ""
        parts += [f"SELECT repo, file, line, id, severity FROM ({QUERIES[name].sql}){gate}" for name in names]
    return "\nUNION ALL\n".join(parts)


@query("repository_reports", "X1", f"""
WITH f AS ({_all_families()}),
d AS (SELECT repo, file, line, id, max(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END) AS w FROM f GROUP BY ALL)
SELECT repo, id, count(*) AS places, count(*) FILTER (WHERE w >= 4) AS grave FROM d GROUP BY ALL
""")
def repository_reports(t: Tables):
    """From the facts of repositories to their findings: every family of checks, gated by technology, one finding for each place."""
    registry = fnd.Registry()
    checks_facts.register_all(registry)
    repos = t.part.select((F.col("p_partkey") % 11).alias("repo")).distinct().where("repo % 2 = 0")
    platforms = repos.select("repo", F.explode(F.array(*[F.lit(p) for p in sorted({v for v in C.FAMILY_PLATFORMS.values() if v})])).alias("platform"))
    found, _, errors = registry.run(facts(t), platforms)
    if errors:
        raise ValueError(errors)
    worst = F.max(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 1).otherwise(0))
    places = found.groupBy("repo", "file", "line", "id").agg(worst.alias("grave"))
    return places.groupBy("repo", "id").agg(F.count("*").alias("places"), F.sum("grave").alias("grave"))
