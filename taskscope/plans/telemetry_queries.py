"""Events as prompts, stops and tool calls: batch and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry
from ..sources import corpus, diffs, index, manifests, rules as rule_sources
from ..streaming import events as ev, gates
from . import bindings as B
from .. import constants as C
from .registry import Tables, instants, plain, query

_PROMPTS = "SELECT user_id AS workspace, event_id AS prompt_id, ts FROM {events} WHERE event_type = 'view'"
_STOPS = "SELECT user_id AS workspace, event_id AS stop_id, ts FROM {events} WHERE event_type = 'purchase'"


@query("attributed_stops", "J12", """
SELECT s.workspace, s.stop_id, p.prompt_id FROM (SELECT user_id AS workspace, event_id AS stop_id, ts FROM events WHERE event_type = 'purchase') s
ASOF LEFT JOIN (SELECT user_id AS workspace, event_id AS prompt_id, ts FROM events WHERE event_type = 'view') p ON s.workspace = p.workspace AND s.ts >= p.ts
""")
def attributed_stops(t: Tables):
    return telemetry.attribute(t.derive(_STOPS), t.derive(_PROMPTS)).select("workspace", "stop_id", "prompt_id")


_EVENTS = """
SELECT user_id % 3 AS log, CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS BIGINT) ELSE user_id END AS workspace, event_id, ts, event_type AS event, CASE event_id % 4 WHEN 0 THEN 'rtk' WHEN 1 THEN 'query_graph' ELSE '' END AS sig FROM {events} WHERE event_type NOT IN ('view', 'purchase')
"""
_LOG_STOPS = """
SELECT user_id % 3 AS log, user_id AS workspace, event_id AS stop_id, ts, CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE ts - INTERVAL 3 DAYS END AS since FROM {events} WHERE event_type = 'purchase'
"""
_WHOLE_SQL = f"""
WITH e AS ({plain(_EVENTS)}), s AS ({plain(_LOG_STOPS)}),
p AS (SELECT s.stop_id, e.* FROM s JOIN e ON e.log = s.log AND e.ts <= s.ts WHERE (e.workspace IS NULL OR e.workspace = s.workspace) AND (s.since IS NULL OR e.ts >= s.since))
"""


@query("evidence_pairs", "J13", _WHOLE_SQL + "SELECT stop_id, event_id FROM p")
def evidence_pairs(t: Tables):
    return telemetry.evidence_window(t.derive(_LOG_STOPS), t.derive(_EVENTS)).select("stop_id", "event_id")


_STOP_EVIDENCE_SQL = _WHOLE_SQL + """
, g AS (SELECT stop_id, sig, min((ts, event_id)) AS pos FROM p WHERE sig <> '' GROUP BY ALL), a AS (SELECT stop_id, string_agg(sig, '|' ORDER BY pos) AS signals FROM g GROUP BY stop_id),
c AS (SELECT stop_id, count(*) AS sources FROM p WHERE sig <> '' GROUP BY stop_id)
"""


@query("stop_evidence", "J13 U5", _STOP_EVIDENCE_SQL + """
, n AS (SELECT stop_id, event, row_number() OVER (PARTITION BY stop_id ORDER BY ts, event_id) AS k FROM p WHERE sig <> ''), f AS (SELECT stop_id, string_agg(event, '|' ORDER BY k) AS names FROM n WHERE k <= 20 GROUP BY stop_id)
SELECT s.stop_id, coalesce(a.signals, '') AS signals, coalesce(sources, 0) AS sources, coalesce(names, '') AS names FROM s LEFT JOIN a USING (stop_id) LEFT JOIN c USING (stop_id) LEFT JOIN f USING (stop_id)
""")
def stop_evidence(t: Tables):
    return _stop_evidence(t).withColumn("names", F.array_join("names", "|"))


def _stop_evidence(t: Tables):
    none = F.array().cast("array<string>")
    events = t.derive(_EVENTS).withColumn("signals", F.when(F.col("sig") != "", F.array("sig")).otherwise(none))
    events = events.withColumn("tool_signals", none).withColumn("command_signals", none)
    out = telemetry.runtime_evidence(t.derive(_LOG_STOPS), events)
    from ..operators.compliance import runtime_summary

    united = runtime_summary(F.col("tool_signals"), F.col("command_signals"), F.col("signals"))
    return out.select("stop_id", F.array_join(united, "|").alias("signals"), F.col("n_sources").alias("sources"), F.col("sources").alias("names"))


@query("whole_evidence_pairs", "J13", _WHOLE_SQL + "SELECT stop_id, event_id FROM p")
def whole_evidence_pairs(t: Tables):
    return telemetry.evidence_window(t.derive(_LOG_STOPS), t.derive(_EVENTS)).select("stop_id", "event_id")


@query("whole_stop_evidence", "J13 U5", _STOP_EVIDENCE_SQL + """
SELECT s.stop_id, coalesce(a.signals, '') AS signals, coalesce(sources, 0) AS sources FROM s LEFT JOIN a USING (stop_id) LEFT JOIN c USING (stop_id)
""")
def whole_stop_evidence(t: Tables):
    return _stop_evidence(t).drop("names")


@query("workspace_stats", "A10", """
WITH p AS (SELECT user_id AS workspace, count(*) AS prompts, count(*) FILTER (WHERE value > 10) AS injected, round(avg(event_id % 100))::BIGINT AS mean_ms, arg_max(props, (ts, props)) AS last_prompt FROM events WHERE event_type = 'view' GROUP BY 1),
r AS (SELECT user_id AS workspace, count(*) AS reports, round(avg(CASE WHEN event_id % 4 > 0 THEN event_id % 101 END))::BIGINT AS mean_efficiency, sum(event_id % 5)::BIGINT AS followed, sum(event_id % 3)::BIGINT AS ignored FROM events WHERE event_type = 'purchase' GROUP BY 1),
e AS (SELECT user_id AS workspace, count(*) AS events, count(DISTINCT event_type) AS event_names FROM events GROUP BY 1)
SELECT workspace, coalesce(prompts, 0) AS prompts, coalesce(injected, 0) AS injected, mean_ms, last_prompt, coalesce(reports, 0) AS reports, mean_efficiency, coalesce(followed, 0) AS followed, coalesce(ignored, 0) AS ignored,
  events, event_names, coalesce(round(100 * injected / prompts)::BIGINT, 0) AS injection_rate, coalesce(prompts - injected, 0) AS quiet FROM e LEFT JOIN p USING (workspace) LEFT JOIN r USING (workspace)
""")
def workspace_stats(t: Tables):
    e = t.events.withColumnRenamed("user_id", "workspace").withColumnRenamed("event_type", "event")
    prompts = e.where("event = 'view'").select("workspace", "ts", F.col("props").alias("prompt"), (F.col("value") > 10).alias("injected"), (F.col("event_id") % 100).alias("elapsed_ms"))
    reports = e.where("event = 'purchase'").select(
        "workspace", "ts", F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 101).alias("efficiency"), (F.col("event_id") % 5).alias("followed"),
        (F.col("event_id") % 3).alias("ignored"), F.lit(0).alias("unknown"), F.lit(0).alias("unmeasurable"),
    )
    return telemetry.workspace_stats(prompts, reports, e).drop("unknown", "unmeasurable")


@query("latest_snapshots", "S5", """
WITH h AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1), s AS (SELECT DISTINCT user_id, -1 AS event_id FROM events)
SELECT s.user_id, coalesce(h.event_id, s.event_id) AS event_id FROM s LEFT JOIN h USING (user_id)
""")
def latest_snapshots(t: Tables):
    history = t.events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    snapshot = t.events.select("user_id").distinct().select("user_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    return telemetry.latest_snapshot(history, snapshot, ["user_id"], "ts").select("user_id", "event_id")


@query("event_counters", "W5", "SELECT user_id AS workspace, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def event_counters(t: Tables):
    stream = _stream(t).select(F.col("user_id").alias("workspace"), F.col("event_type").alias("event"), "ts")
    out = ev.run_available(ev.running_counts(stream), "update")
    return out.groupBy("workspace", "event").agg(F.max_by("n", "batch").alias("n"))


@query("event_trends", "W5", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def event_trends(t: Tables):
    # in update mode each micro-batch gives the counts so far of the windows it touched, open ones too
    changes = ev.run_available(ev.windowed_counts(_stream(t).withColumnRenamed("event_type", "event")), "update")
    return changes.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event").agg(F.max("n").alias("n"))


def _stream(t: Tables):
    path = f"{t.folder}/events*.parquet"
    return instants(t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path))


@query("streamed_signals", "W1 W6", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'code-review-graph|query_graph' WHEN 1 THEN 'rtk' WHEN 2 THEN 'agentmemory' ELSE '' END AS signals FROM events
""")
def streamed_signals(t: Tables):
    sql = B.PAYLOADS.split("FROM {events}")[0].strip().removeprefix("SELECT event_id,").strip().removesuffix("AS payload").strip()
    stream = _stream(t).select("event_id", "ts", F.expr(sql).alias("payload"))
    out = ev.run_available(ev.with_signals(stream))
    return out.select("event_id", F.array_join("signals", "|").alias("signals"))


@query("streamed_json_lines", "W1 W6", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'code-review-graph|query_graph' WHEN 1 THEN 'rtk' WHEN 2 THEN 'agentmemory' ELSE '' END AS signals FROM events WHERE event_id % 10 NOT IN (3, 7)
""")
def streamed_json_lines(t: Tables):
    """Events as JSON lines, some broken and some without a time, read as a stream."""
    from ..session import shared_folder

    folder = shared_folder(t.spark, "lines")
    rows = t.events.select("event_id", "ts").join(t.derive(B.PAYLOADS), "event_id")
    number = F.col("event_id") % 10
    line = F.when(number == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(F.when(number != 7, F.col("ts")).alias("ts"), "event_id", "payload")))
    rows.select(line.alias("value")).write.text(folder)
    out = ev.run_available(ev.ingest(t.spark, folder, "ts TIMESTAMP, event_id LONG, payload STRING", "100 years"))
    return out.select("event_id", F.array_join("signals", "|").alias("signals"))


@query("streamed_stop_signals", "W2", """
WITH s AS (SELECT user_id AS workspace, event_id AS stop_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id AS workspace, ts, CASE WHEN event_id % 2 = 0 THEN 'rtk' ELSE 'query_graph' END AS sig FROM events WHERE event_type IN ('click', 'error'))
SELECT s.workspace, s.stop_id, e.sig AS signal, count(*) AS n FROM s JOIN e ON s.workspace = e.workspace AND e.ts <= s.ts AND e.ts >= s.ts - INTERVAL 5 HOURS GROUP BY ALL
""")
def streamed_stop_signals(t: Tables):
    stops = _stream(t).where("event_type = 'purchase'").select(F.col("user_id").alias("workspace"), F.col("event_id").alias("stop_id"), "ts", F.expr("ts - INTERVAL 5 HOURS").alias("since"))
    signal = F.when(F.col("event_id") % 2 == 0, "rtk").otherwise("query_graph")
    events = _stream(t).where("event_type IN ('click', 'error')").select(F.col("user_id").alias("workspace"), "ts", F.array(signal).alias("signals"))
    pairs = ev.run_available(ev.correlate(stops, events, per_stop=False))
    return pairs.groupBy("workspace", "stop_id", "signal").agg(F.count("*").alias("n"))


@query("streamed_signal_sets", "W2", """
WITH s AS (SELECT CASE WHEN event_id % 5 > 0 THEN CAST(user_id AS VARCHAR) END AS workspace, event_id AS stop_id, ts, CASE WHEN event_id % 3 > 0 THEN ts - INTERVAL 2 DAY END AS since FROM events WHERE event_type = 'purchase'),
e AS (SELECT CASE WHEN event_id % 7 > 0 THEN CAST(user_id AS VARCHAR) END AS workspace, ts, CASE WHEN event_id % 2 = 0 THEN 'rtk' ELSE 'query_graph' END AS sig FROM events WHERE event_type IN ('click', 'error'))
SELECT DISTINCT s.stop_id, e.sig AS signal FROM s JOIN e ON e.ts <= s.ts AND (s.since IS NULL OR e.ts >= s.since) AND (e.workspace IS NULL OR s.workspace IS NULL OR e.workspace = s.workspace)
WHERE s.ts < date_trunc('millisecond', least((SELECT max(ts) FROM s), (SELECT max(ts) FROM e)))
""")
def streamed_signal_sets(t: Tables):
    """Evidence of stops over gaps of days, with and without workspaces, from keyed state; stops that the watermark has passed are answered."""
    named = lambda n: F.when(F.col("event_id") % n > 0, F.col("user_id").cast("string"))
    stops = _stream(t).where("event_type = 'purchase'").select(
        named(5).alias("workspace"), F.col("event_id").alias("stop_id"), "ts", F.when(F.col("event_id") % 3 > 0, F.expr("ts - INTERVAL 2 DAYS")).alias("since"),
    )
    signal = F.when(F.col("event_id") % 2 == 0, "rtk").otherwise("query_graph")
    events = _stream(t).where("event_type IN ('click', 'error')").select(named(7).alias("workspace"), "ts", F.array(signal).alias("signals"))
    with ev.rocksdb(t.spark):
        found = ev.run_available(ev.stop_signals(stops, events, "0 seconds"))
    return found.select("stop_id", "signal").distinct()


@query("streamed_latest_reports", "W7", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def streamed_latest_reports(t: Tables):
    from ..session import shared_folder

    folder = shared_folder(t.spark, "latest")
    stream = _stream(t).where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    ev.upsert_latest(stream, f"{folder}/table", ["user_id"], "ts", f"{folder}/checkpoint").awaitTermination()
    return ev.read_latest(t.spark, f"{folder}/table", ["user_id"], "ts").select("user_id", "event_id")


_GATE_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT {k} AS k, ts FROM events),
n AS MATERIALIZED (SELECT e.k, e.ts, f.ts AS nx FROM (SELECT k, ts, ts + INTERVAL {s} SECOND AS due FROM d) e ASOF LEFT JOIN d f ON e.k = f.k AND e.due {op} f.ts),
a AS (SELECT k, min(ts) AS ts FROM d GROUP BY 1 UNION ALL SELECT n.k, n.nx FROM a JOIN n ON n.k = a.k AND n.ts = a.ts WHERE n.nx IS NOT NULL)
"""


@query("cooldown_starts", "W3", _GATE_SQL.format(k="event_type", op="<=", s=C.COOLDOWN_SECONDS) + "SELECT e.event_type AS workspace, e.event_id, a.ts IS NOT NULL AS started FROM events e LEFT JOIN a ON a.k = e.event_type AND a.ts = e.ts")
def cooldown_starts(t: Tables):
    events = t.events.select(F.col("event_type").alias("workspace"), "ts", "event_id")
    return gates.cooldown(events).select("workspace", "event_id", "started")


@query("streamed_cooldown_starts", "W3", _GATE_SQL.format(k="event_type", op="<=", s=C.COOLDOWN_SECONDS) + "SELECT e.event_type AS workspace, e.event_id, a.ts IS NOT NULL AS started FROM events e LEFT JOIN a ON a.k = e.event_type AND a.ts = e.ts")
def streamed_cooldown_starts(t: Tables):
    stream = _stream(t).select(F.col("event_type").alias("workspace"), "ts", "event_id").withWatermark("ts", "10 minutes")
    return ev.run_available(gates.stream_cooldown(stream))


@query("repeat_requests", "W4", _GATE_SQL.format(k="event_type", op="<", s=600) + "SELECT e.event_id, a.ts IS NULL AS cache_hit FROM events e LEFT JOIN a ON a.k = e.event_type AND a.ts = e.ts")
def repeat_requests(t: Tables):
    requests = t.events.select(gates.request_key(["event_type"]).alias("key"), "ts", F.col("event_id").alias("request_id"))
    return gates.repeat_requests(requests, seconds=600).select(F.col("request_id").alias("event_id"), "cache_hit")


# --- sources ------------------------------------------------------------------

_CORPUS = """
SELECT p_brand AS repo, CASE p_size % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'test/' WHEN 2 THEN '.hidden/' WHEN 3 THEN 'lib' || chr(92) || 'deep' || chr(92) WHEN 4 THEN 'a/b/c/d/e/f/g/h/i/j/k/l/m/' ELSE 'node_modules/x/' END || 'f' || CAST(p_partkey AS VARCHAR(20)) ||
  CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.d.ts' WHEN 2 THEN '.mts' ELSE '.js' END AS path, CAST(p_retailprice * 540 AS BIGINT) AS size FROM {part}
"""
_CORPUS_SQL = f"""
WITH c AS ({plain(_CORPUS)}), n AS (SELECT repo, replace(path, chr(92), '/') AS path, size FROM c),
f AS (SELECT * FROM n WHERE regexp_matches(path, '\\.(ts|mts|cts)$') AND NOT path LIKE '%.d.ts' AND NOT path LIKE '.hidden/%' AND NOT path LIKE 'test/%' AND NOT path LIKE 'node_modules/%')
"""
_CORPUS_DUCK = _CORPUS_SQL


@query("scanned_corpus", "S1", _CORPUS_DUCK + """
SELECT repo, path FROM f
""")
def scanned_corpus(t: Tables):
    kept, _ = corpus.filter_corpus(t.derive(_CORPUS))
    return kept.select("repo", "path")


@query("search_corpus", "S2", _CORPUS_DUCK.split("f AS (")[0] + """
f AS (SELECT * FROM n WHERE regexp_matches(path, '\\.(ts|js)$') AND NOT path LIKE '.hidden/%' AND NOT path LIKE 'node_modules/%')
SELECT repo, path FROM f
""")
def search_corpus(t: Tables):
    return corpus.filter_corpus(t.derive(_CORPUS), "search")[0].select("repo", "path")


@query("scan_coverage", "S13", _CORPUS_DUCK + """
, s AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rank FROM f WHERE size > 512000)
SELECT repo, 'larger than the size limit' AS reason, count(*) AS n, string_agg(path, ', ' ORDER BY path) FILTER (WHERE rank <= 3) AS samples, greatest(0, count(*) - 3) AS more FROM s GROUP BY repo
""")
def scan_coverage(t: Tables):
    return corpus.coverage(corpus.filter_corpus(t.derive(_CORPUS), max_bytes=512_000)[1])


_RULE_LAYERS = """
SELECT CAST(p_partkey % 50 AS BIGINT) AS repo, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'src' WHEN 2 THEN 'src/api' ELSE 'lib' END AS dir, min(CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_name END) AS text FROM {part} GROUP BY 1, 2
UNION ALL SELECT CAST(NULL AS BIGINT), '~', 'global rules' UNION ALL SELECT CAST(NULL AS BIGINT), '~2', 'more global rules'
"""


@query("layered_rules", "S6", f"""
WITH d AS ({plain(_RULE_LAYERS)}), t AS (SELECT o_orderkey AS task_id, o_orderkey % 50 AS repo, CASE o_custkey % 3 WHEN 0 THEN 'src/api/v1' WHEN 1 THEN 'lib' ELSE '' END AS dir FROM orders),
a AS (SELECT task_id, repo, unnest(list_concat([''], list_transform(range(1, CASE WHEN dir = '' THEN 1 ELSE len(string_split(dir, '/')) + 1 END), lambda i: array_to_string(string_split(dir, '/')[1:i], '/')))) AS dir FROM t),
b AS (SELECT DISTINCT * FROM a)
SELECT task_id, dir, text, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END::INT AS depth FROM b JOIN d USING (repo, dir) WHERE trim(text) <> ''
UNION ALL SELECT task_id, '~', 'global rules', -1 FROM t UNION ALL SELECT task_id, '~2', 'more global rules', -1 FROM t
""")
def layered_rules(t: Tables):
    tasks = t.orders.select(
        F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 50).alias("repo"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 'src/api/v1' WHEN 1 THEN 'lib' ELSE '' END").alias("dir")
    )
    return rule_sources.rules_for(tasks, t.derive(_RULE_LAYERS)).select("task_id", "dir", "text", "depth")


_MANIFESTS = """
SELECT c_nationkey AS repo, CASE WHEN c_custkey < 25 THEN 'package.json' ELSE 'packages/p' || CAST(c_custkey AS VARCHAR(20)) || '/package.json' END AS path,
  CASE WHEN c_custkey % 13 = 12 THEN '{broken' ELSE '{"name":"n' || CAST(c_custkey AS VARCHAR(20)) || '","dependencies":{"react":"1","d' || CAST(c_custkey % 9 AS VARCHAR(20)) || '":"2"},"optionalDependencies":{"opt":"1"},"scripts":{"build":"x"}'
    || CASE WHEN c_custkey < 25 THEN ',"workspaces":["packages/*","tools/a"]' ELSE '' END || '}' END AS text
FROM (SELECT c_custkey, CASE WHEN c_custkey < 25 THEN CAST(c_custkey AS INT) ELSE c_nationkey END AS c_nationkey FROM {customer}) x
"""


@query("manifest_evidence", "S7", f"""
WITH m AS (SELECT * FROM ({plain(_MANIFESTS)}) WHERE text <> '{{broken'),
e AS (SELECT repo, path, 'dependency' AS kind, unnest(json_keys(text, '$.dependencies') || json_keys(text, '$.optionalDependencies')) AS value FROM m UNION ALL SELECT repo, path, 'script', unnest(json_keys(text, '$.scripts')) FROM m UNION ALL SELECT repo, path, 'file', path FROM m)
SELECT repo, kind, value, path AS source FROM e
""")
def manifest_evidence(t: Tables):
    return manifests.read_manifests(t.derive(_MANIFESTS))


@query("workspace_packages", "S7", f"""
WITH m AS ({plain(_MANIFESTS)}), r AS (SELECT repo FROM m WHERE path = 'package.json' AND text <> '{{broken')
SELECT DISTINCT repo, replace(path, '/package.json', '') AS dir FROM m WHERE path LIKE 'packages/%' AND repo IN (SELECT repo FROM r)
""")
def workspace_packages(t: Tables):
    files = t.derive(_MANIFESTS)
    return manifests.workspace_packages(manifests.parse_manifests(files), files.select("repo", "path"))


_DIFFS = """
SELECT o_orderkey AS change_id, 'diff --git a/x b/x' || chr(10) || '--- a/f' || CAST(o_custkey % 7 AS VARCHAR(20)) || '.ts' || chr(10) || '+++ b/f' || CAST(o_custkey % 7 AS VARCHAR(20)) || '.ts' || chr(10) || '@@ -1,2 +' || CAST(o_custkey AS VARCHAR(20)) || ',3 @@ fn' || chr(10)
  || ' same' || chr(10) || '-old' || chr(10) || '+new ' || o_orderpriority || chr(10) || '+++ plus' || chr(10) || '@@ -9 +' || CAST(o_custkey + 50 AS VARCHAR(20)) || ' @@' || chr(10) || '+' || chr(10) || ' a' || chr(10) || '+tail'
  || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '+++ b/g.ts' || chr(10) || '+carried' ELSE '' END AS diff FROM {orders}
"""


@query("added_lines", "S10", """
WITH o AS (SELECT o_orderkey AS change_id, o_custkey AS k, 'f' || o_custkey % 7 || '.ts' AS file, o_orderpriority AS p FROM orders)
SELECT change_id, file, k::INT + 1 AS line, 'new ' || p AS content FROM o UNION ALL SELECT change_id, file, k::INT + 50, '' FROM o UNION ALL SELECT change_id, file, k::INT + 52, 'tail' FROM o
UNION ALL SELECT change_id, 'g.ts', k::INT + 53, 'carried' FROM o WHERE change_id % 2 = 0
""")
def added_lines(t: Tables):
    return diffs.parse_diff(t.derive(_DIFFS)).select("change_id", "file", "line", "content")


@query("changed_files", "S10", "SELECT o_orderkey AS change_id, 'f' || o_custkey % 7 || '.ts' AS file FROM orders UNION ALL SELECT o_orderkey, 'g.ts' FROM orders WHERE o_orderkey % 2 = 0")
def changed_files(t: Tables):
    return diffs.changed_files(t.derive(_DIFFS))


_STATUS_FILES = """
SELECT conv_id AS change_id, turn AS pos, CASE turn % 4 WHEN 3 THEN 'bin/x.exe' ELSE 'docs/t' || CAST(turn AS VARCHAR(20)) || '.md' END AS path, CAST(length(text) AS BIGINT) AS size, replace(replace(text, ' ', chr(10)), '.', chr(10)) AS text FROM {conversations}
"""


@query("status_lines", "S11", f"""
WITH f AS (SELECT * FROM ({plain(_STATUS_FILES)}) WHERE path NOT LIKE '%.exe'),
l AS (SELECT change_id, path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f)
SELECT change_id, path AS file, CAST(line AS INTEGER) AS line, content FROM l WHERE trim(content) <> ''
""")
def status_lines(t: Tables):
    return diffs.status_lines(t.derive(_STATUS_FILES)).select("change_id", "file", "line", "content")


@query("cache_misses", "S9", """
WITH x AS (SELECT DISTINCT sha256('m1' || chr(0) || text || chr(0) || source) AS key FROM documents), c AS (SELECT sha256('m1' || chr(0) || text || chr(0) || source) AS key FROM documents WHERE doc_id % 3 = 0)
SELECT key FROM x WHERE key NOT IN (SELECT key FROM c)
""")
def cache_misses(t: Tables):
    texts = t.documents.select("text", F.col("source").alias("fingerprint"))
    cache = t.documents.where("doc_id % 3 = 0").select(index.cache_key("m1", "text", "source").alias("key"), F.lit("m1").alias("model"))
    return index.cache_misses(texts, cache, "m1").select("key")


@query("index_fallback", "S15", """
WITH i AS (SELECT DISTINCT 'k' || label AS kind FROM embeddings), r AS (SELECT DISTINCT 'k' || s_suppkey % 40 AS repo FROM supplier)
SELECT repo, CASE WHEN repo IN (SELECT kind FROM i) THEN repo ELSE 'global' END AS kind FROM r
""")
def index_fallback(t: Tables):
    rows = t.embeddings.select(F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"))
    repos = t.supplier.select(F.concat(F.lit("k"), (F.col("s_suppkey") % 40).cast("string")).alias("repo"))
    return index.index_for(repos, rows)


@query("replaced_index", "S8", """
SELECT 'k' || label AS kind, 'm1' AS model, vec_id::VARCHAR AS id, CASE WHEN label % 2 = 0 THEN 'second' ELSE 'first' END AS text FROM embeddings
""")
def replaced_index(t: Tables):
    from ..session import shared_folder

    path = shared_folder(t.spark, "index")
    rows = t.embeddings.select(F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"), F.lit("m1").alias("model"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    index.write_index(rows.withColumn("text", F.lit("first")).drop("label"), path)
    index.write_index(rows.where("label % 2 = 0").withColumn("text", F.lit("second")).drop("label"), path)
    return t.spark.read.parquet(path).select("kind", "model", "id", "text")


@query("appended_history", "S3 S4", "SELECT event_id, event_type AS event FROM events")
def appended_history(t: Tables):
    from ..session import shared_folder
    from ..sources import history

    path = shared_folder(t.spark, "history")
    rows = t.events.select("event_id", F.col("event_type").alias("event"))
    history.append_history(rows.where("event_id % 2 = 0"), path)
    history.append_history(rows.where("event_id % 2 = 1"), path)
    return history.read_history(t.spark, path, "event_id LONG, event STRING")
