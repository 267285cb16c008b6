import datetime as dt
import random
import re

from pyspark.sql import functions as F

from taskscope.operators import checks_facts, compliance, findings as fnd, telemetry
from taskscope.sources import corpus, diffs, history, index, rules as rule_sources
from taskscope.streaming import gates
from taskscope.operators.checks_text import finding

RULES = "change_id int, rule_id string, content string"
LINES = "change_id int, ord int, file string, line int, content string"
SIGNALS = "change_id int, signal string"


def test_diff_lines(table):
    diff = (
        "diff --git a/src/user.ts b/src/user.ts\n--- a/src/user.ts\n+++ b/src/user.ts\n@@ -1,2 +1,3 @@\n+import { z } from 'zod';\n-old\n same\n+console.log('x');\n"
        "@@ -9 +20 @@ fn\n ctx\n+tail"
    )
    rows = diffs.parse_diff(table([(1, diff)], "change_id int, diff string")).orderBy("ord").collect()
    assert [(r.file, r.line, r.content) for r in rows] == [
        ("src/user.ts", 1, "import { z } from 'zod';"), ("src/user.ts", 3, "console.log('x');"), ("src/user.ts", 21, "tail"),
    ]


def sequential_diff(text):
    """Line by line, as a reader would."""
    out, file, at = [], None, None
    for k, line in enumerate(re.split(r"\r?\n", text or "")):
        head, hunk = re.fullmatch(r"\+\+\+ b/(.+)", line), re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
        if line.startswith("-"):
            continue
        if head:
            file = head[1]
        elif hunk and int(hunk[1]) < 2**31:
            at = int(hunk[1])
        else:
            if line.startswith("+") and not line.startswith("+++"):
                out.append((k, file, at, line[1:]))
            at = None if at is None else at + 1
    return out


def test_diffs_of_many_forms(table):
    random.seed(4)
    parts = ["+new", "-old", " same", "", "+++ b/a.ts", "+++ b/dir/b c.py", "+++ c", "--- a/a.ts", "@@ -1 +7 @@ fn", "@@ -1,2 +30,4 @@", "@@ bad @@", "@@ -1 +99999999999 @@", "@@ -3 +2147483648 @@", "+", "++x", "\\ No newline", "+\u00e9\u65e5"]
    rows = [(k, "\n".join(random.choice(parts) for _ in range(random.randint(0, 30))).replace("\n", "\r\n" if k % 5 == 0 else "\n")) for k in range(600)] + [(900, None), (901, ""), (902, "+loose")]
    got = diffs.parse_diff(table(rows, "change_id int, diff string")).collect()
    want = [(k, *x) for k, t in rows for x in sequential_diff(t)]
    assert sorted(str((r.change_id, r.ord, r.file, r.line, r.content)) for r in got) == sorted(map(str, want))
    assert diffs.parse_diff(table([], "change_id int, diff string")).count() == 0


def test_a_diff_of_many_hunks(table):
    text = "+++ b/x.ts\n" + "".join(f"@@ -1 +{10 * k} @@\n ctx\n+line {k}\n" for k in range(100_000))
    rows = diffs.parse_diff(table([(1, text)], "change_id int, diff string")).agg(F.count("*").alias("n"), F.sum("line").alias("s"), F.max("content").alias("m")).first()
    assert rows.n == 100_000 and rows.s == sum(10 * k + 1 for k in range(100_000))


def test_verdicts(table):
    rules = table([
        (1, "zod", "Validate input with `zod` schemas."), (1, "log", "Never commit console.log."), (1, "run", "Always use code-review-graph first."),
        (1, "soft", "Do not deploy `zod` code."), (2, "none", "Use `zod`."), (1, "rate", "Use `rate` limits."),
    ], RULES)
    lines = table([(1, 0, "a.ts", 1, 'import { z } from "zod";'), (1, 1, "a.ts", 2, "console.log('debug'); PrimaryGeneratedColumn")], LINES)
    got = {r.rule_id: (r.status, r.kind) for r in compliance.verdicts(rules, lines, table([], SIGNALS)).collect()}
    assert got == {
        "zod": ("followed", "required"), "log": ("ignored", "forbidden"), "run": ("unmeasurable", "runtime"),
        "soft": ("followed", "required"),  # "do not" is not a forbidden clause
        "none": ("unmeasurable", "required"), "rate": ("unknown", "required"),
    }
    seen = compliance.verdicts(rules.where("rule_id = 'run'"), lines, table([(1, "code-review-graph.query_graph")], SIGNALS)).first()
    assert (seen.status, seen.kind) == ("followed", "runtime")


def test_report_and_scorecard_nulls(table):
    verdict = table([(1, "a", "Hash the password.", "unknown"), (2, "b", "Hash the password.", "unmeasurable"), (3, "c", "Hash the password.", "ignored"), (3, "d", "sudo -u app ls", "ignored")],
                    "change_id int, rule_id string, content string, status string")
    for name in ("category", "severity", "confidence", "evidence"):
        verdict = verdict.withColumn(name, F.lit(None).cast("string"))
    verdict = verdict.withColumn("structural", F.lit(False))
    reports = {r.change_id: r for r in compliance.report(verdict).collect()}
    assert reports[1].efficiency is None and reports[3].efficiency == 0 and reports[3].ignored == 1
    card = compliance.scorecard(compliance.issues(verdict), compliance.category_status(verdict))
    got = {(r.change_id, r.category): (r.status, r.score) for r in card.collect()}
    assert got[(1, "Security")] == ("WARNING", 96) and got[(2, "Security")] == ("NOT_EVALUATED", None) and got[(3, "Security")] == ("FAIL", 90)
    overall = {r.change_id: r.overall for r in compliance.overall_score(card).collect()}
    assert overall == {1: 96, 2: None, 3: 90}


def _finding(table, rows):
    df = table(rows, "repo string, file string, id string, severity string, confidence string, line int, s int, e int")
    span = F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("start_line"), F.col("e").alias("end_line")))
    return df.select("repo", "file", "id", "severity", "confidence", "line", span.alias("superseded"), F.lit("t").alias("title"), F.lit("e").alias("evidence"), F.lit(0).alias("col"))


def test_suppression_and_dedup(table):
    df = _finding(table, [
        ("r", "a", "PERF-003", "MEDIUM", "low", 10, 10, 200), ("r", "a", "TORM-002", "HIGH", "high", 150, None, None),
        ("r", "b", "PERF-003", "MEDIUM", "low", 10, 10, 20), ("r", "b", "X", "LOW", "medium", 12, None, None),
        ("r", "b", "X", "HIGH", "low", 12, None, None),
    ])
    got = sorted((r.file, r.id, r.severity) for r in fnd.dedupe_findings(df).collect())
    assert got == [("a", "TORM-002", "HIGH"), ("b", "PERF-003", "MEDIUM"), ("b", "X", "HIGH")]


def test_registry_isolates_errors(table):
    base = table([("r", "a.ts", 1)], "repo string, file string, line int")
    registry = fnd.Registry().register("good", lambda i: finding(i["f"], "A-1", "Security", "LOW", "low", "x", "t"), "nest")
    registry.register("bad", lambda i: i["missing"])
    try:
        registry.register("good", lambda i: i)
        raise AssertionError("a second check with one id must be rejected")
    except ValueError:
        pass
    other = table([("other", "nest")], "repo string, platform string")
    found, ran, errors = registry.run({"f": base}, other)
    assert found.count() == 0 and ran == ["good"] and list(errors) == ["bad"]
    assert registry.run({"f": base}, other, only=["good"])[0].count() == 1


def test_registry_isolates_checks_that_fail_while_running(table):
    base = table([("r", "a.ts", 1), ("r", "b.ts", 2)], "repo string, file string, line int")
    good = lambda i: finding(i["f"], "A-1", "Security", "LOW", "low", "x", "t")
    bad = lambda i: good(i).withColumn("line", F.when(F.col("line") > 1, F.raise_error(F.lit("broke on a row")).cast("int")).otherwise(F.col("line")))
    found, ran, errors = fnd.Registry().register("good", good).register("bad", bad).register("last", good).run({"f": base})
    assert found.count() == 4 and ran == ["good", "last"]
    assert list(errors) == ["bad"] and "broke on a row" in errors["bad"]


def test_route_guards(table):
    schema = "repo string, file string, line int, class string, owner_kind string, member string, param string, name string, arg_text string, first_string string, true_keys array<string>"
    row = lambda c, k, m, n, s=None: ("r", "f.ts", 1, c, k, m, None, n, "", s, [])
    d = table([
        row("A", "class", None, "Controller", "webhooks/stripe"), row("A", "method", "hook", "Post"),
        row("B", "class", None, "Controller", "users"), row("B", "method", "list", "Get"), row("B", "method", "make", "Post"),
        row("C", "class", None, "Controller"), row("C", "class", None, "UseGuards"), row("C", "method", "x", "Post"),
    ], schema)
    got = sorted((r.evidence, r.severity, r.confidence) for r in checks_facts.check_missing_guards(d).collect())
    assert got == [("list", "MEDIUM", "low"), ("make", "HIGH", "high")]


def test_repository_resolved_by_type(table):
    calls = "repo string, file string, line int, col int, fn_id string, class string, member string, root_this boolean, field string, base_text string, method string, arg0_kind string, option_keys array<string>, loop_depth int"
    c = table([
        ("r", "a", 1, 0, "f1", "S", "m", True, "products", None, "find", None, [], 0), ("r", "a", 2, 0, "f1", "S", "m", True, "client", None, "find", None, [], 0),
        ("r", "a", 3, 0, "f1", "S", "m", True, "products", None, "find", "object", ["take"], 0), ("r", "a", 4, 0, "f1", "S", "m", True, "products", None, "find", "function", [], 1),
    ], calls)
    members = table([("r", "S", "products", "ctor_param", "Repository", "Product"), ("r", "S", "client", "ctor_param", "CatalogClient", None)], "repo string, class string, member string, kind string, type_name string, type_arg string")
    classes = table([("r", "S", None)], "repo string, class string, base_class string")
    fns = table([("r", "f1", "x")], "repo string, fn_id string, body_text string")
    got = sorted((r.id, r.line) for r in checks_facts.check_repository_calls(c, members, classes, fns).collect())
    assert got == [("TORM-001", 1), ("TORM-002", 4)]


def at(seconds):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


def test_attribution_crosses_spans(table):
    prompts = table([("w", 1, at(0)), ("w", 2, at(9000))], "workspace string, prompt_id int, ts timestamp")
    stops = table([("w", 10, at(8000)), ("w", 11, at(9000)), ("w", 12, at(90000)), ("v", 13, at(5))], "workspace string, stop_id int, ts timestamp")
    got = {r.stop_id: r.prompt_id for r in telemetry.attribute(stops, prompts).collect()}
    assert got == {10: 1, 11: 2, 12: 2, 13: None}


def test_evidence_takes_the_cap_before_the_filters(spark, table):
    events = spark.range(700).select(F.lit("l").alias("log"), F.lit("w").alias("workspace"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1767225600) + F.col("id")).alias("ts"))
    events = events.withColumn("workspace", F.when(F.col("event_id") % 2 == 0, "other").otherwise("w"))
    stops = table([("l", "w", 1, at(699), None), ("l", "w", 2, at(300), at(290))], "log string, workspace string, stop_id long, ts timestamp, since timestamp")
    got = telemetry.evidence_window(stops, events, last=500).groupBy("stop_id").agg(F.count("*").alias("n"), F.min("event_id").alias("m")).collect()
    assert {(r.stop_id, r.n, r.m) for r in got} == {(1, 250, 201), (2, 5, 291)}


def _greedy(times, gap, strict):
    last, out = None, []
    for t in times:
        ok = last is None or (t - last > gap if strict else t - last >= gap)
        out.append(ok)
        last = t if ok else last
    return out


def test_gates_equal_the_sequential_rule(spark):
    import random

    random.seed(3)
    times = sorted(random.sample(range(0, 40000), 700))
    rows = [("hot", i, at(t)) for i, t in enumerate(times)] + [("cold", 1000 + i, at(t)) for i, t in enumerate([0, 600, 899, 1000, 1800, 1900])]
    df = spark.createDataFrame(rows, "workspace string, event_id long, ts timestamp")
    got = {r.event_id: r.started for r in gates.cooldown(df, span_seconds=2000).collect()}
    assert [got[i] for i in range(700)] == _greedy(times, 900, False)
    assert [got[1000 + i] for i in range(6)] == [True, False, False, True, False, True]
    keyed = df.select(F.col("workspace").alias("key"), "ts", F.col("event_id").alias("request_id"))
    hits = {r.request_id: r.cache_hit for r in gates.repeat_requests(keyed, span_seconds=500).collect()}
    assert [not hits[i] for i in range(700)] == _greedy(times, 60, True)


def test_status_lines_are_whole(table):
    text = "\n".join(["x", ""] * 1500)
    rows = [(1, i, f"d{i}.md", 10, text) for i in range(4)] + [(1, 9, "big.md", 300_000, "x"), (1, 10, "a.exe", 1, "x")]
    files = table(rows, "change_id int, pos long, path string, size long, text string")
    count = lambda df: {r.file: r.n for r in df.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert count(diffs.status_lines(files)) == {**{f"d{i}.md": 1500 for i in range(4)}, "big.md": 1}
    assert "big.md" not in count(diffs.status_lines(files, max_bytes=200_000))


def test_sources(spark, tmp_path, table):
    root = tmp_path / "repos"
    for name, size in [("r/src/a.ts", 5), ("r/src/a.d.ts", 5), ("r/test/b.ts", 5), ("r/.git/c.ts", 5), ("r/big.ts", 600_000)]:
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * size)
    assert sorted(r.path for r in corpus.scan_corpus(spark, str(root))[0].collect()) == ["big.ts", "src/a.ts"]
    kept, skipped = corpus.scan_corpus(spark, str(root), max_bytes=512_000, max_files=5)
    assert [(r.repo, r.path, r.truncated, r.text) for r in kept.collect()] == [("r", "src/a.ts", False, "xxxxx")]
    assert [(r.repo, r.n, r.samples) for r in corpus.coverage(skipped).collect()] == [("r", 1, "big.ts")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.jsonl").write_text('{"event":"a"}\n\n{broken\n  {"event":"b"}\n')
    assert sorted(r.event for r in history.read_history(spark, str(tmp_path / "h"), "event STRING").collect()) == ["a", "b"]
    layers = rule_sources.rules_for(
        table([(1, "r", "src/api")], "task_id int, repo string, dir string"),
        table([("r", "", "root"), ("r", "src", " "), ("r", "src/api", "api"), (None, "~", "global"), ("r", "lib", "no")], "repo string, dir string, text string"),
    )
    assert [(r.depth, r.text) for r in layers.orderBy("depth").collect()] == [(-1, "global"), (0, "root"), (2, "api")]
    misses = index.cache_misses(table([("a", "f"), ("a", "f"), ("b", "f")], "text string, fingerprint string"), table([], "key string, model string"), "m")
    assert misses.count() == 2


def test_marks_hold_for_the_class_of_their_file(table):
    schema = "repo string, file string, line int, class string, owner_kind string, member string, param string, name string, arg_text string, first_string string"
    one = lambda file, kind, member, name: ("r", file, 3, "UsersController", kind, member, None, name, "", None)
    rows = [one(f, "class", None, "Controller") for f in ("a.ts", "b.ts")] + [one(f, "method", "create", "Post") for f in ("a.ts", "b.ts")] + [one("a.ts", "class", None, "UseGuards")]
    from taskscope.operators import checks_facts

    assert [r.file for r in checks_facts.check_missing_guards(table(rows, schema)).collect()] == ["b.ts"]


def test_no_limit_by_default(table):
    from pyspark.sql import functions as F

    from taskscope.operators import compliance, parsing, select

    rows = table([(1, i, None) for i in range(1500)], "k int, ord long, most int")
    assert select.apply_limit(rows, ["k"], "most", [F.col("ord")]).count() == 1500
    big = table([("a", "f", 3_000_000_000), ("b", "g", 5)], "case_id string, fixture string, ord long")
    assert [r.case_id for r in select.select_cases(big, ["f"], 2).orderBy("rank").collect()] == ["a", "b"]
    words = " ".join(f"word{chr(97 + i)}" for i in range(20))
    assert table([(words,)], "t string").select(F.size(compliance.keywords(F.col("t")))).first()[0] == 20
    text = '{"a": "x rtk \\u0065", "l": [' + ", ".join(f'"v{i}"' for i in range(200)) + '], "z": "query_graph"}'
    out = parsing.extract_signals(table([(text,), (text[:-1],)], "payload string")).collect()
    assert [r.signals for r in out] == [["rtk", "query_graph"], []]


def test_evidence_is_whole_without_a_cap(spark, table):
    stops = table([("l", "w", 1, 2000, None), ("l", None, 2, 2000, 1000), ("l", "v", 3, 10, None)], "log string, workspace string, stop_id long, ts long, since long").withColumn("ts", F.timestamp_seconds("ts")).withColumn("since", F.timestamp_seconds("since"))
    events = spark.range(1500).select(F.lit("l").alias("log"), F.expr("CASE id % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'v' END").alias("workspace"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    got = {r.stop_id: (r.n, r.m) for r in telemetry.evidence_window(stops, events).groupBy("stop_id").agg(F.count("*").alias("n"), F.min("event_id").alias("m")).collect()}
    assert got == {1: (1000, 0), 2: (500, 1000), 3: (7, 1)}


def test_stop_evidence_is_linear_and_whole(spark, table):
    """Signals in the order in which they first came, against every pair; one moment and one workspace hold most rows."""
    random.seed(9)
    words = ["a", "b", "c", "d", "e", "f"]
    lists = lambda: [random.sample(words, random.choice([0, 0, 1, 3])) for _ in range(3)]
    events = [("l" if k % 9 else "m", random.choice(["w", "w", "w", "v", None]), k, random.choice([500, random.randint(0, 1000)]), f"e{k % 4}", *lists()) for k in range(700)]
    stops = [("l" if k % 5 else "m", random.choice(["w", "v", "x", None]), 10_000 + k, t := random.choice([500, random.randint(0, 1100)]), random.choice([None, t - random.randint(-5, 600), 500])) for k in range(60)]
    names = ["signals", "tool_signals", "command_signals"]
    e = table(events, "log string, workspace string, event_id long, s long, event string, " + ", ".join(f"{n} array<string>" for n in names)).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    s = table(stops, "log string, workspace string, stop_id long, s long, b long").select("log", "workspace", "stop_id", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("b").alias("since"))
    got = {r.stop_id: r for r in telemetry.runtime_evidence(s, e).collect()}
    assert len(got) == 60
    for log, w, stop, t, since in stops:
        mine = sorted((x for x in events if x[0] == log and x[3] <= t and (since is None or x[3] >= since) and (w is None or x[1] is None or x[1] == w)), key=lambda x: (x[3], x[2]))
        for k, name in enumerate(names):
            assert got[stop][name] == list(dict.fromkeys(y for x in mine for y in x[5 + k]))
        said = [x[4] for x in mine if any(x[5:])]
        assert got[stop].n_sources == len(said) and got[stop].sources == said[:20]
    assert telemetry.runtime_evidence(s.where("false"), e).count() == 0
    assert telemetry.runtime_evidence(s, e.where("false")).count() == 60


def test_one_moment_of_a_key_is_many_ranges(spark):
    from taskscope.functions.skew import in_ranges, running_count

    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(0).alias("ts"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = in_ranges(rows, ["k"], [F.col("ts"), F.col("id")])
        sizes = [r.n for r in cut.groupBy("_span").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 2 and max(sizes) < 10_000
        counted = running_count(rows, ["k"], [F.col("ts"), F.col("id")], F.col("id") % 2 == 0, "n")
        assert counted.where("n <> floor(id / 2) + 1").isEmpty() and counted.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_evidence_rows_carry_no_texts(table):
    rules = table([(1, "a", ["x.y", "do it"]), (1, "b", ["zz", "x.y"]), (None, "c", ["x.y"]), (2, "d", ["(", "x.z"])], "change_id int, rule_id string, keywords array<string>")
    lines = table([(1, 3, "f", 30, "X.y and zz"), (1, 2, "f", 20, "x.yy do it"), (1, 2, "f", 20, "x.yy do it"), (None, 1, "g", 1, "x.y"), (2, 1, None, None, "a ( b x.z")], "change_id int, ord int, file string, line int, content string")
    out = compliance.keyword_evidence(rules, lines)
    assert {(r.change_id, r.rule_id, r.keyword, r.ord, r.file, r.line) for r in out.collect()} == {(1, "a", "x.y", 3, "f", 30), (1, "b", "zz", 3, "f", 30), (2, "d", "x.z", 1, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Project [" in line and "content#" in line and "piece#" in line.split("Project", 1)[1]]
    asked = table([(1, "a", ["rtk", "Query_graph"]), (1, "b", ["query_graph"]), (2, "c", ["rtk"])], "change_id int, rule_id string, runtime_keywords array<string>")
    signals = table([(1, "call QUERY_GRAPH now"), (1, "ls"), (2, "query_graph"), (None, "rtk")], "change_id int, signal string")
    found = compliance.match_runtime(asked, signals)
    assert {tuple(r) for r in found.collect()} == {(1, "a", "Query_graph"), (1, "b", "query_graph")}
    assert "_gram" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_checks_run_in_methods_that_java_compiles(spark, table):
    from taskscope.operators.findings import Registry

    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)

    def check(inputs):
        seen.append(int(spark.conf.get(name)))
        return inputs["rows"]

    found, ran, errors = Registry().register("one", check).run({"rows": table([("r", 1)], "repo string, line int")})
    assert seen == [8000] and spark.conf.get(name) == before
    assert ran == ["one"] and not errors and [tuple(r) for r in found.collect()] == [("r", 1)]


def test_evidence_of_no_workspace_is_joined_as_runs(spark):
    stops = spark.range(200).selectExpr("'l' AS log", "IF(id % 9 = 0, NULL, CONCAT('w', id % 4)) AS workspace", "id AS stop_id", "timestamp_seconds(id * 40) AS ts", "IF(id % 3 = 0, NULL, timestamp_seconds(id * 40 - 900)) AS since")
    events = spark.range(9000).selectExpr("'l' AS log", "IF(id % 2 = 0, NULL, CONCAT('w', id % 5)) AS workspace", "id AS event_id", "IF(id % 50 = 7, NULL, timestamp_seconds(id)) AS ts", "CONCAT('e', id) AS event")
    found = telemetry.evidence_window(stops, events)
    got = sorted((r.stop_id, r.event_id, r.workspace or "", r.event) for r in found.collect())
    same = "e.workspace IS NULL OR s.workspace IS NULL OR e.workspace = s.workspace"
    on = F.expr(f"({same}) AND coalesce(e.ts <= s.ts, true) AND (s.since IS NULL OR e.ts >= s.since)")
    want = sorted((r.stop_id, r.event_id, r.workspace or "", r.event) for r in stops.alias("s").join(events.alias("e"), on).select("stop_id", "event_id", "s.workspace", "event", "e.ts").collect())
    assert got == want and len(got) > 100_000
    # a run meets a stop as one row
    joined, nodes = [], [found._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        nodes += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        if "Join" in name:
            joined.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert sum(joined) < len(got) / 2
