import numpy as np
from pyspark.sql import functions as F

from taskscope.operators import catalog, evaluate, graph, relevance, retrieval, select
from taskscope.functions.skew import contains_join, top_n

TASK = "repo string, task_id int, prompt string, open_files array<string>"
RULE = "repo string, rule_id string, pos int, content string"


def test_rule_scores(table):
    tasks = table([("r", 1, "Recheck authen flow", ["src/user.service.ts"]), ("r", 2, "", [])], TASK)
    rules = table([
        ("r", "a", 0, "Always use auth guards for login endpoints."), ("r", "b", 1, "Never commit console.log."),
        ("r", "c", 2, "Touch user.service.ts carefully."), ("r", "d", 3, "Recheck the flow."), ("r", "e", 4, "Unrelated text"),
    ], RULE)
    got = {(r.task_id, r.rule_id): (r.score, r.reasons) for r in relevance.score_rules(tasks, rules).collect()}
    # two aliases of one token count twice: (0.5 + 0.5) / 3 + 0.5
    assert got[(1, "a")] == (0.833, ["semantic:authen->auth/authen->login", "imperative"])
    assert got[(1, "d")] == (0.667, ["task:recheck/flow"])
    assert got[(1, "c")] == (0.2, ["open-file"])
    assert (1, "b") not in got and (1, "e") not in got
    top = {(r.task_id, r.rank): r.rule_id for r in relevance.top_rules(tasks, rules, 5).collect()}
    assert [top[(1, k)] for k in range(1, 6)] == ["a", "d", "c", "b", "e"]
    assert [top[(2, k)] for k in range(1, 6)] == ["a", "b", "c", "d", "e"]


def test_bands(table):
    df = table([(0.9,), (0.5,), (0.2,), (0.0999,), (0.0,)], "s double").select(relevance.band(F.col("s")).alias("b"))
    assert [r.b for r in df.collect()] == ["high", "high", "mid", "dropped", "dropped"]


def test_expansion_order(table):
    r = relevance.expand_task(table([("fix notifications and queue",)], "prompt string")).first()
    assert r.related[:2] == ["notify", "email"] and "worker" in r.related and "notification" not in r.related


def test_elbow_keeps_minimum(table):
    rows = [("t", "a", 0.99), ("t", "b", 0.7), ("t", "c", 0.69), ("u", "a", 0.9), ("u", "b", 0.89), ("u", "c", 0.6), ("u", "d", 0.5)]
    df = table(rows, "task_id string, name string, score double")
    got = {(r.task_id, r.name) for r in select.elbow(df, ["task_id"], "score", ["name"], 1, 8, 0.18, 0.55).collect()}
    assert got == {("t", "a"), ("u", "a"), ("u", "b")}


def test_round_robin(table):
    rows = [("t", f"a{i}", "A", 1.0 - i / 100) for i in range(5)] + [("t", "b0", "B", 0.5), ("t", "c0", "C", 0.7)]
    df = table(rows, "task_id string, name string, bucket string, score double")
    out = select.diversify(df, ["task_id"], "bucket", [F.desc("score"), F.col("name")], 5).orderBy("rank")
    assert [r.name for r in out.collect()] == ["a0", "c0", "b0", "a1", "a2"]


def test_top_n_of_a_large_group(spark):
    df = spark.range(6000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    got = [r.v for r in top_n(df, ["k"], [F.col("v")], 1500).orderBy("rank").collect()]
    assert got == list(range(1500))


def test_contains_join_equals_substring_search(table):
    texts = table([(1, "please build ui now"), (2, "rebuild"), (3, "qr codes: a-b"), (4, "")], "id int, t string")
    terms = table([("ui",), ("build",), ("build ui",), ("qr",), ("a-b",), ("--",), ("z",)], "w string")
    got = {(r.id, r.w) for r in contains_join(texts, "t", terms, "w").collect()}
    want = {(i, w) for i, t in [(1, "please build ui now"), (2, "rebuild"), (3, "qr codes: a-b"), (4, "")] for w in ("ui", "build", "build ui", "qr", "a-b", "--", "z") if w in t}
    assert got == want


def test_vector_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).round(3)
    vectors[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")
    queries = df.where("id < 40").withColumnRenamed("id", "query_id")
    one = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.similarity_top_k(queries, df, 4).collect()}
    many = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.similarity_top_k(queries, df, 4, block_bytes=1000, slice_bytes=6000).collect()}
    assert one == many and len(one) == 160
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    for q in range(40):
        best = np.sort((unit @ unit[q] + 1) / 2)[::-1][:4]
        assert np.allclose([one[(q, k)][1] for k in range(1, 5)], best, atol=6e-4)


def test_vector_task_holds_some_similarities_at_a_time(spark):
    vectors = np.random.default_rng(2).normal(size=(400, 6)).round(1)
    vectors[200:] = vectors[:200]  # each one twice
    vectors[100:120] = vectors[100]  # and one of them forty times
    vectors[300:320] = vectors[100]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")
    queries = df.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.similarity_top_k(queries, df, 4).collect()}
    some = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.similarity_top_k(queries, df, 4, held_bytes=3 * 8 * 400).collect()}
    assert whole == some and len(whole) == 4 * 134
    assert [whole[(102, k)][0] for k in (1, 2, 3, 4)] == [100, 101, 102, 103]
    best, sizes = retrieval._kernels(4, 3 * 8 * 400), []
    rows = [np.array(v) for v in vectors]
    column = np.empty(len(rows), object)
    column[:] = rows
    for part in best(np.arange(400), column, np.arange(400), column):
        sizes.append(part["query_id"].nunique())
    assert max(sizes) == 3 and sum(sizes) == 400


def test_top_baseline_joins_signatures_by_their_first_item(table):
    cases = table([(i, f"alpha beta gamma word{i}") for i in range(6)], "case_id int, prompt string")
    items = table([(f"i{j}", "alpha beta" if j % 2 else "gamma alpha", ["beta"]) for j in range(9)] + [(None, "alpha", ["alpha"])], "id string, description string, positive_prompts array<string>")
    out = relevance.top_baseline(cases, items, 3, often=2)
    every = relevance.baseline_score(cases, items).collect()
    want = {(c, k): (r.id, r.score) for c in range(6) for k, r in enumerate(sorted((r for r in every if r.case_id == c), key=lambda r: (-r.score, r.id is not None, r.id))[:3], 1)}
    assert {(r.case_id, r.rank): (r.id, r.score) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join " in line and "_sig" in line]


def test_import_resolution(table):
    files = table([("r", "src/a.ts"), ("r", "src/b/index.ts"), ("r", "src/b.ts")], "repo string, path string")
    imports = table([("r", "src/m/x.ts", "../a"), ("r", "src/m/x.ts", "../b"), ("r", "src/m/x.ts", "../gone"), ("r", "src/m/x.ts", "../../../up")], "repo string, path string, specifier string")
    got = {(r.src, r.dst) for r in graph.resolve_imports(imports, files).collect()}
    assert got == {("src/m/x.ts", "src/a.ts"), ("src/m/x.ts", "src/b.ts")}


def test_catalog_expansion_visits_once(table):
    edges = table([("a", "b", "related_to", 0), ("a", "ghost", "requires", 1), ("c", "b", "requires", 0), ("b", "d", "depends_on", 0)], "src string, dst string, type string, pos int")
    seeds = table([(1, "a", 0), (1, "c", 1)], "task_id int, id string, rank int")
    nodes = table([("a",), ("b",), ("c",), ("d",)], "id string")
    one = [(r.id, r.reason) for r in graph.expand_catalog(seeds, edges, nodes).collect()]
    assert one == [("b", "skill-graph:related_to:a")]
    two = {r.id: r.level for r in graph.expand_catalog(seeds, edges, nodes, depth=2).collect()}
    assert two == {"b": 1, "d": 2}


def test_catalog_expansion_never_broadcasts_relations(table):
    edges = table([("a", "b", "related_to", 0), ("b", "d", "depends_on", 0)], "src string, dst string, type string, pos int").limit(2)
    seeds = table([(1, "a", 0)], "task_id int, id string, rank int")
    out = graph.expand_catalog(seeds, edges, edges.select(F.col("src").alias("id")), depth=2)
    assert {(r.id, r.level) for r in out.collect()} == {("b", 1)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    joins = [line for line in plan.splitlines() if "Join" in line and ("src#" in line or "[id#" in line) and "LeftAnti" not in line]
    assert joins and not [line for line in joins if "Broadcast" in line]


def test_leading_workflows_hold_the_best_ones(table):
    tasks = table([(1, "please review the upload flow 12"), (2, "add tests for payment and planner"), (3, "")], "task_id int, prompt string")
    texts = [("Docs update", "testing of reviews"), ("upload flow", "notifications"), ("", "payment"), (None, None)]
    rows = [(f"flow {i}", *texts[i % 4], ["planner", "payment"] if i % 2 else ["tester"], "project" if i % 3 else "global") for i in range(200)]
    flows = table(rows + rows[:9] + [("review", "x", "y", [], "global"), (None, "upload flow", "y", [], "global")], "name string, title string, description string, chain array<string>, scope string")
    best = lambda some: sorted(map(tuple, catalog.choose_workflows(catalog.score_workflows(tasks, some)).select("task_id", "rank", "name", "score").collect()))
    few = catalog.leading_workflows(tasks, flows)
    assert best(few) == best(flows) and best(few)
    assert few.count() < 60


def test_calibration_order(table):
    rows = [(0.9, False, False, False, 0.0, 0.9), (0.3, True, False, False, 0.0, 0.8), (0.5, True, True, False, 0.0, 0.5), (0.5, True, True, True, 0.0, 0.5), (0.9, True, True, True, 1.0, 0.5)]
    df = table(rows, "score double, p boolean, d boolean, f boolean, neg double, sem double")
    c = catalog.calibrate(F.col("score"), F.lit("please change the long user profile handler"), F.col("p"), F.col("d"), F.col("f"), F.col("neg"), F.lit(False), F.col("sem"))
    assert [round(r.c, 2) for r in df.select(c.alias("c")).collect()] == [0.62, 0.56, 0.68, 0.88, 0.74]


def test_empty_routing_metrics(table):
    cases = table([("a", [], [], [])], "case_id string, expected array<string>, allowed array<string>, forbidden array<string>")
    r = evaluate.routing_metrics(cases, table([], "case_id string, rank int, id string, confidence double")).first()
    assert (r.top1_accuracy, r.top3_recall, r.false_positive_rate, r.negative_gate_accuracy, r.calibration) == (1.0, 1.0, 0.0, 1.0, 1.0)


def test_readiness_gold(table):
    repos = table([("r", False)], "repo string, has_rule_dir boolean")
    rules = table([("r", "AGENTS.md", True, c) for c in ("Always test", "Use zod", "Run lint", "Check api")], "repo string, source_path string, in_project boolean, content string")
    items = table([("r", f"s{i}", "project") for i in range(3)], "repo string, name string, scope string")
    flows = table([("r", "a", ["planner"]), ("r", "b", [])], "repo string, name string, chain array<string>")
    meta = table([("r", "positive_triggers:\nevidence:\nnegative_triggers:\nworkflow:\n")], "repo string, text string")
    r = evaluate.readiness(repos, rules, items, flows, meta).first()
    assert (r.rule_score, r.catalog_score, r.workflow_score, r.overall, r.tier, r.override_score) == (90, 100, 100, 97, "Gold", 100)


def test_vectors_are_compared_over_the_shorter_length(table):
    index = table([(1, [1.0, 0.0, 5.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, vector array<float>")
    queries = table([(7, [1.0, 0.0])], "query_id int, vector array<float>")
    got = {r.id: r.score for r in retrieval.similarity_top_k(queries, index, 3).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5}


def test_an_embedder_can_be_passed(table):
    from pyspark.sql import functions as F

    letters = lambda df: df.withColumn("vector", F.array(*[F.length(F.regexp_replace("text", f"[^{c}]", "")).cast("float") for c in "abc"]))
    index = table([("x", "aaa"), ("y", "bbb")], "id string, text string")
    queries = table([(1, "aa"), (2, "ccc")], "query_id int, text string")
    got = {(r.task_id, r.path): r.score for r in retrieval.vector_candidates(queries, index, embed=letters).collect()}
    assert got == {(1, "x"): 10.0, (1, "y"): 5.0, (2, "x"): 5.0, (2, "y"): 5.0}


def test_top_rules_equal_all_scores_where_tokens_are_frequent(table):
    """One token in every rule, several in many; aliases, open files, imperatives and ties."""
    import random

    from taskscope.operators import relevance

    random.seed(5)
    words = ["common", "often", "many", "user", "auth", "login", "cache", "x.service.ts", "rare1", "rare2", "database", "db"]
    rules = table([
        (f"r{k % 2}", f"id{k}", "common " + " ".join(random.sample(words, random.randint(0, 4))) + (" You must do it" if k % 3 == 0 else ""), k // 2) for k in range(160)
    ] + [("r0", "lone", "nothing shared here", 900)], "repo string, rule_id string, content string, pos int")
    tasks = table([
        (f"r{k % 2}", k, " ".join(random.sample(words, random.randint(0, 5))), random.choice([[], ["src/x.service.ts"]])) for k in range(40)
    ], "repo string, task_id int, prompt string, open_files array<string>")
    for often in (0, 3, 20, 1000):
        got = {}
        for r in relevance.top_rules(tasks, rules, 4, often=often).collect():
            got.setdefault(r.task_id, []).append((r["rank"], r.rule_id, r.score, tuple(r.reasons)))
        if often == 0:
            every = relevance.score_rules(tasks, rules).collect()
        for t in tasks.collect():
            mine = sorted(((-r.score, r.pos, r.rule_id, tuple(r.reasons)) for r in every if r.task_id == t.task_id))[:4]
            if t.prompt:
                assert [(i, -s, why) for s, _, i, why in mine] == [x[1:] for x in sorted(got[t.task_id])][: len(mine)], (often, t)


def test_text_match_equals_plain_counting_where_tokens_are_frequent(table):
    from taskscope.operators import retrieval

    files = [("r", f"src/{w}{k}.ts", f"common {w} text{k % 5} {'extra' * (k % 2)}") for k, w in enumerate(["user", "auth", "order", "cart"] * 30)]
    tasks = [(1, "r", "common user text3"), (2, "r", "common"), (3, "r", "auth order nothing")]
    want = {}
    for task, _, prompt in tasks:
        found = []
        for _, path, text in files:
            hay, base = f"{path} {text}".lower(), path.split("/")[-1]
            points = sum(4 + 3 * (tok in base) for tok in set(prompt.split()) if tok in hay)
            if points:
                found.append((-points, path))
        want[task] = [(p, -s) for s, p in sorted(found)[:10]]
    index, asked = table(files, "repo string, path string, text string"), table(tasks, "task_id int, repo string, prompt string")
    for often in (0,):
        got = {}
        for r in retrieval.text_match(asked, index).collect():
            got.setdefault(r.task_id, []).append((r.path, int(r.score)))
        assert {t: sorted(v, key=lambda x: (-x[1], x[0])) for t, v in got.items()} == want, often


def _plain_text_match(tasks, files, limit):
    """Best files and first tokens of each task, counted row by row: ``{task: [(path, score, tokens)]}``."""
    import re
    from collections import defaultdict

    texts = defaultdict(str)
    for repo, path, text in files:
        texts[repo, path] += " \n " + " ".join(x for x in (path, text) if x is not None).lower()
    points, found = defaultdict(int), defaultdict(set)
    for task, repo, prompt in tasks:
        for (r, path), text in texts.items():
            for tok in {w for w in re.split("[^a-z0-9]+", (prompt or "").lower()) if len(w) >= 3}:
                if repo is not None and r == repo and tok in text:
                    points[task, path] += 4 + 3 * (path is not None and tok in path.split("/")[-1].lower())
                    found[task, path].add(tok)
    out = {}
    for (task, path), n in sorted(points.items(), key=lambda x: (-x[1], x[0][1] is not None, x[0][1] or "")):
        best = out.setdefault(task, [])
        if len(best) < limit:
            best.append((path, n, ",".join(sorted(found[task, path])[:5])))
    return {t: sorted(v, key=str) for t, v in out.items()}


def test_text_match_in_blocks_and_slices_equals_plain_counting(table):
    long = "averyverylongidentifier"
    files = [("r", f"src/{w}{k}.ts", f"Common {w}s text{k % 5}, {'extra' * (k % 2)}{long if k % 3 else long[:15]}") for k, w in enumerate(["user", "auth", "order", "cart"] * 12)]
    files += [(repo, f"pkg/Auth{k}.ts", "authority " * k) for repo in ("r", "s") for k in range(9)]
    # rows of one path, or of none, are one file; repositories that only one side has meet nothing
    files += [("r", "src/user0.ts", "zebra"), ("r", None, "zebra"), ("r", None, "common zebras"), ("r", "a/empty.md", None), (None, "a/none.md", "common"), ("alone", "a/b.md", "common user")]
    files += [("s", "big/auth.md", f"zebra {k} word{k} " + "filler " * 40) for k in range(30)]
    tasks = [(k, "r", p) for k, p in enumerate(["common user text3", "common", "auth order nothing", f"{long} {long[:12]} {long[:15]} {long[:5]}", "zebra empty", "", None, "missingword"])]
    tasks += [(1, "r", "common user"), (1, "s", "auth word7 word29 zebra"), (20, "s", "auth filler word12"), (None, "r", "cart extra"), (21, None, "common"), (22, "nowhere", "common")]
    index, asked = table(files, "repo string, path string, text string"), table(tasks, "task_id long, repo string, prompt string")
    want = _plain_text_match(tasks, files, 4)
    assert set(want) == {0, 1, 2, 3, 4, 20, None}
    for sizes in ({}, {"prompt_bytes": 40, "file_bytes": 2000, "held_bytes": 4000}):
        got = {}
        for r in retrieval.text_match(asked, index, 4, **sizes).collect():
            assert r.source == "indexed-file-text" and len(r.reasons) == 1
            got.setdefault(r.task_id, []).append((r.path, int(r.score), r.reasons[0].removeprefix("indexed-file-text:")))
        assert {t: sorted(v, key=str) for t, v in got.items()} == want, sizes


def test_text_match_makes_no_row_for_each_task_and_file(spark):
    import re

    tasks = spark.range(100).select(F.col("id").alias("task_id"), F.lit("r").alias("repo"), F.lit("common words").alias("prompt"))
    index = spark.range(400).select(F.lit("r").alias("repo"), F.format_string("src/f%d.ts", "id").alias("path"), F.lit("common text of words").alias("text"))
    out = retrieval.text_match(tasks, index, 3)
    assert out.count() == 300
    seen, most = [out._jdf.queryExecution().executedPlan()], 0
    out.collect()
    while seen:
        node = seen.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            seen.append(node.executedPlan())
        elif re.search("QueryStage", name):
            seen.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        seen += [node.children().apply(i) for i in range(node.children().size())]
    assert 400 <= most < 100 * 400 / 10


def test_factored_evidence_gives_the_same_scores(spark, table):
    from taskscope import constants as C
    from taskscope.operators import catalog

    meta = [(f"item {k}", f"positive_triggers:\n  - {['deploy', 'lint', 'cache'][k % 3]}\nevidence:\n  dependencies:\n    - dep{k % 4}\n  files:\n    - f{k % 5}.ts\n") for k in range(30)]
    cat = spark.createDataFrame([(n, n, f"about {n}", "project" if k % 2 else "global", "p", t) for k, (n, t) in enumerate(meta)], "id string, name string, description string, scope string, path string, text string")
    fields = {f: F.array().cast("array<string>") for f in ("positive_prompts", "negative_prompts", "dependencies", "negative_dependencies", "files", "negative_files")}
    number = F.regexp_extract("id", "[0-9]+", 0).cast("int")
    fields["positive_prompts"] = F.array(F.element_at(F.array(F.lit("deploy"), F.lit("lint"), F.lit("cache")), number % 3 + 1))
    fields["dependencies"], fields["files"] = F.array(F.concat(F.lit("dep"), (number % 4).cast("string"))), F.array(F.concat(F.lit("f"), (number % 5).cast("string"), F.lit(".ts")))
    fields["negative_files"] = F.when(number % 7 == 0, F.array(F.lit("bad.ts"))).otherwise(F.array().cast("array<string>"))
    for f in C.META_FIELDS:
        fields.setdefault(f, F.array().cast("array<string>"))
    cat = cat.withColumn("meta", F.struct(*[v.alias(k) for k, v in fields.items()]))
    evidence = table([("a", "dependency", "dep1"), ("a", "dependency", "dep2"), ("a", "file", "src/f1.ts"), ("a", "file", "f3.ts"), ("b", "file", "bad.ts"), ("b", "dependency", "dep0")], "repo string, kind string, value string")
    # one repository with 10,000 tasks
    tasks = spark.range(10_000).select(
        F.col("id").cast("int").alias("task_id"), F.when(F.col("id") < 20, "b").otherwise("a").alias("repo"),
        F.element_at(F.array(F.lit("please deploy the service"), F.lit("fix lint item 7"), F.lit("nothing of note"), F.lit("")), (F.col("id") % 4 + 1).cast("int")).alias("prompt"),
    )
    whole, parts = catalog.match_evidence(tasks, cat, evidence), catalog.factored_evidence(tasks, cat, evidence)
    assert parts.repo.count() < 60
    rows = lambda df: sorted(map(str, df.collect()))
    few = tasks.where("task_id < 60")
    pick = lambda df: df.where("task_id < 60")
    assert rows(pick(catalog.light_score(tasks, cat, evidence, parts))) == rows(catalog.light_score(few, cat, evidence, pick(whole)))
    pairs = few.select("task_id").join(cat.select("id")).select("task_id", "id", F.lit(0.5).alias("semantic"), F.lit(False).alias("explicit"), F.lit(0.0).alias("graph_score"))
    assert rows(catalog.hybrid_score(pairs, few, cat, parts)) == rows(catalog.hybrid_score(pairs, few, cat, whole))
