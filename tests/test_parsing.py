import unicodedata

from pyspark.sql import functions as F

from taskscope.functions import paths
from taskscope.functions.text import fold_accents, matches, tokenize
from taskscope.operators import checks_text, parsing, relevance


def values(df, column):
    return [r[column] for r in df.collect()]


def test_rule_tokens(table):
    df = table([("Fix user.service.ts, rate-limit... và KIỂM  duyệt ảnh!",)], "t string")
    got = df.select(tokenize(F.col("t")).alias("k")).first()["k"]
    assert got == ["user.service.ts", "user", "service", "ts", "rate-limit", "rate", "limit", "kiem-duyet", "kiem", "duyet", "anh"]


def test_accents_follow_the_decomposition(table):
    letters = "".join(chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    want = "".join(c for c in unicodedata.normalize("NFD", letters) if not 0x300 <= ord(c) <= 0x36F)
    df = table([(letters,), ("éđß",)], "t string").select(fold_accents(F.col("t")).alias("f"))
    got = values(df, "f")
    keep = lambda s: [c for c in s if c.isascii()]
    assert keep(got[0]) == keep(want)
    assert got[1] == "eđß"


def test_word_boundary_is_ascii(table):
    df = table([("éindex",), ("index_",), ("an index.",)], "t string").select(matches(F.col("t"), r"\bindex\b").alias("m"))
    assert values(df, "m") == [True, False, True]


def test_rule_document(table):
    text = (
        "## Source: a.md\n- Always use auth guards.\n\tThis prose line\nfolds into one rule.\n---\nshort\n# Heading here\n"
        "- always use AUTH guards.\n## Source: b\n- x\n2. numbered item\n"
    )
    rows = parsing.parse_rules(table([("d", text), ("e", "")], "repo string, text string")).orderBy("pos").collect()
    assert [(r.rule_id, r.source_path, r.content) for r in rows] == [
        ("r1", "a.md", "Always use auth guards."), ("r2", "a.md", "This prose line folds into one rule."),
        ("r3", "a.md", "Heading here"), ("r4", "b", "numbered item"),
    ]


def test_five_rules_are_all_actionable(table):
    text = "\n".join(f"- {v} the {n} guard before merging." for v, n in [("Use", "auth"), ("Run", "lint"), ("Check", "size"), ("Avoid", "raw"), ("Verify", "api")])
    assert parsing.parse_rules(table([("d", text)], "repo string, text string"), only_actionable=True).count() == 5


def test_rules_without_instruction(table):
    rows = ["All shell commands must run as deploy", "sudo -u app ls", "@docs/rules.md", "<!-- note -->", "Key Tools", "Project layout", "**Overview**", "Use zod."]
    df = table([("r", c, i) for i, c in enumerate(rows)], "repo string, content string, pos int")
    assert values(relevance.actionable(df), "content") == ["Use zod."]


def test_statements_keep_their_line(table):
    text = "-- note\n\nALTER TABLE o\n  ADD COLUMN r int NOT NULL;\nSELECT 1; SELECT 2;\n  \nDELETE FROM x"
    rows = parsing.split_sql(table([("m", text)], "path string, text string")).orderBy("ord").collect()
    assert [(r.stmt, r.line) for r in rows] == [
        ("ALTER TABLE o ADD COLUMN r int NOT NULL;", 3), ("SELECT 1; SELECT 2;", 5), ("DELETE FROM x", 7),
    ]


def test_migration_checks(table):
    cases = [
        ("migrations/1.sql", 'ALTER TABLE "user" ADD COLUMN "status" varchar NOT NULL;', ["PG-001"]),
        ("migrations/2.sql", "ALTER TABLE \"user\" ADD COLUMN \"status\" varchar NOT NULL DEFAULT 'active';", []),
        ("migrations/3.sql", 'ALTER TABLE "o" ADD CONSTRAINT "f" FOREIGN KEY ("u") REFERENCES "u"("id") NOT VALID;', []),
        ("migrations/4.sql", '-- CREATE INDEX "i" ON "user" ("email");', []),
        ("migrations/5.sql", 'CREATE INDEX CONCURRENTLY "i" ON "user" ("email");', []),
        ("migrations/6.sql", 'UPDATE "user" SET "status" = 1;', ["PG-003"]),
        ("sql/report.sql", 'CREATE INDEX "i" ON "user" ("email");', []),
        ("migrations/7.sql", "ALTER TABLE t ADD COLUMN c int DEFAULT 0 NOT NULL;", ["PG-001"]),
    ]
    found = checks_text.check_sql(table([("r", p, t) for p, t, _ in cases], "repo string, path string, text string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.file, []).append(r.id)
    assert {p: ids for p, _, ids in cases if ids} == got


def test_schema_checks(table):
    text = (
        'datasource db {\n  url = "postgres://x"\n}\nmodel Order {\n  id Int @id\n  userId Int\n  user User @relation(fields: [userId], references: [id])\n'
        "  total Float\n  email String\n  @@unique([email])\n}\nmodel User {\n  name String\n  orders Order[]\n}\n"
    )
    found = checks_text.check_schema(table([("r", "prisma/schema.prisma", text)], "repo string, file string, text string"))
    assert sorted((r.id, r.line) for r in found.collect()) == [("PRISMA-001", 6), ("PRISMA-003", 8), ("PRISMA-004", 12), ("PRISMA-005", 1)]


def test_credential_verdicts(table):
    # fake keys are joined from parts
    cases = [
        *[(v, "secret", None) for v in ("JWT_SIGNING_SECRET", "PARTNER_API_KEY", "DB_PASSWORD", "X-Auth-Password", "content-type", "config.jwt.secret", "my-app-name")],
        ("sk_" + "test_51H8xQ2KpL9mN3vR7wT4yU6iO", "secret", "certain"), ("AKIA" + "IOSFODNN7EXAMPLE", None, "certain"),
        ("postgres://app:s3cr3t@db:5432/x", "secret", "certain"), ("postgres://app:s3cr3t@db:5432/x", None, None),
        ("postgres://app:s3cr3t@db.example.com/x", None, "certain"), ("super-secret-jwt-signing-key-2024", "secret", "high"),
        ("supersecret123", "secretOrKey", "high"), ("supersecret123", "secret", None),
    ]
    df = table([(v, p) for v, p, _ in cases], "v string, p string").select(checks_text.credential_verdict(F.col("v"), F.col("p")).alias("c"))
    assert values(df, "c") == [c for _, _, c in cases]


def test_path_mentions_stay_linear_on_long_runs(table):
    prompt = "see src/a/b.ts:12:3, and user.service.ts. " + "A" * 200_000
    rows = parsing.mentions(table([(1, prompt)], "task_id int, prompt string")).collect()
    assert {(r.kind, r.mention) for r in rows} == {("path", "src/a/b.ts"), ("file", "b.ts"), ("file", "user.service.ts")}


def test_payload_signals(table):
    payload = '{"cwd":"/repo","n":3,"toolName":"code-review-graph.semantic_search_nodes","command":"code-review-graph query_graph","list":["rtk",{"a":"x"}]}'
    r = parsing.extract_signals(table([(1, payload)], "id int, payload string")).first()
    assert r.signals == ["code-review-graph", "semantic_search_nodes", "query_graph", "rtk"]
    assert r.tool_signals == ["code-review-graph.semantic_search_nodes", "code-review-graph query_graph"]
    assert r.command_signals == ["code-review-graph query_graph"]


def test_catalog_and_workflow_documents(table):
    doc = '---\nname: "PG"\n---\n# Guide\n\nFirst text.\n\n## Triggers\n- index\n## Dependency skills\n- pg\n- src/x.ts\n'
    r = parsing.parse_catalog_docs(table([("x/pg/SKILL.md", doc)], "path string, text string")).first()
    assert (r.name, r.meta.positive_prompts, r.meta.dependencies, r.meta.files, r.meta.depends_on) == ("PG", ["index"], ["pg"], ["src/x.ts"], [])
    flow = "# My Flow\n\nUse the `planner` then a tester. " + "x" * 80
    w = parsing.parse_workflow_docs(table([("w/my-flow.md", flow), ("w/tiny.md", "# T")], "path string, text string")).collect()
    assert [(x.name, x.title, x.chain) for x in w] == [("my-flow", "My Flow", ["planner", "tester"]), ("tiny", "T", [])]


def test_paths(table):
    df = table([("a/./b/../c",), ("../x",), ("/abs",), ("a//b",)], "p string").select(paths.normalize(F.col("p")).alias("n"))
    assert values(df, "n") == ["a/c", None, None, "a/b"]
