"""Texts are read once, by patterns that never go back."""

import re

from pyspark.sql import functions as F

from taskscope.functions.text import tokenize
from taskscope.operators import parsing


def test_workflow_documents_are_read_once(spark):
    docs = spark.createDataFrame([("w/a.md", "# T\n\n***\n\n> *Use* the Scout-External\n\nlast"), ("w/b.md", None), ("w/.md", "# \n\n`x`")], "path string, text string")
    parsed = parsing.parse_workflow_docs(docs)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mcp-manager(?!") == 1
    rows = {r["path"]: r for r in parsed.collect()}
    assert set(rows) == {"w/a.md", "w/b.md", "w/.md"}
    assert rows["w/a.md"]["chain"] == ["scout", "scout-external"]
    assert rows["w/a.md"]["description"] == "T — delegates to scout, scout-external agents — Use the ScoutExternal"


def test_identifiers_never_give_a_run_back(spark):
    text = "A" * 300 + "_ " + "B" * 300 + "é FooBar fooBar Foo X2Y a.b.c_ A-1 é.b-c _x.y `q r`"
    df = spark.createDataFrame([(text,)], "t string")
    (found,) = df.select(parsing.identifiers(F.col("t")).alias("i")).first()
    assert found == ["q r", "B" * 300, "FooBar", "X2Y", "a.b", "A-1", "b-c"]


def test_joined_words_of_any_length_are_one_identifier(spark):
    texts = [sep.join(["ab"] * 100_000) for sep in "._-"] + ["a.b_", "a_b.c_d_ e", "a-b_c-d__f", "a_ b.c", "x_y_z", "a..b", "a.b-_c", "a__b.c", "1.2.3é", "a_b_.c-d"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = [r["i"] for r in df.orderBy("n").select(parsing.identifiers(F.col("t")).alias("i")).collect()]
    assert found[:3] == [[t] for t in texts[:3]]
    # as a greedy repeat that gives parts back would find them
    greedy = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9]++(?:[-_.][A-Za-z0-9]++)+(?![A-Za-z0-9_])")
    assert found[3:] == [greedy.findall(t) for t in texts[3:]]


def test_words_are_looked_for_not_split(spark):
    texts = ["Kiem  duyet tai\tlen, a.b-c -x- Édition e\u0301t\u00e9 thong bao K\u212a_1 the of", "", None, "  ", "ß ſ x", "kiem duyetai len", "é", "one"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = df.select("n", tokenize(F.col("t")).alias("rule"), tokenize(F.col("t"), "graph").alias("graph"))
    assert "[^a-z0-9" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = {r["n"]: (r["rule"], r["graph"]) for r in rows.collect()}
    assert found[0][0] == ["kiem-duyet", "kiem", "duyet", "tai-len", "tai", "len", "a.b-c", "edition", "ete", "thong-bao", "thong", "bao", "kk_1", "kk"]
    assert found[0][1] == ["kiem", "duyet", "tai", "len", "edition", "ete", "thong", "bao"]
    assert found[5][0] == ["kiem-duyetai-len", "kiem", "duyetai", "len"]
    assert all(found[n] == ([], []) for n in (1, 2, 3, 4, 6)) and found[7] == (["one"], ["one"])
