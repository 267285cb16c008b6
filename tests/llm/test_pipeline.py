"""The pipeline over a small corpus: each stage's decisions, and the rows that come out."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from taskscope.llm import toxicity
from taskscope.llm.store import written

from .cases import CLASHING, LONG, ODD

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # copies, a near copy and a leak that must go, with another id
    first = docs.where("length(text) between 800 and 3000").orderBy("doc_id").first()
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    words = first.text.split(" ")
    words[len(words) // 2] = "changed"
    more = spark.createDataFrame([
        (90001, first.text, "en", "s", 1), (90002, re.sub("[A-Z]", lambda m: m.group().lower(), first.text), "en", "s", 1), (90003, " ".join(words), "en", "s", 1), (90004, f"Some words before. {item} And after.", "en", "s", 1),
    ], docs.schema)
    docs = docs.unionAll(more)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), "test-stage")
        if name != "sentencepiece":
            assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        seen.append((name, ids))
        docs = out
    kept = dict(seen)
    assert [n for n, _ in seen] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert first.doc_id not in kept["exact_dedup"]
    assert len({first.doc_id, 90001, 90002, 90003} & kept["near_dedup"]) <= 1
    assert 90004 not in kept["decontamination"]
    assert kept["sentencepiece"] == kept["decontamination"]
    assert len(kept["near_dedup"]) > 100


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "ids", "n_tokens", "text"]
    assert out.where("n_tokens <> size(ids)").isEmpty() and out.count() > 100


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_of_odd_rows(spark, rows, tmp_path):
    """Nulls, blank, long and repeated texts through every stage, against the stages' rules applied by hand."""
    columns = ", ".join(f"'clash' AS `{c}`" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", columns.split(", ")[0], *columns.split(", ")[1:])
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "what is the meaning of this question " * 3 + "answer is this one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    # without labels nothing is learned, and nothing rejected
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, folder), "test-odd")
        assert out.columns == docs.columns
        assert name != "toxicity" or out.count() == len(rows)
        docs = out
    kept = Counter((r.doc_id, r.text or "") for r in docs.collect())
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    last = {}
    for i, t in rows:
        last[lower(t)] = max(last.get(lower(t), (False, 0)), (i is not None, i or 0))
    assert {lower(t) for _, t in kept} == {t for t in last if t.strip() or t in ("", " \t\n ")}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.columns == ["doc_id", "ids", "n_tokens", "text"] and out.count() == sum(kept.values())


def test_toxic_documents_go_and_others_stay_as_they_are(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD] + [(50, "You are an idiot, really.", "x"), (51, "You i d i o t", "x")], "doc_id long, text string, score string")
    table = toxicity._feature_table([b"idiot"], __import__("numpy").ones(1))
    model = toxicity.Model(table, 0.0, 0.4, 8.0, 0.5)
    out = toxicity.without_toxic(docs, model)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter((i, t, "x") for i, t in ODD)
    assert toxicity.without_toxic(docs.where("false"), model).count() == 0
