"""Layered rule documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..functions.text import clean, strip


def rules_for(tasks: DataFrame, rule_docs: DataFrame) -> DataFrame:
    """Rule documents that apply to each task, outermost first.

    ``tasks(task_id, repo, dir)``, ``rule_docs(repo, dir, text)`` where a null ``repo``
    marks a global document; all of them apply to every task. Every directory from the root of the repository down to
    the task is looked up; empty documents are skipped. ``depth`` is -1 for the global one.
    """
    docs = rule_docs.where(strip(clean(F.col("text"))) != "")
    chain = tasks.select("task_id", "repo", F.posexplode(paths.ancestors(F.col("dir"))).alias("depth", "dir"))
    local = chain.join(docs.where(F.col("repo").isNotNull()), ["repo", "dir"]).select("task_id", "repo", "dir", "depth", "text")
    everywhere = docs.where(F.col("repo").isNull()).select(F.lit("*").alias("_g"), "dir", "text")
    shared = tasks.select("task_id", "repo", F.lit("*").alias("_g")).join(everywhere, "_g").select(
        "task_id", "repo", "dir", F.lit(-1).alias("depth"), "text"
    )
    return shared.unionByName(local)


def merged_rules(layers: DataFrame) -> DataFrame:
    """One document per task with every layer under its source heading."""
    part = F.concat(F.lit("## Source: "), F.when(F.col("dir") == "", "AGENTS.md").otherwise(F.concat("dir", F.lit("/AGENTS.md"))), F.lit("\n"), strip(F.col("text")))
    return layers.groupBy("task_id", "repo").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", part.alias("part")))), lambda p: p["part"]), "\n\n").alias("text")
    )
