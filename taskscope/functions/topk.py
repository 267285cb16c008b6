"""Top-k over shared tokens without a row for each pair that shares a frequent token."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import top_n

#: Items of a group from which a token counts as frequent.
OFTEN = 256


def rank_safe(
    terms: DataFrame, index: DataFrame, k: int, score: Callable[[Column, Column, Column], Column], named: DataFrame | None = None, often: int = OFTEN
) -> DataFrame:
    """Pairs among which the ``k`` best items of every task are: ``(group, task_id, item, order, bonus, n, overlap)``.

    ``terms(group, task_id, n, token, weight)`` are the distinct tokens of tasks, ``index(group, item, order, bonus, token,
    points)`` those of items. The overlap of a pair is the sum of ``weight * points`` over its shared tokens, and
    ``score(overlap, bonus, n)`` must not fall when the overlap grows; ties go by ``order``, which is distinct in a group.

    Tokens are joined rarest first: pairs that share a token of at most ``often`` items, and those of ``named(group, task_id,
    item)``, are candidates, and get their frequent tokens inside the row. All other pairs share frequent tokens only.
    There, items with the same frequent tokens, points and bonus score alike, so each such signature is joined once; for
    each task only its ``k`` best signatures can hold one of its ``k`` best items, and of these only the first ``k`` items.
    """
    seen = index.groupBy("group", "token").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > often).select("group", "token", F.lit(True).alias("_often"))
    index = index.join(seen, ["group", "token"], "left")
    terms = terms.join(seen, ["group", "token"], "left")
    frequent = F.col("_often").isNotNull()
    # a task's and an item's own text bound these lists
    items = index.groupBy("group", "item", "order", "bonus").agg(F.sort_array(F.collect_list(F.when(frequent, F.struct("token", "points")))).alias("_sig"))
    tasks = terms.groupBy("group", "task_id", "n").agg(F.collect_list(F.when(frequent, F.struct("token", "weight"))).alias("_terms"))
    rare = terms.where(~frequent).join(index.where(~frequent).select("group", "token", "item", "points"), ["group", "token"])
    rare = rare.select("group", "task_id", "item", (F.col("weight") * F.col("points")).alias("_part"))
    if named is not None:
        rare = rare.unionByName(named.select("group", "task_id", "item", F.lit(0).alias("_part")))
    pairs = rare.groupBy("group", "task_id", "item").agg(F.sum("_part").alias("_rare"))
    points = F.map_from_entries("_sig")
    more = F.aggregate("_terms", F.lit(0.0), lambda total, t: total + t["weight"] * F.coalesce(F.try_element_at(points, t["token"]), F.lit(0)))
    known = pairs.join(items, ["group", "item"]).join(tasks, ["group", "task_id"]).select("group", "task_id", "item", "order", "bonus", "n", (F.col("_rare") + more).alias("overlap"))
    kind = Window.partitionBy("group", "_sig", "bonus").orderBy("order")
    alike = items.where(F.size("_sig") > 0).select("*", F.row_number().over(kind).alias("_nth"), F.struct(F.first("order").over(kind)).alias("_first")).where(F.col("_nth") <= k)
    # the first item of a signature stands for it, so that no row for a task and a signature carries the signature's tokens
    heads = alike.where("_nth = 1").select("group", "bonus", "_first", F.explode("_sig").alias("_t"))
    members = alike.select("group", "_first", "item", "order")
    met = terms.where(frequent).join(heads.select("group", F.col("_t.token").alias("token"), F.col("_t.points").alias("points"), "bonus", "_first"), ["group", "token"])
    met = met.groupBy("group", "task_id", "n", "bonus", "_first").agg(F.sum(F.col("weight") * F.col("points")).alias("overlap"))
    best = top_n(met.withColumn("_s", score(F.col("overlap"), F.col("bonus"), F.col("n"))), ["group", "task_id"], [F.desc("_s"), F.col("_first")], k, rank="_place")
    others = best.select("group", "task_id", "n", "_first", "bonus", "overlap").join(members, ["group", "_first"])
    others = others.select("group", "task_id", "item", "order", "bonus", "n", F.col("overlap").cast("double").alias("overlap"))
    # a candidate may come both ways; its whole overlap is the larger one
    return known.unionByName(others).groupBy("group", "task_id", "item", "order", "bonus", "n").agg(F.max("overlap").alias("overlap"))
