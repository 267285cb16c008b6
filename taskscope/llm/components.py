"""Connected components of a graph in DataFrame operations.

Rounds of two star operations (Kiveris et al. 2014): every node links its larger neighbours to the least of its
neighbourhood, then its smaller ones and itself to the least of them. Edges never become more, each round is written to
the shared folder, and rounds end when the edges stay the same: each node is then linked to the least of its component.
Minima are pre-aggregated before they are shuffled, and the joins that follow can be split at a hot node. A graph of at
most ``SMALL`` edges stays in one task, where its rounds need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written

SMALL = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any one type to ``(node, root)``; nodes without an edge to another node aren't returned."""
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(edges.distinct(), "edges")
    before, now = None, _state(edges)
    while now[0] and now != before:
        edges = edges.coalesce(1) if now[0] <= SMALL else edges
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        larger = both.join(least, F.expr("u = _u and v > u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least.select(F.col("u").alias("_u"), "m"), F.expr("u = _u and v <> m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(smaller.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
