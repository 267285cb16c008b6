"""Import graphs and catalog relation graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import paths
from ..functions.skew import top_n
from ..session import checkpointed


def _import_candidates(base: Column) -> Column:
    """Ordered file paths a relative import may mean."""
    ext = [F.concat(base, F.lit(e)) for e in C.IMPORT_EXTENSIONS]
    index = [F.concat(base, F.lit("/index" + e)) for e in C.IMPORT_EXTENSIONS]
    return F.array(base, *ext, *index)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of the import graph: the first existing of thirteen candidates per specifier.

    ``imports(repo, path, specifier)``, ``files(repo, path)`` → ``edges(repo, src, dst)``.
    """
    base = paths.normalize(paths.join(paths.dirname(F.col("path")), F.col("specifier")))
    wanted = imports.select("repo", "path", "specifier", base.alias("_base")).where(F.col("_base").isNotNull())
    wanted = wanted.select("repo", F.col("path").alias("src"), "specifier", F.posexplode(_import_candidates(F.col("_base"))).alias("_rank", "dst"))
    known = files.select("repo", F.col("path").alias("dst")).distinct()
    hits = wanted.join(known, ["repo", "dst"])
    best = hits.groupBy("repo", "src", "specifier").agg(F.min_by("dst", "_rank").alias("dst"))
    return best.select("repo", "src", "dst").distinct()


def broken_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports whose exact target does not exist."""
    base = paths.normalize(paths.join(paths.dirname(F.col("path")), F.col("specifier")))
    wanted = imports.where(F.col("specifier").startswith(".")).withColumn("_dst", base)
    known = files.select("repo", F.col("path").alias("_dst")).distinct()
    return wanted.join(known, ["repo", "_dst"], "left_anti").select("repo", "path", "specifier")


def build_edges(pairs: DataFrame, kind: str = "imports") -> DataFrame:
    """Distinct typed edges; incoming edges are the same table read backwards."""
    return pairs.select("repo", "src", "dst").distinct().withColumn("type", F.lit(kind))


def expand_imports(seeds: DataFrame, edges: DataFrame, limit: int = 6) -> DataFrame:
    """Files one edge away from the seeds of a task: 4 per import, 5 per importer.

    ``seeds(task_id, repo, path)``. Seeds are not returned.
    """
    seeds = seeds.select("task_id", "repo", "path").distinct()
    out = seeds.join(edges.select("repo", F.col("src").alias("path"), F.col("dst").alias("_to")), ["repo", "path"]).select(
        "task_id", F.col("_to").alias("path"), F.lit(4).alias("points"), F.concat(F.lit("imports:"), F.col("path")).alias("reason")
    )
    back = seeds.join(edges.select("repo", F.col("dst").alias("path"), F.col("src").alias("_to")), ["repo", "path"]).select(
        "task_id", F.col("_to").alias("path"), F.lit(5).alias("points"), F.concat(F.lit("imported-by:"), F.col("path")).alias("reason")
    )
    grouped = out.unionByName(back).groupBy("task_id", "path").agg(
        F.sum("points").cast("bigint").alias("score"), F.count("*").alias("n_reasons"), F.min("reason").alias("first_reason")
    )
    fresh = grouped.join(seeds.select("task_id", "path"), ["task_id", "path"], "left_anti")
    return top_n(fresh, ["task_id"], [F.desc("score"), F.col("path")], limit).withColumn("source", F.lit("import-graph"))


def catalog_id(col: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), "[^a-z0-9_.:-]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def catalog_edges(catalog: DataFrame) -> DataFrame:
    """Typed relations of catalog items: related, depends-on, requires; distinct.

    ``pos`` keeps the order of the relations of one item.
    """
    kinds = [("related_skills", "related_to"), ("depends_on", "depends_on"), ("requires", "requires")]
    tagged = F.concat(*[_tag(field, kind) for field, kind in kinds])
    rows = catalog.select(catalog_id(F.coalesce("id", "name")).alias("src"), F.posexplode(tagged).alias("pos", "_e"))
    edges = rows.select("src", catalog_id(F.col("_e.to")).alias("dst"), F.col("_e.type").alias("type"), "pos")
    return edges.where((F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst", "type").agg(F.min("pos").alias("pos"))


def _tag(field: str, kind: str) -> Column:
    values = F.coalesce(F.col("meta")[field], F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.struct(v.alias("to"), F.lit(kind).alias("type")))


def expand_catalog(
    seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 1, limit: int = 6
) -> DataFrame:
    """Breadth-first expansion of each task's seeds over catalog relations.

    ``seeds(task_id, id, rank)``, ``edges(src, dst, type, pos)``, ``nodes(id)``. A target is
    visited once, through its first edge; unknown targets are visited and not
    returned. At most ``limit`` items per task, in queue order, with score 0.62.
    """
    front = seeds.select("task_id", "id", F.col("rank").cast("long").alias("place"))
    visited = front.select("task_id", "id").distinct()
    # Derived names are far longer than the keys from which their size is estimated: a relation table that grows with the
    # catalog is never sent whole through the driver.
    edges, nodes = edges.hint("shuffle_merge"), nodes.select("id").distinct().hint("shuffle_merge")
    found = None
    for level in range(1, depth + 1):
        steps = front.join(edges, front["id"] == edges["src"]).select(
            "task_id", F.col("dst").alias("id"), F.col("src"), "type", F.struct("place", "pos", "dst").alias("_o")
        )
        fresh = steps.join(visited, ["task_id", "id"], "left_anti")
        firsts = fresh.groupBy("task_id", "id").agg(
            F.min("_o").alias("_o"), F.min_by(F.struct("src", "type"), "_o").alias("_via")
        )
        # queue order of this level, the starting order of the next one
        # one window holds the new items of one task
        order = Window.partitionBy("task_id").orderBy("_o")
        front = firsts.withColumn("place", F.row_number().over(order))
        if 2 < depth and level < depth:  # a deep search would plan every level anew for each later one
            front = checkpointed(front)
        reached = front.select("task_id", "id", F.lit(level).alias("level"), "_o", "_via")
        found = reached if found is None else found.unionByName(reached)
        visited = visited.unionByName(front.select("task_id", "id"))
        front = front.select("task_id", "id", F.col("place").cast("long").alias("place"))
    known = found.join(nodes, "id", "left_semi")
    ranked = top_n(known, ["task_id"], [F.col("level"), F.col("_o")], limit)
    return ranked.select(
        "task_id", "id", "level", "rank", F.lit(0.62).alias("score"), F.lit(1.0).alias("graph_score"),
        F.concat(F.lit("skill-graph:"), F.col("_via.type"), F.lit(":"), F.col("_via.src")).alias("reason"),
    )
