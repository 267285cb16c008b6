"""Nearest neighbours by collision counting on query-centred windows.

Index. Every vector is scaled by the largest norm and gets one more component that makes its norm one, so the largest
inner product is the least distance. The rows are dealt out evenly in blocks. A block is projected on ``lines`` random
directions (orthogonal ones as far as there are dimensions) and keeps one sorted array of projections for each.

Search. On every line, a window is centred at the query's own projection. A vector collides where it is in the window;
one that collides on at least ``threshold`` lines is verified by its inner product with the query, in double precision.
Virtual rehashing widens the windows of the same arrays from radius to radius, and only what is new in a window is
counted. A vector at a distance of the radius passes the threshold with the probability of ``CONFIDENCE`` standard
deviations, so a query is done when its k-th best distance is within the radius: nearer vectors pass more likely. There
is no cap on candidates; a window that has grown over all rows verifies all of them.

Blocks of queries meet chains of index blocks; along a chain, the radius starts at the k-th distance that is known. The
best k of each chain are ranked by query. A block, a chain and a block of queries are bounded; nothing but the lines,
counts and the largest norm is on the driver.

Defined results: a vector that is null, empty or zero or holds null or non-finite components takes no part, neither as a
query; shorter vectors count as padded with zeros; rows that repeat are candidates of each other; a row with a null id
is a candidate only, behind others of its score; queries with fewer candidates than k return all; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import settings, written

K = 20
LINES = 64
#: Standard deviations by which a vector at the radius may miss its expected collisions.
CONFIDENCE = 1.0
BLOCK, CHAIN, QUERIES = 4096, 4, 2048
GROWTH = 1.5
_SEED = 11
#: Part of the vectors at a distance of the half window that collide on a line.
_WITHIN = math.erf(1 / math.sqrt(2))


def threshold(lines: int, confidence: float = CONFIDENCE) -> int:
    """Collisions from which a vector is verified."""
    return max(1, math.floor(lines * _WITHIN - confidence * math.sqrt(lines * _WITHIN * (1 - _WITHIN))))


def directions(lines: int, dimension: int) -> np.ndarray:
    """Random directions, as long as the root of the dimension; those of one rotation are orthogonal."""
    random = np.random.default_rng(_SEED)
    turns = [np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(-(-lines // dimension))]
    return np.concatenate(turns, axis=1)[:, :lines] * math.sqrt(dimension)


def matrix(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that take part, padded with zeros, and their rows."""
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy())
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy()
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(size)) > 0
    some = np.bincount(row[values != 0], minlength=len(size)) > 0
    use = np.flatnonzero(some & ~bad)
    out = np.zeros((len(size), dimension or int(size.max(initial=0))))
    out[row, np.arange(len(values)) - np.repeat(first, size)] = values
    return out[use], use


def norms(x: np.ndarray) -> np.ndarray:
    """Norms that don't overflow."""
    top = np.abs(x).max(axis=1, initial=0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, use = matrix(b.column("vector"))
        yield pa.RecordBatch.from_arrays([pa.array([len(use)], pa.int64()), pa.array([x.shape[1] if len(use) else 0]), pa.array([norms(x).max(initial=0.0)])], ["n", "dimension", "norm"])


_BLOCK = "block long, ids binary, without_id binary, vectors binary, sorted binary, rows binary"


def _indexed(lines: np.ndarray, dimension: int, norm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, none, vectors = [], [], []
        for b in batches:
            x, use = matrix(b.column("vector"), dimension)
            i = b.column("id").take(pa.array(use))
            none.append(i.is_null().to_numpy(zero_copy_only=False))
            ids.append(i.fill_null(0).cast(pa.int64()).to_numpy())
            vectors.append(x)
        if not sum(map(len, ids)):
            return
        x = np.concatenate(vectors)
        unit = x / norm
        unit = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))])
        on = (unit @ lines).T
        order = np.argsort(on, axis=1, kind="stable")
        ranked = np.take_along_axis(on, order, axis=1).astype(np.float32)
        blobs = [np.concatenate(ids), np.concatenate(none).astype(np.uint8), x, ranked, order.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in blobs]], ["block", "ids", "without_id", "vectors", "sorted", "rows"],
        )

    return run


_QUERY = "id long, block long, row int, vector binary"


def _asked(every: int, dimension: int):
    """Rows of the index whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, none, vectors in zip(*(b.column(c) for c in ("block", "ids", "without_id", "vectors")), strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                row = np.flatnonzero((ids % every == 0) & (np.frombuffer(none.as_buffer(), np.uint8) == 0))
                x = np.frombuffer(vectors.as_buffer()).reshape(-1, dimension)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(np.full(len(row), block.as_py())), pa.array(row.astype(np.int32)), pa.array([v.tobytes() for v in x[row]], pa.binary())], ["id", "block", "row", "vector"],
                )

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of a task as one row."""
    parts = [[], [], [], []]
    for b in batches:
        for k, c in enumerate(("id", "block", "row")):
            parts[k].append(b.column(c).to_numpy())
        parts[3] += b.column("vector").to_pylist()
    if parts[3]:
        blobs = [np.concatenate(parts[0]).tobytes(), np.concatenate(parts[1]).tobytes(), np.concatenate(parts[2]).astype(np.int32).tobytes(), b"".join(parts[3])]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs]], ["asked", "ids", "blocks", "rows", "vectors"])


class Search:
    """The best k of a block of queries, block by block of the index."""

    def __init__(self, vectors: np.ndarray, own: tuple[np.ndarray, np.ndarray], lines: np.ndarray, norm: float, k: int, least: int):
        self.q, self.own, self.k, self.least = vectors, own, k, least
        length = norms(vectors)
        self.scale = length * norm
        self.on = (np.column_stack([vectors / length[:, None], np.zeros(len(vectors))]) @ lines).astype(np.float32)
        empty = np.zeros(0)
        self.best = [(empty, np.zeros(0, np.int64), np.zeros(0, bool))] * len(vectors)  # scores, ids, whether an id is null
        self.reach = np.full(len(vectors), np.inf)  # distance of the k-th best

    def _keep(self, at: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, n = self.best[at]
        if len(s) == self.k:
            better = score >= s[-1]
            score, ids, none = score[better], ids[better], none[better]
        if len(score) > 4 * self.k:  # all that reach the k-th of these alone
            better = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, none = score[better], ids[better], none[better]
        s, i, n = np.append(s, score), np.append(i, ids), np.append(n, none)
        order = np.lexsort((i, n, -s))[:self.k]
        self.best[at] = s[order], i[order], n[order]
        if len(order) == self.k:
            self.reach[at] = math.sqrt(max(0.0, 2 - 2 * s[order[-1]] / self.scale[at]))

    def go(self, block: int, ids: np.ndarray, none: np.ndarray, vectors: np.ndarray, ranked: np.ndarray, order: np.ndarray) -> int:
        """Search one block of the index; returns how many candidates were verified."""
        n, m, checked = len(ids), len(ranked), 0
        # the first windows hold a few rows of each line
        few = min(n - 1, max(1, n // 64))
        start = float(np.median(ranked[:, few:] - ranked[:, :-few])) / 2 if n > 1 else 1.0
        radius = np.where(np.isfinite(self.reach), self.reach, max(start, 1e-6))
        live = np.arange(len(self.q))
        counts = np.zeros((len(self.q), n), np.uint8 if m < 256 else np.uint16)
        done = np.zeros((len(self.q), n), bool)
        mine = np.flatnonzero(self.own[0] == block)
        done[mine, self.own[1][mine]] = True  # a query isn't its own neighbour
        low = high = None
        while len(live):
            h = radius[live].astype(np.float32)
            new_low, new_high = np.empty((len(live), m), np.int64), np.empty((len(live), m), np.int64)
            for j in range(m):
                new_low[:, j] = np.searchsorted(ranked[j], self.on[live, j] - h, "left")
                new_high[:, j] = np.searchsorted(ranked[j], self.on[live, j] + h, "right")
            before = [(a, a) for a in new_low] if low is None else zip(low, high, strict=True)
            for at, a, b, (c, d) in zip(live.tolist(), new_low.tolist(), new_high.tolist(), before, strict=True):
                if low is None:
                    hits = [o[x:y] for o, x, y in zip(order, a, b, strict=True)]
                else:
                    hits = [o[x:y] for o, x, y in zip(order, a, c.tolist(), strict=True)] + [o[x:y] for o, x, y in zip(order, d.tolist(), b, strict=True)]
                counts[at] += np.bincount(np.concatenate(hits), minlength=n).astype(counts.dtype)
                found = np.flatnonzero((counts[at] >= self.least) & ~done[at])
                if len(found):
                    done[at, found] = True
                    checked += len(found)
                    self._keep(at, vectors[found] @ self.q[at], ids[found], none[found])
            low, high = new_low, new_high
            whole = ((low == 0) & (high == n)).all(axis=1)
            more = (radius[live] < self.reach[live]) & ~whole
            low, high, live = low[more], high[more], live[more]
            radius[live] = np.minimum(radius[live] * GROWTH, self.reach[live])
        return checked


_FOUND = "block long, row int, query_id long, vec_id long, score double"


def _searched(lines: np.ndarray, dimension: int, norm: float, k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, asked = None, None

        def out():
            if search is None:
                return
            n = [len(s) for s, _, _ in search.best]
            score, ids, none = (np.concatenate([b[c] for b in search.best]) for c in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked[1], n)), pa.array(np.repeat(asked[2], n)), pa.array(np.repeat(asked[0], n)), pa.array(ids, mask=none.astype(bool)), pa.array(score)],
                ["block", "row", "query_id", "vec_id", "score"],
            )

        for b in batches:
            blobs = [b.column(c) for c in ("block", "a", "b", "c", "vectors", "sorted")]
            for block, x, y, z, vectors, ranked in zip(*blobs, strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64)
                vectors = np.frombuffer(vectors.as_buffer()).reshape(-1, dimension)
                if block.as_py() is None:  # the queries come before their chain of blocks
                    yield from out()
                    asked = x, np.frombuffer(y.as_buffer(), np.int64), np.frombuffer(z.as_buffer(), np.int32)
                    search = Search(vectors, asked[1:], lines, norm, k, least)
                    continue
                order = np.frombuffer(z.as_buffer(), np.int32).reshape(lines.shape[1], -1).astype(np.int64)
                ranked = np.frombuffer(ranked.as_buffer(), np.float32).reshape(lines.shape[1], -1)
                search.go(block.as_py(), x, np.frombuffer(y.as_buffer(), np.uint8).astype(bool), vectors, ranked, order)
        yield from out()

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 20, lines: int = LINES, confidence: float = CONFIDENCE) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``: (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    n, dimension, norm = rows.select("vector").mapInArrow(_measured, "n long, dimension long, norm double").agg(F.sum("n"), F.max("dimension"), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ways, least = directions(lines, dimension + 1), threshold(lines, confidence)
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
        index = written(rows.repartition(-(-n // BLOCK)).mapInArrow(_indexed(ways, dimension, norm), _BLOCK), "neighbour-index")
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # rows of some megabytes each
        asked = written(index.mapInArrow(_asked(every, dimension), _QUERY), "neighbour-queries")
        parts, blocks = -(-asked.count() // QUERIES), index.count()
        chains = -(-blocks // CHAIN)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = written(asked.repartition(parts).mapInArrow(_gathered, "asked long, ids binary, blocks binary, rows binary, vectors binary"), "neighbour-asked")
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("asked", count(chains).alias("chain"), F.lit(None).cast("long").alias("block"), F.col("ids").alias("a"), F.col("blocks").alias("b"), F.col("rows").alias("c"), "vectors", F.lit(None).cast("binary").alias("sorted"))
    right = index.select(count(parts).alias("asked"), F.pmod("block", F.lit(chains).cast("long")).alias("chain"), "block", F.col("ids").alias("a"), F.col("without_id").alias("b"), F.col("rows").alias("c"), "vectors", "sorted")
    cells = left.unionAll(right).repartition("asked", "chain").sortWithinPartitions("asked", "chain", F.asc_nulls_first("block"))
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        found = written(cells.mapInArrow(_searched(ways, dimension, norm, k, least), _FOUND), "neighbours")
    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
