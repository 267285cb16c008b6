"""MinHash near-dedup with DartMinHash signatures and banded joining.

Signatures. Each element of a document owns a region as wide as its weight and as long as ranks go. Darts fall into the
regions by hashing (a Poisson process for each element and unit of weight, so equal elements get equal darts in every
document), and each dart names one of ``BANDS * ROWS`` coordinates. Of the darts within a document's region, up to a
rank at which about k ln k + 4k darts are expected whatever the document's weight, the earliest of each coordinate is
kept. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Elements are
shingles of five words (A-Z as a-z), of weight one, or of the number of their occurrences (``weighted``).

Candidates. Equal texts are one node. Nodes that agree in all coordinates of a band share a bucket, and each is verified
on all elements against the bucket's most central node, its leader (the node whose buckets are the largest together). The
sets of elements are made once, for the nodes that share a bucket. Buckets are a group if their leaders have the same most
central leader among those they share a bucket with; so the many buckets of one family of texts are few groups.

Groups that still hold several components are refined until none is left, and no link between two nodes of a bucket is
left out unless they are in one class anyway. A group of at most ``FEW`` members, of ``ELEMENTS`` elements together, is
judged pair by pair inside a task, which returns only what joins components. A larger one gets a pivot P, the elements that most of ``REFERENCES`` members hold, and each member x is kept as its difference D(x) from P.
With c = (1 - threshold) / (1 + threshold), x and y are similar enough if and only if |x diff y| <= c (|x| + |y|), and
|x diff y| = |D(x)| + |D(y)| - 2 |D(x) and D(y)|. So with the slack s(x) = c |x| - |D(x)|:

- where s(x) + s(y) >= 0 the link is sure; one link of each such member to the member with the most slack joins them all;
- a link needs intervals [|D(x)| - c |x|, |D(x)| + c |x|] that meet, by the triangle inequality; members of the largest
  component whose interval meets none outside of it are done;
- any other link needs -(s(x) + s(y)) / 2 common elements in the differences, so both hold one in common among their
  rarest, of which a prefix is enough. Members that share such an element are a smaller group for the next round.

A common element is in the differences of at most half of the references, so groups shrink in each round; variants of one
template part by the place of their edits. Any order of the elements gives the same links; rarity is estimated from the
references. Connected components over the links are the classes.

Defined results: null and empty texts are equal and have no other partner; a text with fewer than five words is one
shingle; rows that repeat are copies; a null id is in its text's class and never names one unless alone with nulls;
rows that share an id with different texts are each in the class of their text, and ``one_of_each`` keeps a row if its
own text's class is named by its id; texts are read whole; other columns are ignored. Elements are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens as T
from .components import connected_components
from .store import written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: Members of a group that are judged pair by pair, and their elements together; and members that tell a larger group's pivot.
FEW, ELEMENTS, REFERENCES = 512, 4 << 20, 16
_SLICE = 2 << 20
_ODD, _DART = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93


def elements(data: np.ndarray, offsets: np.ndarray, size: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text (or their occurrences, numbered), and the first of each text."""
    starts, ends, first = T.words(data, offsets)
    hashes = T.hashes(T.LOWER[data], starts, ends)
    found, at = T.windows(hashes, first, size)
    counts = np.diff(first)
    row = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):  # all words of a short text are its one shingle
        whole = np.array([T.windows(hashes[first[k]:first[k + 1]], np.array([0, counts[k]]), int(counts[k]))[0][0] for k in short], np.uint64)
        found, row = np.concatenate([found, whole]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    if weighted:
        head = np.flatnonzero(new)
        nth = np.arange(len(found)) - np.repeat(head, np.diff(np.append(head, len(found))))
        found = T.mix(found + nth.astype(np.uint64) * np.uint64(_ODD))
    else:
        found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(offsets)))


def signatures(found: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash of each text: the earliest dart of each of ``k`` coordinates; zeros for a text without elements."""
    n = len(first) - 1
    size = np.diff(first)
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    expected = k * (math.log(k) + 4)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        own = np.repeat(todo, size[todo])
        at = np.arange(len(own)) + np.repeat(first[todo] - (np.cumsum(size[todo]) - size[todo]), size[todo])
        x = found[at]
        limit = (expected / size)[own]
        rank = np.zeros(len(x))
        step = 0
        while len(x):
            step += 1
            dart = T.mix(x + np.uint64(step * _DART & (1 << 64) - 1))
            # the gap to the element's next dart
            rank = rank - np.log((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            live = rank <= limit
            x, own, rank, limit, dart = x[live], own[live], rank[live], limit[live], dart[live]
            named = T.mix(dart + np.uint64(_ODD))
            place = own * k + ((named >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            key = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | named & np.uint64(0xFFFFFFFF)
            np.minimum.at(best, place, key)
        open_ = (best.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        todo = np.flatnonzero(open_ & (size > 0))
        expected *= 2  # throw farther where a coordinate has no dart yet
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)
    out[size == 0] = 0
    return out


def _signed(size: int, weighted: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                found, first = elements(*T.flat(batch.column("text")), size, weighted)
                sig = signatures(found, first, k)
                some = np.diff(first) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("node"), pa.array([s.tobytes() if ok else None for s, ok in zip(sig, some, strict=True)], pa.binary())], ["id", "node", "sig"],
                )

    return run


def _sets(size: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                found, first = elements(*T.flat(batch.column("text")), size, weighted)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([np.sort(found[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["node", "elements"],
                )

    return run


def _set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = _set(x), _set(y)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= threshold * max(len(x), len(y)) else 0
                ok.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, np.ndarray]]]]:
    """Groups whose rows lie together, as lists of (x, root, elements); a group is small."""
    now, held = None, []
    for b in batches:
        for g, x, root, e in zip(b.column("g").to_pylist(), b.column("x").to_pylist(), b.column("root").to_pylist(), b.column("elements"), strict=True):
            if g != now and held:
                yield now, held
                held = []
            now = g
            held.append((x, root, _set(e)))
    if held:
        yield now, held


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    same = every[1:] == every[:-1]
    shared = np.append(same, False) | np.append(False, same)  # what one set alone holds is in no intersection
    both = np.diag([float(len(x)) for x in sets])
    every, owner = every[shared], owner[shared]
    if not len(every):
        return both
    column = np.cumsum(np.append(False, every[1:] != every[:-1]))
    step = 1 << 13
    cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + step, step))
    off = np.zeros((len(sets), len(sets)))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((len(sets), min(step, int(column[-1]) + 1 - k * step)), np.float32)
        held[owner[a:b], column[a:b] - k * step] = 1
        off += held @ held.T
    np.fill_diagonal(off, np.diag(both))
    return off


def _judged(threshold: float):
    """Links that join the components of each small group; every pair is judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, rows in _groups(batches):
            size = np.array([len(e) for _, _, e in rows])
            both = _overlaps([e for _, _, e in rows])
            alike = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            part = {root: root for _, root, _ in rows}

            def top(r, part=part):
                while part[r] != r:
                    r = part[r]
                return r

            for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
                r, t = top(rows[i][1]), top(rows[j][1])
                if r != t:  # a link inside a component tells nothing new
                    part[r] = t
                    found.append((rows[i][0], rows[j][0]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that several references of a group hold, and by how many."""
    for g, rows in _groups(batches):
        e, n = np.unique(np.concatenate([x for _, _, x in rows]), return_counts=True)
        some = 2 * n > min(2, len(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array([g], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([e[some].tobytes()], pa.binary()), pa.array([n[some].astype(np.uint8).tobytes()], pa.binary())], ["g", "references", "pivot", "held"],
        )


def _differences(c: float):
    """Each member's difference from its group's pivot, rarest elements first, and its slack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slack, diff = [], []
            for n, pivot, held, own in zip(b.column("references").to_pylist(), b.column("pivot"), b.column("held"), b.column("elements"), strict=True):
                pivot, held, own = _set(pivot), np.frombuffer(held.as_buffer(), np.uint8).astype(np.int64), _set(own)
                most = 2 * held > n
                gone = np.setdiff1d(pivot[most], own, assume_unique=True)
                more = np.setdiff1d(own, pivot[most], assume_unique=True)
                d = np.concatenate([more, gone])
                at = np.minimum(np.searchsorted(pivot, d), max(0, len(pivot) - 1))
                seen = np.where(pivot[at] == d, held[at], 0) if len(pivot) else np.zeros(len(d), np.int64)
                often = np.where(np.arange(len(d)) < len(more), seen, n - seen)
                diff.append(d[np.lexsort((d, often))].tobytes())
                slack.append(c * len(own) - len(d))
            reach = [c * len(e.as_buffer()) / 8 + len(d) / 8 for e, d in zip(b.column("elements"), diff, strict=True)]
            columns = [b.column("g"), b.column("x"), b.column("size"), b.column("root"), b.column("largest"), pa.array(slack, pa.float64()), pa.array(reach, pa.float64()), pa.array(diff, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "x", "size", "root", "largest", "slack", "reach", "diff"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smaller groups of a member: one for each element of its prefix."""
    for b in batches:
        found, many = [], []
        for g, own, most, diff in zip(b.column("g").to_numpy(), b.column("slack").to_pylist(), b.column("most").to_pylist(), b.column("diff"), strict=True):
            d = _set(diff)
            need = max(1, math.ceil(-(own + most) / 2 - 1e-9))
            d = d[:max(0, len(d) - need + 1)]
            found.append(T.mix(d ^ T.mix(np.array([g], np.int64).view(np.uint64) + np.uint64(_ODD))))
            many.append(len(d))
        key = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(np.repeat(b.column(c).to_numpy(), many)) for c in ("x", "size")]], ["g", "x", "size"])


_PAIR = "a long, b long"


def _refined(groups: DataFrame, sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """``links`` and what joins members of a group that they leave in different components; groups are (g, x, size of x) without repeated rows, whose pairs of two are judged."""
    judged = 2
    while True:
        root = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("_node"), "root")
        placed = written(groups.join(root, F.expr("x = _node"), "left").select("g", "x", "size", F.coalesce("root", "x").alias("root")), "near-placed")
        parts = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("x")).alias("same"))
        parts = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(F.struct("n", "root")).alias("most"), F.bit_xor("same").alias("same"))
        # groups of the same members are one
        mixed = parts.where(f"n > most.n and n > {judged}").groupBy("n", "total", "same").agg(F.min(F.struct("g", "most.root")).alias("one"))
        mixed = mixed.select(((F.col("n") <= FEW) & (F.col("total") <= ELEMENTS)).alias("few"), "one.g", F.col("one.root").alias("largest"))
        members = written(placed.join(mixed, "g").select("g", "x", "size", "root", "few", "largest"), "near-mixed")
        if members.isEmpty():
            return links
        held = lambda rows: rows.join(sets.select(F.col("node").alias("_node"), "elements"), F.expr("x = _node")).drop("_node")
        few = held(members.where("few").select("g", "x", "root")).repartition("g").sortWithinPartitions("g", "x").mapInArrow(_judged(threshold), _PAIR)
        large = members.where("not few").select("g", "x", "size", "root", "largest")
        order = Window.partitionBy("g").orderBy(F.xxhash64("g", "x"), "x")
        some = held(large.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= REFERENCES).select("g", "x", "root")).repartition("g").sortWithinPartitions("g", "x")
        pivots = written(some.mapInArrow(_pivots, "g long, references int, pivot binary, held binary"), "near-pivots")
        apart = held(large).join(pivots, "g").select("g", "x", "size", "root", "largest", "references", "pivot", "held", "elements")
        apart = written(apart.mapInArrow(_differences((1 - threshold) / (1 + threshold)), "g long, x long, size long, root long, largest long, slack double, reach double, diff binary"), "near-differences")
        # | |D(x)| - |D(y)| | is at most |x diff y|: a link needs slack(x) >= -reach(y) and slack(y) >= -reach(x)
        inside = F.col("root") == F.col("largest")
        ends = [f(F.when(i, F.col(c))).alias(f"{n}_{c}") for n, i in (("in", inside), ("out", ~inside)) for f, c in ((F.max, "slack"), (F.max, "reach"))]
        best = written(apart.groupBy("g").agg(F.max(F.struct("slack", "x")).alias("best"), *ends).select("g", F.col("best.slack").alias("most"), F.col("best.x").alias("y"), *[f"{n}_{c}" for n in ("in", "out") for c in ("slack", "reach")]), "near-best")
        known = apart.join(best, "g")
        sure = known.where("slack + most >= -1e-9 and x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # members of the largest component matter only where one outside of it may be near enough
        wanted = known.where("root <> largest or (slack >= -out_reach - 1e-9 and out_slack >= -reach - 1e-9)")
        keys = written(wanted.select("g", "x", "size", "slack", "most", "diff").mapInArrow(_prefixes, "g long, x long, size long"), "near-prefixes")
        shared = keys.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
        links = written(links.unionAll(few).unionAll(sure), "near-links")
        groups, judged = written(keys.join(shared, "g"), "near-groups"), 1


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, weighted: bool = False,
) -> DataFrame:
    """One row per document: (id, class_id, class_size). A class is named by its least id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    kind = dict(texts.dtypes)["id"]
    signed = written(texts.mapInArrow(_signed(size, weighted, bands * rows), f"id {kind}, node long, sig binary"), "near-signatures")
    reps = written(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "near-texts")
    band = [F.xxhash64(F.lit(b), F.substring("sig", b * rows * 4 + 1, rows * 4)) for b in range(bands)]
    keys = reps.where("sig is not null").select("node", F.array(*band).alias("keys"))
    spread = keys.select("node", F.explode("keys").alias("key"))
    sizes = spread.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(spread.join(sizes, "key"), "near-buckets")
    central = shared.groupBy("node").agg(F.sum("n").alias("c"))
    members = written(shared.select("key", "node").join(central, "node"), "near-members")
    leader = members.groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("g"))
    led = written(members.join(leader, "key").select("g", F.col("node").alias("x")).distinct(), "near-led")
    # one row of each text: by its id too, as copies may be many
    # one plan at every size: the ids that are wanted grow with the corpus, so they aren't broadcast while they are few
    wanted = members.select("node").distinct().join(reps, "node").select(F.col("node").alias("_node"), F.col("id").alias("_id"))
    found = texts.join(wanted.hint("merge"), F.expr("node = _node and id <=> _id")).select("node", "text")
    sets = written(found.mapInArrow(_sets(size, weighted), "node long, elements binary").dropDuplicates(["node"]), "near-elements")
    pairs = led.where("x <> g").select(F.least("x", "g").alias("a"), F.greatest("x", "g").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(_verified(threshold), _PAIR), "near-links")
    # leaders go over to the most central one that they share a bucket with, and their members with them
    leaders = led.select("g").distinct().join(central, F.expr("g = node")).select("g", "c")
    top = led.join(leaders, "g").groupBy("x").agg(F.max(F.struct("c", "g"))["g"].alias("top")).select(F.col("x").alias("_g"), "top")
    sizes = sets.select(F.col("node").alias("x"), (F.octet_length("elements") / 8).cast("long").alias("size"))
    groups = written(led.join(top, F.expr("g = _g")).select(F.col("top").alias("g"), "x").distinct().join(sizes, "x").select("g", "x", "size"), "near-groups")
    links = _refined(groups, sets, links, threshold)
    root = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = written(root.unionAll(root.select(F.col("root").alias("node"), "root").distinct()).join(reps.select("node", "id", "copies"), "node"), "near-linked")
    named = linked.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    linked = linked.select("node", "root").join(named, "root").select(F.col("node").alias("_linked"), "class_id", F.col("class_size").alias("_size"))
    nodes = reps.join(linked, F.expr("node = _linked"), "left").select(
        F.col("node").alias("_node"), F.when(F.col("_linked").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("_size", "copies").alias("class_size"),
    )
    return signed.select("id", "node").join(nodes, F.expr("node = _node")).select("id", "class_id", "class_size")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id names their class, and those without an id's class, with all their columns."""
    kept = classes(docs, id_col, text_col, **options).where("id <=> class_id").select(F.col("id").alias("__kept")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumnRenamed("id", "doc_id")
