"""How far the sources of a language are apart in the words they use.

Identical texts of a language collapse to one row, whose copies in each source are counted apart and come to it as a list
(several lists, each with the text, where there are over ``_LIST`` sources). A task tokenizes each text once, weights its
terms by the copies and sums documents and occurrences by (language, source, term). The sums of all tasks meet by
(language, term), where terms in too few documents go. All that follows works on the counts of kept terms.

Pairs of sources are evaluated sparsely and exactly. Most terms occur in neither source of a pair, where the value f is
the same for all: ``f00``. With ``f(p, q)`` for terms in both, and ``p0``, ``q0`` the share of a term that doesn't occur,

    sum f = V f00 + sum over terms of the first (f(p, q0) - f00) + sum over terms of the second (f(p0, q) - f00)
                  + sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f00).

The two single sums need only how many terms a source has of each count. The last one is summed in cells of a slice of
terms by two blocks of sources, so a term that all sources share is met in bounded cells, and a cell sends one row for
each pair of its sources, not for each term.

Defined results: null text, lang and source count as empty; a text without terms keeps its group; rows that repeat are
copies; texts are read whole, however long; a language without kept terms has value 0 for its pairs and no terms; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tokens as T
from .store import written

#: Documents of the language that a kept term is in, at least.
LEAST = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK = 64  # sources in a block
CELL = 1 << 16  # counts in a slice of terms, about
_SLICE = 4 << 20
_TOGETHER = 32 << 20  # bytes of text whose counts are summed before they are sent
_LIST = 4096  # sources in a list
_PAIRS = 1 << 20  # pairs of counts that are evaluated at once

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the texts of a task, each text tokenized once and weighted by its copies in each source; summed by (lang, source, term)."""
    held, size = [], 0

    def out():
        total = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
        yield from total.select(["lang", "source", "term", "docs_sum", "n_sum"]).rename_columns(["lang", "source", "term", "docs", "n"]).to_batches(1 << 16)

    for whole in batches:
        for batch in T.slices(whole, "text", _SLICE):
            held.append(_weighted(batch))
            size += batch.column("text").nbytes
            if size >= _TOGETHER:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _weighted(batch: pa.RecordBatch) -> pa.Table:
    data, offsets = T.flat(batch.column("text"))
    starts, ends, first = T.words(data, offsets, ~_LETTER)
    length = ends - starts
    stop = np.append(0, np.cumsum(length))
    at = np.arange(int(stop[-1])) + np.repeat(starts - stop[:-1], length)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(T.LOWER[data][at])).dictionary_encode()
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    key, tf = np.unique(row << 32 | words.indices.to_numpy(), return_counts=True)
    row, term = key >> 32, key & 0xFFFFFFFF
    # the sources of each text with their copies
    sources = batch.column("sources")
    many = sources.value_lengths().to_numpy().astype(np.int64)
    flat = sources.flatten()
    names = pa.StructArray.from_arrays([batch.column("lang").take(pa.array(np.repeat(np.arange(batch.num_rows), many))), flat.field("source")], ["lang", "source"])
    code = {}
    group = np.array([code.setdefault((x["lang"], x["source"]), len(code)) for x in names.to_pylist()], np.int64)
    copies = flat.field("copies").to_numpy()
    entry = np.repeat(np.arange(len(row)), many[row])
    which = np.arange(len(entry)) + np.repeat((np.cumsum(many) - many)[row] - (np.cumsum(many[row]) - many[row]), many[row])
    key = group[which] << 32 | term[entry]
    docs, n = copies[which], copies[which] * tf[entry]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    docs, n = (np.add.reduceat(x[order], head) if len(key) else x for x in (docs, n))
    group, term = key[head] >> 32, key[head] & 0xFFFFFFFF
    of = pa.array(group)
    lang, source = (pa.array([c[k] for c in code], pa.string()) for k in (0, 1))
    return pa.table({"lang": lang.take(of), "source": source.take(of), "term": words.dictionary.take(pa.array(term)).cast(pa.string()), "docs": pa.array(docs, pa.int64()), "n": pa.array(n, pa.int64())})


def term_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, lang_n) of every term in at least ``least`` documents of its language, and the (lang, source) groups that occur."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = written(rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("copies")), "copies")
    groups = written(copies.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("texts")), "groups")
    # a text's sources come in lists of bounded length; nearly always there is one
    lists = max(1, -(-groups.count() // _LIST))
    packed = copies.groupBy("lang", "digest", F.pmod(F.xxhash64("source"), F.lit(lists).cast("long")).alias("list")).agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    # texts are shuffled once: they stay where they were collapsed, and only the sums of a task go on
    parts = texts.join(packed, ["lang", "digest"]).select("lang", "text", "sources").mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    of_lang = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_docs": F.sum("docs").over(of_lang), "lang_n": F.sum("n").over(of_lang)}).where(F.col("lang_docs") >= least)
    return written(counts.select("lang", "source", "term", "n", "lang_n"), "term-counts"), groups.select("lang", "source")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exactly: the product may exceed 64 bits."""
    exact = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", exact, total.cast("decimal(20,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that two sources share, of cells that lie together."""
    names = ["lang", "slice", "i", "j"]
    held: list[pa.RecordBatch] = []
    now = None

    def out(held):
        table = pa.Table.from_batches(held).combine_chunks()
        lang, _, i, j = (table[c][0].as_py() for c in names)
        block, source, share, none = (table[c].to_numpy() for c in ("block", "source_id", "p", "p0"))
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")
        block, source, share, none, term = (x[order] for x in (block, source, share, none, term))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        first, last = (np.searchsorted(term[right], term[left], s) for s in ("left", "right"))
        width = last - first
        total = np.cumsum(width)
        sums: dict[tuple[int, int], int] = {}
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            w = width[at:to]
            a = np.repeat(left[at:to], w)
            b = right[np.arange(int(w.sum())) + np.repeat(first[at:to] - (np.cumsum(w) - w), w)]
            keep = source[a] < source[b]
            a, b = a[keep], b[keep]
            value = _f_of(share[a], share[b]) - _f_of(share[a], none[b]) - _f_of(none[a], share[b]) + _f_of(none[a], none[b])
            key, back = np.unique(source[a] << 32 | source[b], return_inverse=True)
            part = np.zeros(len(key), np.int64)
            np.add.at(part, back, value)
            for k, v in zip(key.tolist(), part.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
            at = to
        keys = list(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array([k >> 32 for k in keys], pa.int64()), pa.array([k & 0xFFFFFFFF for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.int64())],
            ["lang", "a", "b", "value"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for c in names:
            new |= pc.not_equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        heads = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            key = tuple(batch[c][a].as_py() for c in names)
            if key != now and held:
                yield out(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield out(held)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the ``top`` terms a source uses more than its language."""
    kept, groups = term_counts(docs, least, text_col, lang_col, source_col)
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    every = F.col("total") + 2 * F.col("v")
    # the sources of a language get numbers, in blocks
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    sources = written(sizes.select("lang", "source", "total", "v", "lang_total", number.alias("source_id"), F.when(F.col("v") > 0, _share(F.lit(0), F.when(every > 0, every))).alias("p0")), "sources")
    shares = kept.join(sources, ["lang", "source"]).select(
        "lang", "source", "source_id", "term", "n", "p0", "v", _share(F.col("n"), every).alias("p"), _share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v")).alias("q"),
    )
    shares = written(shares, "shares")
    return _pairs(shares, sources).unionAll(_top_terms(shares, top))


def _pairs(shares: DataFrame, sources: DataFrame) -> DataFrame:
    blocks = sources.groupBy("lang").agg((F.max("source_id") + 1).alias("s")).select("lang", F.ceil(F.col("s") / BLOCK).cast("long").alias("blocks"))
    slices = shares.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("slices"))
    block = F.floor(F.col("source_id") / BLOCK).cast("long")
    rows = shares.join(blocks, "lang").join(slices, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"), block.alias("block"), "source_id", "term", "p", "p0",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    )
    cells = rows.select("lang", "slice", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "source_id", "term", "p", "p0")
    cells = cells.repartition("lang", "slice", "i", "j").sortWithinPartitions("lang", "slice", "i", "j")
    shared = cells.mapInArrow(_both, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    # how many terms of a source have each share
    alike = shares.groupBy("lang", "source_id", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    side = sources.select("lang", "source_id", "source", "p0", "v")
    pairs = side.select("lang", F.col("source_id").alias("a"), "source", F.col("p0").alias("pa"), "v").join(
        side.select("lang", F.col("source_id").alias("b"), F.col("source").alias("item"), F.col("p0").alias("pb")), "lang"
    ).where("a <> b")
    f00 = _f(F.col("p0"), F.col("pb"))
    others = side.select("lang", F.col("source_id").alias("b"), F.col("p0").alias("pb"))
    single = alike.join(others, "lang").where("source_id <> b").groupBy("lang", F.col("source_id").alias("a"), "b").agg(F.sum(F.col("m") * (_f(F.col("p"), F.col("pb")) - f00)).alias("single"))
    back = single.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("single").alias("back"))
    both = shared.unionAll(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = none("single") + none("back") + none("both") + F.when(F.col("v") > 0, F.col("v") * _f(F.col("pa"), F.col("pb"))).otherwise(0)
    found = pairs.join(single, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    found = found.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    found = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def report(docs: DataFrame) -> DataFrame:
    return audit(docs)
