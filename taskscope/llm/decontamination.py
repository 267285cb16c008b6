"""Benchmark decontamination: passages of the corpus as queries against an index of test items.

Test items are indexed by BM25: for each term the items that hold it, with the term's share of the score that the item
gets from its own text, in blocks of ``RANGE`` items with the largest share of each. Every passage of every document
(windows of words that overlap by the longest item, so that each occurrence lies whole in one) is a query, and block-max
WAND returns all items of which the passage reaches at least ``LEAST_SCORE``. The sums of block maxima, which tell the
blocks that may be skipped, are computed for all passages of a batch at once; the blocks that remain are searched by
WAND: lists in the order of their current item, a pivot where their maxima reach the threshold, lists before it skip to it.
Found items are then
verified: at least ``OVERLAP`` of the item's shingles of five words must be in the passage, and at least half of those
that lie in its question, and of those that reach into its answer. The answer is what follows the last question mark,
else the last sentence, else the last third of the words.

The index is sent to all tasks in blocks of at most ``BLOCK_BYTES`` of item text; more items mean more passes, and each
item is found by one of them.

Words are runs of letters and digits, in lower case; bytes beyond ASCII count as letters.

Defined results: null and empty texts hit nothing; an item without words is ignored, one with fewer than five words is
one shingle; repeated items are found each; a null item id is kept; rows of a document that repeat are searched alike;
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as T

LEAST_SCORE = 0.5
OVERLAP, PART_OVERLAP = 0.8, 0.5
SHINGLE = 5
BLOCK_BYTES = 16 << 20
_SLICE = 2 << 20
_K1, _B = 1.2, 0.75
RANGE = 4  # items of a block


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words, and the first word of each row. Upper case of Latin-1 letters is folded too."""
    low = T.LOWER[data]
    if len(low) > 1:
        upper = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[upper] += 32
    starts, ends, first = T.words(low, offsets, T.SEPARATOR)
    return T.hashes(low, starts, ends), first


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in their order."""
    return T.windows(words, np.array([0, len(words)]), size)[0]


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    text = text.strip()
    mark = text.rfind("?")
    if 0 <= mark < len(text) - 1 and text[mark + 1:].strip():
        return text[:mark + 1], text[mark + 1:]
    found = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text)]
    if found:
        return text[:found[-1]], text[found[-1]:]
    words = text.split()
    k = len(words) - max(1, len(words) // 3)
    return " ".join(words[:k]), " ".join(words[k:])


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray  # hashes of terms, ascending
    first: np.ndarray  # of each term's postings
    items: np.ndarray
    shares: np.ndarray
    blocks: np.ndarray  # of each term and block: the block,
    block_most: np.ndarray  # its largest share,
    block_at: np.ndarray  # its first posting (one more at the end),
    block_first: np.ndarray  # and the first block of each term (one more at the end)
    shingles: list[np.ndarray]
    sizes: list[int]  # words of a shingle: fewer than five in a shorter item
    answers: list[int]  # the first shingle that reaches into the answer
    longest: int


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return terms(data, np.array([0, len(data)]))[0]


def build_index(rows: list[tuple[object, str | None]]) -> Index | None:
    """The index of (id, text) items; none if no item has words."""
    rows = [(i, t, w) for i, t in rows if t and len(w := _hashes(t))]
    if not rows:
        return None
    counts = [np.unique(w, return_counts=True) for _, _, w in rows]
    vocabulary, df = np.unique(np.concatenate([c[0] for c in counts]), return_counts=True)
    n, mean = len(rows), sum(len(w) for _, _, w in rows) / len(rows)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    term, item, share = [], [], []
    for k, ((_, _, w), (h, tf)) in enumerate(zip(rows, counts, strict=True)):
        t = np.searchsorted(vocabulary, h)
        s = idf[t] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * len(w) / mean))
        term.append(t)
        item.append(np.full(len(t), k))
        share.append(s / s.sum())
    term, item, share = (np.concatenate(x) for x in (term, item, share))
    order = np.lexsort((item, term))
    term, item, share = term[order], item[order], share[order]
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (item[1:] // RANGE != item[:-1] // RANGE)))
    sizes = [min(SHINGLE, len(w)) for _, _, w in rows]
    asked = [len(_hashes(parts(t)[0])) for _, t, _ in rows]
    return Index(
        [i for i, _, _ in rows], vocabulary, first, item, share,
        item[head] // RANGE, np.maximum.reduceat(share, head), np.append(head, len(term)), np.searchsorted(term[head], np.arange(len(vocabulary) + 1)),
        [shingles(w, z) for (_, _, w), z in zip(rows, sizes, strict=True)], sizes,
        [min(max(0, q - z + 1), len(w) - z) for (_, _, w), z, q in zip(rows, sizes, asked, strict=True)],
        max(len(w) for _, _, w in rows),
    )


def search(index: Index, places: list[int], least: float) -> list[tuple[int, float]]:
    """WAND within a block: every item that the query's terms give at least ``least``. ``places``: the terms' entries for the block."""
    items, shares = index.items, index.shares
    # a list: current item, its posting, the end, the largest share
    lists = [[int(items[index.block_at[p]]), int(index.block_at[p]), int(index.block_at[p + 1]), float(index.block_most[p])] for p in places]
    out = []
    while True:
        lists.sort(key=lambda c: c[0])
        total, pivot = 1e-9, None
        for k, c in enumerate(lists):
            total += c[3]
            if total >= least:
                pivot = k
                break
        if pivot is None:
            return out
        item = lists[pivot][0]
        if lists[0][0] == item:
            score = sum(float(shares[c[1]]) for c in lists if c[0] == item)
            if score + 1e-9 >= least:
                out.append((item, score))
            to = item + 1
        else:
            to = item
        for c in lists:
            while c[1] < c[2] and items[c[1]] < to:
                c[1] += 1
            c[0] = int(items[c[1]]) if c[1] < c[2] else -1
        lists = [c for c in lists if c[0] >= 0]


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches from ``first`` to ``last``, and the stretch of each."""
    size = last - first
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) + np.repeat(first - (np.cumsum(size) - size), size), own


def search_batch(index: Index, data: np.ndarray, offsets: np.ndarray, least: float = LEAST_SCORE) -> list[dict[int, tuple]]:
    """For each row the verified items: number -> (score, overlap, question, answer, first word of the passage)."""
    words, first = terms(data, offsets)
    rows = len(offsets) - 1
    out: list[dict[int, tuple]] = [{} for _ in range(rows)]
    if not len(words):
        return out
    # terms of the index among the words, through a table of their high bits
    bits = max(10, len(index.vocabulary).bit_length() + 3)
    table = np.zeros((1 << bits) + 1, bool)
    table[index.vocabulary >> np.uint64(64 - bits)] = True
    at = np.flatnonzero(table[words >> np.uint64(64 - bits)])
    number = np.minimum(np.searchsorted(index.vocabulary, words[at]), len(index.vocabulary) - 1)
    real = index.vocabulary[number] == words[at]
    at, number = at[real], number[real]
    # passages: two lengths of the longest item, one length apart
    step = index.longest
    count = np.maximum(1, -(-(np.diff(first) - step) // step))
    row = np.repeat(np.arange(rows), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a = first[row] + nth * step
    b = np.minimum(a + 2 * step, first[row + 1])
    # distinct terms of each passage, and the sums of their block maxima
    at_, own_ = _runs(np.searchsorted(at, a), np.searchsorted(at, b))
    pairs = np.unique(own_ * len(index.vocabulary) + number[at_])
    passage, term = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    entry, of = _runs(index.block_first[term], index.block_first[term + 1])
    width = int(index.blocks.max()) + 1
    key = passage[of] * width + index.blocks[entry]
    bound = np.bincount(key, index.block_most[entry], len(row) * width) >= least - 1e-9
    open_ = np.flatnonzero(bound[key])
    open_ = open_[np.argsort(key[open_], kind="stable")]
    found: dict[int, list[tuple[int, float]]] = {}
    for group in np.split(open_, np.flatnonzero(np.diff(key[open_])) + 1) if len(open_) else []:
        hits = search(index, entry[group].tolist(), least)
        if hits:
            found.setdefault(int(key[group[0]] // width), []).extend(hits)
    for k, hits in found.items():
        own: dict[int, np.ndarray] = {}
        for i, score in hits:
            z = index.sizes[i]
            if z not in own:
                own[z] = shingles(words[a[k]:b[k]], z)
            same = np.isin(index.shingles[i], own[z])
            cut = index.answers[i]
            overlap, answer = float(same.mean()), float(same[cut:].mean())
            question = float(same[:cut].mean()) if cut else overlap
            if overlap >= OVERLAP and question >= PART_OVERLAP and answer >= PART_OVERLAP:
                mine = out[row[k]]
                if i not in mine or (overlap, score) > (mine[i][1], mine[i][0]):
                    mine[i] = (score, overlap, question, answer, int(a[k] - first[row[k]]))
    return out


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """Indexes over blocks of the items, each of bounded size."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        index = build_index(sorted(((r.id, r.text) for r in rows), key=lambda r: (str(r[0]), r[1])))
        if index:
            yield index


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row for each document and verified item: (id, item_id, score, overlap, question_overlap, answer_overlap, word)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, score double, overlap double, question_overlap double, answer_overlap double, word long"
    item_type = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most a block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in T.slices(whole, "text", _SLICE):
                    found = [(k, i, *v) for k, hit in enumerate(search_batch(shared.value, *T.flat(batch.column("text")), least)) for i, v in sorted(hit.items())]
                    columns = list(zip(*found, strict=True)) if found else [()] * 7
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(columns[0], pa.int64())), pa.array([shared.value.ids[i] for i in columns[1]], item_type)]
                        + [pa.array(c, pa.float64()) for c in columns[2:6]] + [pa.array(columns[6], pa.int64())],
                        ["id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "word"],
                    )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return rows.limit(0).mapInArrow(lambda batches: iter(()), schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, as they are. Each is judged where it lies; nothing is shuffled."""
    for index in _indexes(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in T.slices(whole, text_col, _SLICE):
                    yield batch.filter(pa.array([not hit for hit in search_batch(shared.value, *T.flat(batch.column(text_col)), least)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).withColumnRenamed("id", "doc_id")
