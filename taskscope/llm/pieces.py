"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is cut before each space that follows something else; no piece of the vocabulary crosses such a place, so the
parts are encoded apart, each distinct one (by its bytes) once. All parts of a batch lie in one flat array of symbols. A round looks up
the rank of every adjacent pair, takes the least rank of each part, merges that pair at every place in the part at once,
from the left, and closes the gaps; parts without a pair are done and leave the array.

Merging every place at once equals merging one by one when the new piece is in no pair of a better or equal rank. Where
it is, as with runs of spaces, only the leftmost place is merged in a round, and parts that need many such rounds are
finished by the sequential rule.

Defined results: a null or empty text gives no ids and decodes to the empty text; a character outside the vocabulary
gives its bytes; the text is never cut short; rows that repeat are encoded alike; a null id stays; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as T

_SLICE = 1 << 20  # bytes of text that are encoded at once; their flat arrays take some hundred times as much
_CACHE = 400_000  # distinct parts that a task remembers
_LONG = 1024  # bytes of a part that hardly comes again; these are forgotten once they fill a slice
_PATIENCE = 64  # rounds with single merges before the sequential rule takes over
_NEVER = np.iinfo(np.int32).max
_SPACE, _MARK = 32, 0x2581
_OUTSIDE = 1 << 20  # symbols from here on are characters outside the vocabulary


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model, as flat arrays."""

    chars: np.ndarray  # code points that are pieces, ascending
    char_ids: np.ndarray
    pairs: np.ndarray  # left * 2^21 + right, ascending
    ranks: np.ndarray  # of the pair's merge; lower is merged earlier
    merged: np.ndarray
    alone: np.ndarray  # whether a pair may be merged at one place a round only
    bytes_at: np.ndarray  # id of the piece for byte 0 to 255
    text: np.ndarray  # the bytes of all pieces
    text_at: np.ndarray
    marked: np.ndarray  # pieces that begin with the space mark


def load(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback, a dummy prefix and no other normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    ids = {p: i for i, p in enumerate(names) if not special[i]}
    if any("▁" in p.lstrip("▁") for p in ids):
        raise ValueError("a piece goes across words")
    level = {s: k for k, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
    rank = {p: level[scores[i]] for p, i in ids.items()}
    shared = np.bincount([rank[p] for p in ids], minlength=len(level)) > 1
    rows = sorted((ids[p[:k]] << 21 | ids[p[k:]], rank[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    pairs, ranks, merged = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    best = np.full(n, _NEVER, np.int64)
    np.minimum.at(best, pairs >> 21, ranks)
    np.minimum.at(best, pairs & (1 << 21) - 1, ranks)
    chars = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    text = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Vocabulary(
        np.array([c for c, _ in chars], np.int64), np.array([i for _, i in chars], np.int64),
        pairs, ranks, merged, (best[merged] <= ranks) | shared[ranks],
        np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32),
        np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]),
        np.array([p.startswith("▁") and not special[i] for i, p in enumerate(names)]),
    )


def _rank(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (or never) and its place among the pairs."""
    key = left << 21 | right
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    return np.where(v.pairs[at] == key, v.ranks[at], _NEVER), at


def _sequential(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The best pair of all, the leftmost of equals, until none is left."""
    follow, before, heap = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)], []

    def offer(i: int) -> None:
        if i >= 0 and follow[i] >= 0:
            a, b = symbols[i], symbols[follow[i]]
            r, at = _rank(v, np.array([a]), np.array([b]))
            if r[0] != _NEVER:
                heapq.heappush(heap, (int(r[0]), i, a, b, int(v.merged[at[0]])))

    for i in range(len(symbols)):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = follow[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j] = new, -1
        follow[i] = follow[j]
        if follow[j] >= 0:
            before[follow[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


def encode_parts(v: Vocabulary, chars: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``n`` parts, given as code points with the part of each: flat ids and their count in each part."""
    at = np.minimum(np.searchsorted(v.chars, chars), len(v.chars) - 1)
    sym = np.where(v.chars[at] == chars, v.char_ids[at], _OUTSIDE + chars)
    done_sym, done_part, rounds = [], [], 0
    while len(sym):
        rank, where = np.full(len(sym), _NEVER, np.int64), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(part[1:] == part[:-1])
        rank[inner], where[inner] = _rank(v, sym[inner], sym[inner + 1])
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        least = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(sym)))
        live = np.repeat(least != _NEVER, sizes)
        if not live.all():
            done_sym.append(sym[~live])
            done_part.append(part[~live])
            sym, part, rank, where = sym[live], part[live], rank[live], where[live]
            sizes, least = sizes[least != _NEVER], least[least != _NEVER]
            if not len(sym):
                break
        own = np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(rank == least[own])
        of = own[hit]
        lead = np.append(True, of[1:] != of[:-1])
        alone = v.alone[where[hit]]
        if alone.any():
            rounds += 1
            if rounds > _PATIENCE:
                slow = np.unique(of[alone])
                for k in slow:
                    mine = own == k
                    out = _sequential(v, sym[mine].tolist())
                    done_sym.append(np.array(out))
                    done_part.append(np.full(len(out), part[mine][0]))
                keep = ~np.isin(own, slow)
                sym, part = sym[keep], part[keep]
                continue
        hit, where_hit = hit[~alone | lead], where[hit][~alone | lead]
        # of places that overlap (a run of one symbol), every other one from the left
        run = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
        nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit, where_hit = hit[nth % 2 == 0], where_hit[nth % 2 == 0]
        sym[hit] = v.merged[where_hit]
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        sym, part = sym[stay], part[stay]
    sym, part = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_part))
    order = np.argsort(part, kind="stable")
    sym, part = sym[order], part[order]
    out = np.flatnonzero(sym >= _OUTSIDE)
    if len(out):  # characters outside the vocabulary become bytes
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[out] - _OUTSIDE).tolist()]
        size = np.ones(len(sym), np.int64)
        size[out] = [len(r) for r in raw]
        first = (np.cumsum(size) - size)[out]
        sym, part = np.repeat(sym, size), np.repeat(part, size)
        fill = np.repeat(first, size[out]) + np.concatenate([np.arange(len(r)) for r in raw])
        sym[fill] = v.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
    return sym.astype(np.int32), np.bincount(part, minlength=n)


def decode(v: Vocabulary, ids: np.ndarray, rows: np.ndarray) -> list[str]:
    """The texts of rows of flat ids: their pieces' bytes, without the mark that encoding puts in front."""
    size = np.diff(v.text_at)[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ids) else 0
    at = np.arange(total) + np.repeat(v.text_at[:-1][ids] - (ends - size), size)
    raw = v.text[at].tobytes()
    cuts = np.append(0, ends)[rows].tolist()
    out = []
    for a, b, first, last in zip(cuts[:-1], cuts[1:], rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        skip = 1 if last > first and v.marked[ids[first]] else 0
        out.append(raw[a + skip:b].decode("utf-8", "replace"))
    return out


class Encoder:
    """Encodes batches of texts and remembers distinct parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.long = 0  # bytes of long parts that are remembered
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offset of each text among them."""
        raw = [b" " + t.replace("▁", " ").encode() if t else b"" for t in texts]
        rows = np.cumsum([0, *map(len, raw)])
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space = data == _SPACE
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[rows[:-1][np.diff(rows) > 0]] = True
        starts = np.flatnonzero(head)
        if len(self.known) > _CACHE or self.long > _SLICE:
            self.forget()
        # the parts tile the texts, so their starts are the offsets of an array; they are told apart by their bytes
        tiles = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(joined)]
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), tiles).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        place = np.empty(len(distinct), np.int64)
        new = []
        for k, p in enumerate(distinct):
            slot = self.known.get(p)
            if slot is None:
                slot = self.known[p] = len(self.known)
                new.append(p)
            place[k] = slot
        if new:
            self._learn(new)
        slot = place[parts.indices.to_numpy()]
        size = self.size[slot]
        ends_ = np.cumsum(size)
        where = np.arange(int(ends_[-1])) + np.repeat(self.start[slot] - (ends_ - size), size)
        per_row = np.searchsorted(starts, rows)
        return self.ids[where], np.append(0, ends_)[per_row]

    def _learn(self, parts: list[bytes]) -> None:
        size = np.array([len(p) for p in parts])
        self.long += int(size[size > _LONG].sum())
        joined = b"".join(parts)
        lead = (np.frombuffer(joined, np.uint8) & 0xC0) != 0x80
        part = np.repeat(np.arange(len(size)), size)[lead]
        chars = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        chars[chars == _SPACE] = _MARK
        ids, count = encode_parts(self.v, chars, part, len(size))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
        self.size = np.append(self.size, count)
        self.ids = np.append(self.ids, ids)


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text, and the text that the ids decode to: (id, ids, decoded)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model_path))  # as large as the vocabulary file, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary.value)
        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                ids, rows = coder.encode(batch.column("text").to_pylist())
                lists = pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(decode(coder.v, ids, rows), pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: how many ids, and the hashes of the ids and of the decoded text."""
    return tokenize(docs, model_path).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
