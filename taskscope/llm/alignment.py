"""Alignment of two tokenizers over every document, and how usual each alignment is in the whole corpus.

1. A map task encodes its documents with both tokenizers. There are places that no token of either crosses, such as one
   before a space that follows a letter, so each distinct stretch between them is encoded once and remembered by its bytes.
2. In each batch, ``pandas.merge_asof`` keyed by document finds for every token start the other side's token that covers
   it; the union of both directions is all overlapping pairs. Overlapping tokens with equal ends close a group, and all
   pairs of a group are links. A group's distinct pairs go on with their multiplicity, not each occurrence.
3. A batch of about ``_BATCH`` bytes sends each distinct pair once, with the number of its documents that hold it. These
   are summed by pair, joined with the best count of the pair's first id, and go back to the batch, which looks them up
   for each of its documents.

A batch is named by its task and number, so the documents must come from a table, or another source whose tasks give the
same rows in the same order when they run again.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens:
zeros and an empty digest. Texts are read whole (a very long one is a batch of its own); rows that repeat are documents
of their own, each counted; a null id stays; strings of special tokens are plain text; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import tokens as T
from .store import written

_SLICE = 2 << 20
_BATCH = 16 << 20  # bytes of text whose distinct pairs are sent together
_CACHE = 300_000  # distinct stretches that a task remembers
_LONG = 256  # bytes from which a stretch is encoded but not remembered

_SPACE, _BREAK = 32, 10
_DOCUMENT, _PAIR = 0, 1


#: Fixed: the pattern that splits a text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of stretches, and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            self._load_pieces(path)
        else:
            self._load_bytes(path)
        self.size = np.array([len(r) for r in self.bytes], np.int64)

    def _load_pieces(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names) or len(cuts(np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum([0, *map(len, self.bytes)]))) > sum(map(bool, self.bytes)):
            raise ValueError("a piece goes across stretches")
        mark = sp.encode("\n")  # what encoding puts in front, and a line break that joins nothing

        def many(texts: list[str]) -> list[list[int]]:
            # the model itself puts the first space in front; what has none, or nothing else, goes behind a line break
            spaced = [t.startswith(" ") and len(t) > 1 for t in texts]
            found = sp.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
            return [x if s else x[len(mark):] for x, s in zip(found, spaced, strict=True)]

        self._many = many

    def _load_bytes(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet = _byte_alphabet()
        special = {t["id"] for t in model.get("added_tokens", []) if t["special"]}
        vocabulary = model["model"]["vocab"]
        raw = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for name, i in vocabulary.items():
            raw[i] = name.encode() if i in special else bytes(alphabet[c] for c in name)
        self.bytes = raw
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merges == sorted(set(merges)):  # ids rank the merges, as rank files have it
            import tiktoken

            ranks = {r: i for i, r in enumerate(raw) if i not in special}
            coder = tiktoken.Encoding("stretches", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._many = lambda texts: [coder.encode_ordinary(t) for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._many = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._many(texts)

    def gives_back(self, ids: list[int], raw: bytes) -> bool:
        return b"".join([self.bytes[i] for i in ids]) == raw


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: What may begin a stretch behind a letter.
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "\n.,;:!?)|"]] = True


def cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First byte of each stretch: a text's first; each space that follows what is surely not white space; each
    punctuation mark behind a letter, or a letter behind a single line break. No pattern match and no merge crosses these.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # letters of ASCII and of Latin-1, whose two bytes are C3 and 80 to BF
    second = np.append(False, data[:-1] == 0xC3)
    letter = _LETTER[data] | second & (data != 0x97) & (data != 0xB7)
    # characters of these beginnings may be white space beyond ASCII
    solid = (data > _SPACE) & (data != 0x7F) & ~np.append(False, data[:-1] == 0xC2)
    if n > 2:
        a, b = data[:-2], data[1:-1]
        solid[2:] &= ~(((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
    head = np.zeros(n, bool)
    head[1:] = (data[1:] == _SPACE) & solid[:-1] | _MARKS[data[1:]] & letter[:-1]
    head[2:] |= _LETTER[data[2:]] & (data[1:-1] == _BREAK) & solid[:-2]
    head[rows[:-1][np.diff(rows) > 0]] = True
    return np.flatnonzero(head)


_side = lru_cache(maxsize=4)(Side)  # a worker loads a vocabulary once


class Aligner:
    """Encodes batches of texts with both tokenizers; remembers distinct stretches by their bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = _side(path_a), _side(path_b)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ok = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _learn(self, new: list[bytes]) -> None:
        texts = [p.decode() for p in new]
        ok = np.ones(len(new), bool)
        for k, side in enumerate(self.sides):
            found = side.encode(texts)
            ok &= [side.gives_back(i, p) for i, p in zip(found, new, strict=True)]
            self.ids[k] = np.append(self.ids[k], np.fromiter(chain.from_iterable(found), np.int64))
            self.first[k] = np.append(self.first[k], self.first[k][-1] + np.cumsum([len(x) for x in found]))
        self.ok = np.append(self.ok, ok)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For both sides the flat ids and the document of each token; and which documents come back byte by byte."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        rows = np.cumsum([0, *map(len, raw)])
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        starts = cuts(data, rows)
        if len(self.known) > _CACHE:
            self.forget()
        # the stretches tile the texts, so their starts are the offsets of an array
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        known, new = self.known, []
        base = len(known)
        distinct = stretches.dictionary.to_pylist()
        place = np.empty(len(distinct), np.int64)
        for k, p in enumerate(distinct):
            s = known.get(p)
            if s is None:
                s = known[p] = base + len(new)
                new.append(p)
            place[k] = s
        slots = place[stretches.indices.to_numpy()]
        if new:
            self._learn(new)
        doc = np.searchsorted(rows, starts, "right") - 1
        good = np.array([bool(t) for t in texts], bool)
        good[doc[~self.ok[slots]]] = False
        use = good[doc]
        slots, doc = slots[use], doc[use]
        ids, owner = [], []
        for k in (0, 1):
            size = (self.first[k][1:] - self.first[k][:-1])[slots]
            ends_ = np.cumsum(size)
            at = np.arange(int(size.sum())) + np.repeat(self.first[k][slots] - (ends_ - size), size)
            ids.append(self.ids[k][at])
            owner.append(np.repeat(doc, size))
        if any(len(p) > _LONG for p in new):
            self._shed(new, base)
        return good, ids, owner

    def _shed(self, new: list[bytes], base: int) -> None:
        """Don't keep very long stretches, which hardly come again: their bytes would fill the memory."""
        keep = [p for p in new if len(p) <= _LONG]
        for p in new:
            del self.known[p]
        for k in (0, 1):
            self.ids[k] = self.ids[k][:self.first[k][base]]
            self.first[k] = self.first[k][:base + 1]
        self.ok = self.ok[:base]
        for s, p in enumerate(keep):
            self.known[p] = base + s
        if keep:
            self._learn(keep)

    def groups(self, ids: list[np.ndarray], owner: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of both sides, numbered over the batch."""
        end = [np.cumsum(side.size[i]) for side, i in zip(self.sides, ids, strict=True)]  # both sides have the same bytes
        frame = [
            pd.DataFrame({"doc": d, "start": e - side.size[i], "token": np.arange(len(i))})
            for side, i, d, e in zip(self.sides, ids, owner, end, strict=True)
        ]
        # the token of the other side that covers each token's start
        b = pd.merge_asof(frame[0], frame[1], on="start", by="doc", suffixes=("_a", "_b"))
        a = pd.merge_asof(frame[1], frame[0], on="start", by="doc", suffixes=("_b", "_a"))
        token_a = np.concatenate([b["token_a"].to_numpy(), a["token_a"].to_numpy(np.int64)])
        token_b = np.concatenate([b["token_b"].to_numpy(np.int64), a["token_b"].to_numpy()])
        closed = end[0][token_a] == end[1][token_b]
        close = np.zeros(len(ids[0]), bool)
        close[token_a[closed]] = True
        closes = end[0][close]
        return np.searchsorted(closes, end[0]), np.searchsorted(closes, end[1])


def pairs_of(ids: list[np.ndarray], group: tuple[np.ndarray, np.ndarray], group_doc: np.ndarray, limit: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) with the number of links; a pair is a << 16 | b. Distinct ids of a group meet, with their multiplicities."""
    sides = []
    for i, g in zip(ids, group, strict=True):
        key, n = np.unique(g << 16 | i, return_counts=True)
        sides.append((key >> 16, key & 0xFFFF, n))
    (ga, a, na), (gb, b, nb) = sides
    n_groups = len(group_doc)
    first_b = np.searchsorted(gb, np.arange(n_groups + 1))
    width = (first_b[1:] - first_b[:-1])[ga]  # partners of each distinct first id
    found = []
    total = np.cumsum(width)
    at = 0
    while at < len(ga):
        # at most ``limit`` pairs at once; one id's partners are bounded by the vocabulary
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        w = width[at:to]
        left = np.repeat(np.arange(at, to), w)
        right = np.arange(int(w.sum())) + np.repeat(first_b[ga[at:to]] - (np.cumsum(w) - w), w)
        key = group_doc[ga[left]] << 32 | a[left] << 16 | b[right]
        found.append(_summed(key, na[left] * nb[right]))
        at = to
    key, n = found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key >> 32, key & 0xFFFFFFFF, n


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(n[order], head) if len(key) else n


class Digits:
    """Writes ids in decimal with a separator behind each, as one array of bytes."""

    def __init__(self, n: int):
        text = [str(k).encode() for k in range(n)]
        self.size = np.array([len(t) for t in text], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(text), np.uint8)

    def write(self, ids: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and the end of each id with its separator."""
        size = self.size[ids] + 1
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[ids] - (ends - size), size)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[ends - 1] = behind
        return out, ends


def _written_groups(digits: Digits, ids, group, group_doc: np.ndarray, n: int) -> list[str]:
    """Digest of each document's groups, as decimal ids in order."""
    side = np.concatenate([np.zeros(len(ids[0]), np.int8), np.ones(len(ids[1]), np.int8)])
    every, of = np.concatenate(ids), np.concatenate(group)
    order = np.argsort(of << 1 | side, kind="stable")
    every, of, side = every[order], of[order], side[order]
    last = np.ones(len(of), bool)
    last[:-1] = (of[1:] != of[:-1]) | (side[1:] != side[:-1])
    behind = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    data, ends = digits.write(every, behind)
    cut = np.append(0, ends)[np.searchsorted(group_doc[of], np.arange(n + 1))].tolist()
    raw = data.tobytes()
    return [hashlib.sha256(raw[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, lowest bytes first, so that the zeros of the higher bytes lie together."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _aligned_schema(kind: str) -> str:
    return (
        f"batch string, kind int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, "
        "place int, a int, b int, n long"
    )


def _fit(id_type: pa.DataType, **columns) -> pa.RecordBatch:
    names = ["batch", "kind", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "place", "a", "b", "n"]
    types = [pa.string(), pa.int32(), id_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), *[pa.int32()] * 3, pa.int64()]
    size = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([columns[n].cast(t) if n in columns else pa.nulls(size, t) for n, t in zip(names, types, strict=True)], names)


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        digits = Digits(max(len(s.bytes) for s in aligner.sides))
        task, held, size, count = TaskContext.get().partitionId(), [], 0, 0

        def out(held, count):
            """The held documents, whose pairs are numbered in the batch, and the batch's distinct pairs."""
            name = f"{task}-{count}"
            pairs, docs_with = np.unique(np.concatenate([h[2] for h in held]), return_counts=True)
            for table, doc, pair, times in held:
                place = np.searchsorted(pairs, pair)
                first = np.searchsorted(doc, np.arange(len(table["id"]) + 1)).tolist()
                spans = list(zip(first[:-1], first[1:], strict=True))
                yield _fit(
                    table["id"].type, **table, batch=pa.array([name] * len(spans)), kind=pa.array([_DOCUMENT] * len(spans)),
                    places=pa.array([_planes(np.diff(place[x:y], prepend=0)) for x, y in spans], pa.binary()), times=pa.array([_planes(times[x:y]) for x, y in spans], pa.binary()),
                )
            step = 1 << 16
            for k in range(0, len(pairs), step):
                p = pairs[k:k + step]
                yield _fit(
                    held[0][0]["id"].type, batch=pa.array([name] * len(p)), kind=pa.array(np.full(len(p), _PAIR)), place=pa.array(np.arange(k, k + len(p))),
                    a=pa.array(p >> 16), b=pa.array(p & 0xFFFF), n=pa.array(docs_with[k:k + step]),
                )

        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                texts = batch.column("text").to_pylist()
                _, ids, owner = aligner.encode(texts)
                group = aligner.groups(ids, owner)
                n = len(texts)
                group_doc = np.zeros(int(group[0][-1]) + 1 if len(group[0]) else 0, np.int64)
                group_doc[group[0]] = owner[0]
                doc, pair, times = pairs_of(ids, group, group_doc)
                links = np.zeros(n, np.int64)
                np.add.at(links, doc, times)
                table = {
                    "id": batch.column("id"), "n_a": pa.array(np.bincount(owner[0], minlength=n)), "n_b": pa.array(np.bincount(owner[1], minlength=n)),
                    "n_groups": pa.array(np.bincount(group_doc, minlength=n)), "n_links": pa.array(links), "groups_sha256": pa.array(_written_groups(digits, ids, group, group_doc, n)),
                }
                held.append((table, doc, pair, times))
                size += sum(len(t) for t in texts if t)
                if size >= _BATCH:
                    yield from out(held, count)
                    held, size, count = [], 0, count + 1
        if held:
            yield from out(held, count)

    return run


def _looked_up():
    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs["place"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
        n_best, count_sum = [], []
        for p, t in zip(docs["places"], docs["times"], strict=True):
            at, times = np.cumsum(_numbers(p.as_buffer())), _numbers(t.as_buffer())
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per document (id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), and one per linked pair of ids (a, b, count, best).

    ``path_a`` is a byte-level vocabulary in JSON that gets the text behind a space; ``path_b`` a model that adds the space itself.
    ``count`` is the number of documents that hold the pair linked; ``best`` marks the highest of its first id, ties included.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = written(rows.mapInArrow(_align(path_a, path_b), _aligned_schema(kind)), "aligned")
    pairs = found.where(F.col("kind") == _PAIR).select("batch", "place", "a", "b", "n")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = pairs.select("batch", "place", "a", "b").join(counts, ["a", "b"]).select(F.col("batch").alias("of"), "place", "count", "best")
    documents = found.where(F.col("kind") == _DOCUMENT).select("batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(_looked_up(), schema), counts


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, and how usual the links are."""
    return align(docs, path_a, path_b)[0].withColumnRenamed("id", "doc_id")
