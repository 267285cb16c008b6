"""Substring dedup: windows of a fixed number of words that repeat anywhere are removed.

1. Every window of every text gets a rolling (Rabin-Karp) hash of 62 bits. A map task packs the hashes of about two
   million windows into blobs, one for each range of hashes, with the place of each window in its batch. A hash that a
   batch holds several times goes out once, marked as repeated, and its places go along apart: a passage that a third
   of all rows share costs one entry for each batch.
2. Each hash range meets in one partition of bounded size (the number of ranges follows the bytes of the corpus), where
   equal hashes are counted. The places of windows that are not alone go back to their batch.
3. Rows with such windows are read once more, and these windows alone are counted again by a second hash, modulo other
   primes, in the same way. What is not alone by both hashes is removed: a batch turns the places into maximal intervals
   of words for each row.

A batch is named by its task and number, so the documents must come from a table, or another source whose tasks give the
same rows in the same order when they run again.

A window is wrongly removed only if both hashes meet by chance: for N windows, F of which repeat, N * N / 2^62 * F / 2^62
are expected (5e-12 for a hundred million windows that all repeat).

Defined results: a null or empty text has no words (0, 0, hash of the empty text); fewer words than a window: nothing is
removed; texts are read whole, a very long one as a batch of its own; rows that repeat are judged like any others, so both
copies of a long enough text go; ids are of any type, null too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import tokens as T
from .store import written

_SLICE = 2 << 20
_BATCH = 2_000_000  # windows that a map task holds before it sends them
_RANGE = 4 << 20  # bytes of text for each hash range

_SEEN, _PLACES, _ROWS, _STARTS = 0, 1, 2, 3
_PACKED = "part int, batch string, kind int, blob binary"


def _pack(batch: str, hashes: list, rows: list, starts: list, ranges: int) -> Iterator[tuple]:
    """Blobs of one batch: unique hashes by range, places of those repeated here, and the rows themselves."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    shift = np.uint64(64 - ranges.bit_length() + 1)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(s)))
    many = count > 1
    first = order[at]
    repeated = order[np.repeat(many, count)]
    # hashes are sorted, so ranges are stretches
    keys = s[at]
    cuts = np.searchsorted(keys >> shift, np.arange(ranges + 1))
    for part in range(ranges):
        a, b = cuts[part], cuts[part + 1]
        if a == b:
            continue
        place = np.argsort(first[a:b])
        k, f, m = keys[a:b][place], first[a:b][place], many[a:b][place]
        low = k.view(np.uint8).reshape(-1, 8)[:, :7]  # the range tells the highest byte
        gaps = np.diff(f, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        yield part, batch, _SEEN, len(k).to_bytes(4, "little") + gaps.tobytes() + np.packbits(m).tobytes() + low.tobytes()
    spread = zlib.crc32(batch.encode()) % ranges
    if len(repeated):
        yield spread, batch, _PLACES, np.sort(repeated).astype(np.uint32).tobytes()
    if starts:
        yield spread, batch, _STARTS, b"".join(starts)
    yield spread, batch, _ROWS, b"".join(rows)


# a row is named by 128 bits of its id and text
_ROW = np.dtype([("key", "<i8"), ("key2", "<i8"), ("words", "<i8"), ("windows", "<i8"), ("sha", "S32")])


def _expanded(runs: np.ndarray) -> np.ndarray:
    """The numbers of runs [a, b)."""
    runs = runs.reshape(-1, 2).astype(np.int64)
    size = runs[:, 1] - runs[:, 0]
    return np.arange(int(size.sum())) + np.repeat(runs[:, 0] - (np.cumsum(size) - size), size)


def _hashed(size: int, ranges: int, fields: tuple, again: bool):
    """The hashes of all windows, or ``again`` of those that the column ``cut`` names as runs of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, starts_of, n, count = [], [], [], 0, 0
        task = TaskContext.get().partitionId()

        def out():
            # a task that runs again, because its output was lost, names its batches as before
            packed = list(zip(*_pack(f"{task}-{count}", held, rows, starts_of, ranges), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(packed[0], pa.int32()), pa.array(packed[1]), pa.array(packed[2], pa.int32()), pa.array(packed[3], pa.binary())],
                ["part", "batch", "kind", "blob"],
            )

        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                data, offsets = T.flat(batch.column("text"))
                starts, ends, first = T.words(data, offsets)
                found, at = T.windows(T.hashes(data, starts, ends, fields), first, size, fields)
                windows = np.maximum(0, np.diff(first) - size + 1)
                if again:
                    first_window = np.cumsum(windows) - windows
                    named = [_expanded(np.frombuffer(c.as_buffer(), np.uint32)) for c in batch.column("cut")]
                    found = found[np.concatenate([f + k for f, k in zip(first_window, named, strict=True)])]
                    windows = np.array([len(k) for k in named])
                    starts_of.append(np.concatenate(named).astype(np.uint32).tobytes())
                held.append(found)
                raw, own = data.tobytes(), np.zeros(batch.num_rows, _ROW)
                own["key"], own["key2"] = batch.column("key").to_numpy(), batch.column("key2").to_numpy()
                own["words"], own["windows"] = np.diff(first), windows
                # bytes may end in zeros, which "S32" drops on reading; tobytes() keeps them
                own["sha"] = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                rows.append(own.tobytes())
                n += len(found)
                if n >= _BATCH or len(rows) >= 256:
                    yield out()
                    held, rows, starts_of, n, count = [], [], [], 0, count + 1
        if rows:
            yield out()

    return run


def _unpack(blob: bytes, part: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    gaps = np.frombuffer(blob, np.uint8, 4 * n, 4).reshape(4, n).T
    place = np.cumsum(np.ascontiguousarray(gaps).view(np.uint32).ravel().astype(np.int64))
    bits = (n + 7) // 8
    many = np.unpackbits(np.frombuffer(blob, np.uint8, bits, 4 + 4 * n), count=n).astype(bool)
    h = np.zeros((n, 8), np.uint8)
    h[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 4 + 4 * n + bits).reshape(n, 7)
    h[:, 7] = part >> (ranges.bit_length() - 1 - 8)
    return h.view(np.uint64).ravel(), place, many


def _counted(ranges: int):
    """Count the hashes of a partition and send the places of repeated ones back to their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        names: list[str] = []

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                ["batch", "kind", "blob"],
            )

        for b in batches:
            on = []
            for part, batch, kind, blob in zip(b["part"].to_pylist(), b["batch"].to_pylist(), b["kind"].to_pylist(), b["blob"].to_pylist(), strict=True):
                if kind == _SEEN:
                    h, place, many = _unpack(blob, part, ranges)
                    held.setdefault(part, []).append((h, place.astype(np.uint32), many, len(names)))
                    names.append(batch)
                else:
                    on.append((batch, kind, blob))
            if on:
                yield out(on)
        for part in list(held):
            got = held.pop(part)
            h = np.concatenate([g[0] for g in got])
            place = np.concatenate([g[1] for g in got])
            many = np.concatenate([g[2] for g in got])
            batch = np.repeat(np.array([g[3] for g in got], np.int32), [len(g[0]) for g in got])
            del got
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            back = order[twice]
            # places that their own batch has seen twice are known there already
            back = back[~many[back]]
            if not len(back):
                continue
            back = back[np.argsort(batch[back], kind="stable")]
            own, at = np.unique(batch[back], return_index=True)
            rows = [(names[k], _PLACES, np.sort(p).tobytes()) for k, p in zip(own, np.split(place[back], at[1:]), strict=True)]
            yield out(rows)

    return run


_JUDGED = "key long, key2 long, n_words long, sha binary, cut binary"


def _runs(table: pa.Table) -> pa.Table:
    """The windows of each row of a batch that aren't alone, as runs [a, b) of their first words."""
    kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    rows = np.frombuffer(next(b for k, b in zip(kinds, blobs, strict=True) if k == _ROWS), _ROW)
    sha = np.frombuffer(rows.tobytes(), np.uint8).reshape(-1, _ROW.itemsize)[:, -32:]
    places = [np.frombuffer(b, np.uint32) for k, b in zip(kinds, blobs, strict=True) if k == _PLACES]
    at = np.unique(np.concatenate(places)).astype(np.int64) if places else np.zeros(0, np.int64)
    first = np.append(0, np.cumsum(rows["windows"]))
    row = np.searchsorted(first, at, "right") - 1
    starts = [np.frombuffer(b, np.uint32) for k, b in zip(kinds, blobs, strict=True) if k == _STARTS]
    start = starts[0].astype(np.int64)[at] if starts else at - first[row]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    a = np.flatnonzero(new)
    last = np.append(a[1:], len(at))[: len(a)] - 1
    runs = np.stack([start[a], start[last] + 1], 1).astype(np.uint32) if len(a) else np.zeros((0, 2), np.uint32)
    of = row[a]
    lo, hi = np.searchsorted(of, np.arange(len(rows))), np.searchsorted(of, np.arange(len(rows)), "right")
    cuts = [runs[i:j].tobytes() if i < j else None for i, j in zip(lo, hi, strict=True)]
    return pa.table({
        "key": pa.array(rows["key"].copy()), "key2": pa.array(rows["key2"].copy()), "n_words": pa.array(rows["words"].copy()), "sha": pa.array([s.tobytes() for s in sha], pa.binary()), "cut": pa.array(cuts, pa.binary()),
    })


def _kept(size: int):
    """What is left of the texts that lose words: the windows of a run, and of runs that touch or overlap, are one interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, removed, kept = [], [], []
            for text, cut in zip(b["text"].to_pylist(), b["cut"].to_pylist(), strict=True):
                parts, at, left = text.encode().split(), 0, []
                for x, y in np.frombuffer(cut, np.uint32).reshape(-1, 2).tolist():
                    left += parts[at:x]  # none where intervals overlap
                    at = y - 1 + size
                left += parts[at:]
                words.append(len(parts))
                removed.append(len(parts) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def _not_alone(rows: DataFrame, size: int, fields: tuple, again: bool) -> DataFrame:
    """(key, key2, n_words, sha, cut) of each row: the windows that some other window equals by its hash, null where there are none."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-total // _RANGE))
    ranges = max(256, 1 << (parts - 1).bit_length())
    packed = rows.mapInArrow(_hashed(size, ranges, fields, again), _PACKED)
    places = written(packed.repartition(parts, "part").mapInArrow(_counted(ranges), "batch string, kind int, blob binary"), "windows")
    return written(places.groupBy("batch").applyInArrow(_runs, _JUDGED), "window-runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35) -> tuple[DataFrame, DataFrame]:
    """Rows that lose words (id, n_words, n_removed, kept text), and the others (id, n_words, hash of their words)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("id", "text"), "key2": F.xxhash64(F.lit(1), "text", "id")})
    kind = dict(rows.dtypes)["id"]
    likely = _not_alone(rows.select("key", "key2", "text"), size, T.FIELDS, False)
    # equal rows have equal runs, so one of each tells them all
    one = lambda judged, *columns: judged.dropDuplicates(["key", "key2"]).select(F.col("key").alias("_key"), F.col("key2").alias("_key2"), *columns)
    same = F.expr("key = _key and key2 = _key2")
    again = rows.join(one(likely.where("cut is not null"), "cut"), same).select("id", "key", "key2", "text", "cut")
    again = written(again, "windows-again")
    sure = _not_alone(again.select("key", "key2", "text", "cut"), size, T.OTHERS, True)
    lose = again.select("id", "key", "key2", "text").join(one(sure.where("cut is not null"), "cut"), same).select("id", "text", "cut")
    whole = one(likely.where("cut is null").unionAll(sure.where("cut is null")), "n_words", "sha")
    ids = rows.select("id", "key", "key2").join(whole, same).select("id", "n_words", "sha")
    return lose.mapInArrow(_kept(size), f"id {kind}, n_words long, n_removed long, kept string"), ids


def removal_report(docs: DataFrame, size: int = 35) -> DataFrame:
    """One row per document: words, removed words and the hash of the words that stay."""
    cut, whole = remove_repeats(docs, size=size)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).unionAll(
        whole.select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"))
    )
