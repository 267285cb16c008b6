"""Changed lines from unified diffs or, without one, from file contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import constants as C
from ..functions import paths
from ..functions.text import clean, strip

_FILE = r"^\+\+\+ b/(?P<x>[^\r\x{85}\x{2028}\x{2029}]+)[\r\x{85}\x{2028}\x{2029}]?$"
_HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+(?P<x>[0-9]+)(?:,[0-9]+)? @@"


_ROWS = 256  # diffs whose lines are held at once


def _group(lines: pa.Array, pattern: str) -> pa.Array:
    return pc.struct_field(pc.extract_regex(lines, pattern), "x")


def _latest(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The last place at or before each one that is marked, -1 where its diff has none yet."""
    place = np.maximum.accumulate(np.where(at, np.arange(len(at)), -1)) if len(at) else np.zeros(0, np.int64)
    return np.where(place >= first, place, -1)


def _added(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            lists = pc.split_pattern_regex(batch.column("_diff"), "\r?\n")
            first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            lines, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(first))
            # removed lines don't count
            stays = np.flatnonzero(~pc.starts_with(lines, "-").to_numpy(zero_copy_only=False))
            lines, row, order = lines.take(pa.array(stays)), row[stays], (stays - first[row[stays]])
            start = np.searchsorted(row, np.arange(batch.num_rows))[row]  # the first line of each line's diff
            files, hunks = _group(lines, _FILE), _group(lines, _HUNK)
            number = pc.if_else(pc.less_equal(pc.utf8_length(hunks), 10), hunks, None).cast(pa.int64())
            number = pc.if_else(pc.less_equal(number, 2147483647), number, None)
            heads = [x.is_valid().to_numpy(zero_copy_only=False) for x in (files, number)]
            file_at, hunk_at = (_latest(h, start) for h in heads)
            # lines count on from the latest hunk; headers don't count
            counted = np.append(0, np.cumsum(~(heads[0] | heads[1])))
            line = number.fill_null(0).to_numpy()[hunk_at] + counted[:-1] - counted[hunk_at]
            is_new = np.flatnonzero(pc.and_not(pc.starts_with(lines, "+"), pc.starts_with(lines, "+++")).to_numpy(zero_copy_only=False))
            found = {
                "ord": pa.array(order[is_new], pa.int32()), "file": files.take(pa.array(file_at[is_new], mask=file_at[is_new] < 0)),
                "line": pa.array(line[is_new], mask=hunk_at[is_new] < 0).cast(pa.int32(), safe=False), "content": pc.utf8_slice_codeunits(lines.take(pa.array(is_new)), 1),
            }
            whole = batch.select(keep).take(pa.array(row[is_new]))
            yield pa.RecordBatch.from_arrays([*whole.columns, *found.values()], [*keep, *found])

    return run


def parse_diff(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """Added lines of ``diffs(change_id, diff)``: ``ord``, ``file``, ``line``, ``content``.

    One pass over the lines of a batch of diffs: the latest file and hunk header are carried forward, and lines behind
    them count on from the hunk's start; removed lines and headers don't count. Linear in lines and headers.
    """
    keep = [c for c in diffs.columns if c != text]
    rows = diffs.select(*keep, clean(F.col(text)).alias("_diff"))
    schema = StructType([f for f in rows.schema.fields if f.name != "_diff"]).add("ord", "integer").add("file", "string").add("line", "integer").add("content", "string")
    return rows.mapInArrow(_added(keep), schema)


def changed_files(diffs: DataFrame, text: str = "diff") -> DataFrame:
    keep = [c for c in diffs.columns if c != text]
    files = F.array_distinct(F.regexp_extract_all(clean(F.col(text)), F.lit(r"(?m)^\+\+\+ b/([^\r\n]+)\r?$"), F.lit(1)))
    return diffs.select(*keep, F.explode(files).alias("file"))


def status_lines(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Non-blank lines of changed text files when there is no diff, in the order of ``ord``.

    ``files(change_id, pos, path, size, text)``; files above ``max_bytes`` are skipped where a caller sets it.
    """
    named = paths.basename(F.col("path")).isin(C.STATUS_TEXT_NAMES) | paths.extension(F.col("path")).isin(C.TEXT_EXTENSIONS)
    readable = files.where(named)
    if max_bytes is not None:
        readable = readable.where(F.col("size") <= max_bytes)
    rows = readable.select("change_id", "pos", F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("_i", "content"))
    kept = rows.withColumn("line", F.col("_i") + 1).where(strip(F.col("content")) != "")
    return kept.select("change_id", F.struct("pos", "line").alias("ord"), "file", "line", "content")
