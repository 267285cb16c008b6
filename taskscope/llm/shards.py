"""Contiguous shards of least largest size (minimax partition), in DataFrame operations only.

Rows of equal text are one atomic group. Groups are ordered by the digest of their text, which spreads them evenly, and
prefix sums over that order are computed in Spark: a running sum in each of 4,096 digest ranges, plus the sums of the
ranges before. Rows of a group are counted in salted units first, so that no task holds a hot group.

The driver finds the smallest feasible capacity by binary search; each check walks greedily over the ordered ends of
groups, as far as the capacity goes, for each shard. It knows the ends of digest ranges only. Where a range leaves the
check undecided, one job brings the ends of its 256 parts, and so on down to single groups; so what the driver holds
follows the shards and the depth, not the rows. The cuts keep to that capacity and lie as near as possible to equal
shares of what is left, where groups above such a share count apart,
so that one huge group doesn't leave other shards empty.

Defined results: a null text has 0 bytes; a null id is put last in its unit; rows that repeat are counted each; with
fewer groups than shards, some shards are empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from .store import written

SHARDS = 24
SALTS = 1024
_TOP, _STEP = 3, 2  # hex digits of the first ranges, and of each refinement


class _Ends:
    """Ends of ranges of groups in order; ranges with several groups are refined when they matter."""

    def __init__(self, units: DataFrame):
        self.units = units
        rows = self._parts(units, _TOP)
        self.prefix, self.end, self.groups = ([r[k] for r in rows] for k in range(3))
        self.total = self.end[-1] if rows else 0

    @staticmethod
    def _parts(units: DataFrame, digits: int) -> list:
        parts = units.where("last").groupBy(F.substring("hex", 1, digits).alias("p")).agg(F.max("end").alias("e"), F.count(F.lit(1)).alias("g"))
        return sorted(parts.collect())

    def refine(self, at: set[int]) -> None:
        by_size: dict[int, list[str]] = {}
        for i in at:
            by_size.setdefault(len(self.prefix[i]), []).append(self.prefix[i])
        new = []
        for digits, names in by_size.items():
            some = self.units.where(F.col("range").isin(sorted({n[:_TOP] for n in names})) & F.substring("hex", 1, digits).isin(names))
            new += self._parts(some, digits + _STEP)
        rows = [r for i, r in enumerate(zip(self.prefix, self.end, self.groups, strict=True)) if i not in at] + [tuple(r) for r in new]
        rows.sort()
        self.prefix, self.end, self.groups = ([r[k] for r in rows] for k in range(3))

    def below(self, t: int) -> tuple[int, int | None]:
        """The last known end up to ``t``, and the range that may hold a later one."""
        i = bisect_right(self.end, t)
        low = self.end[i - 1] if i else 0
        return low, i if i < len(self.end) and self.groups[i] > 1 and low < t else None

    def above(self, t: int) -> tuple[int, int | None]:
        """The first known end from ``t`` on, and the range that may hold an earlier one."""
        i = bisect_left(self.end, t)
        return self.end[i], i if self.groups[i] > 1 and self.end[i] > t else None


def _feasible(ends: _Ends, capacity: int, shards: int) -> bool:
    while True:
        least, most, open_ = 0, 0, set()
        for _ in range(shards):
            for t, greedy in ((least + capacity, True), (most + capacity, False)):
                low, more = ends.below(min(t, ends.total))
                if more is not None:
                    open_.add(more)
                if greedy:
                    least = low
                else:
                    most = low if more is None else min(t, ends.total)
        if least >= ends.total:
            return True
        if most < ends.total:
            return False
        ends.refine(open_)


def _share(left: int, shards: int, large: list[int]) -> int:
    """An equal share of what is left, for the shards that no larger group takes."""
    share = left // shards
    while (apart := [b for b in large if b > share]) and len(apart) < shards:
        now = (left - sum(apart)) // (shards - len(apart))
        if now == share:
            break
        share = now
    return share


def _cuts(ends: _Ends, capacity: int, shards: int, large: list[tuple[int, int]]) -> list[int]:
    """Ends of the shards: within the capacity, and near to equal shares of what is left. ``large``: end and size of the largest groups."""
    while True:
        open_: set[int] = set()
        first = [ends.total]  # the rest fits into the later shards from here on
        for _ in range(shards - 1):
            cut, more = ends.above(max(0, first[0] - capacity)) if first[0] > capacity else (0, None)
            open_ |= {more} - {None}
            first.insert(0, cut)
        out, at = [], 0
        for i in range(shards - 1):
            share = at + _share(ends.total - at, shards - i, [b for e, b in large if e > at])
            top, more = ends.below(min(at + capacity, ends.total))
            low, less = ends.below(share)
            high, _ = ends.above(share) if share else (0, None)
            open_ |= {more, less} - {None}
            near = low if at < low and share - low <= high - share else high
            at = max(at, first[i], min(near, top))
            out.append(at)
        if not open_:
            return out
        ends.refine(open_)


def shard(docs: DataFrame, shards: int = SHARDS, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, size, crc, shard, slot)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
    )
    units = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    units = units.withColumn("hex", F.hex("digest")).withColumn("range", F.substring("hex", 1, _TOP))
    order = Window.partitionBy("range").orderBy("digest", "salt")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = written(units.select(
        "*", F.sum("n").over(running).alias("in_rows"), F.sum("bytes").over(running).alias("in_bytes"),
        (~F.col("digest").eqNullSafe(F.lead("digest").over(order))).alias("last"),
    ), "shard-units")
    # at most 4,096 ranges
    ranges = units.groupBy("range").agg(F.sum("n").alias("r"), F.sum("bytes").alias("b"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"))
    units = written(units.join(F.broadcast(ranges), "range").select(
        "range", "hex", "digest", "salt", "n", "bytes", "last",
        (F.col("rows_before") + F.col("in_rows") - F.col("n")).alias("before"), (F.col("bytes_before") + F.col("in_bytes")).alias("end"),
    ), "shard-ends")
    ends = _Ends(units)
    groups = units.groupBy("digest").agg(F.max("end").alias("e"), F.sum("bytes").alias("b"))
    large = [(r.e, r.b) for r in groups.orderBy(F.desc("b")).limit(shards).collect()]
    largest = large[0][1] if large else 0
    low = max(largest, -(-ends.total // shards))
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if _feasible(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    cuts = _cuts(ends, low, shards, large) if ends.total else []
    number = sum((F.when(F.col("group_end") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # a group's shard follows from its end, which its last unit holds
    whole = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = units.select("*", F.max("end").over(whole).alias("group_end")).select("digest", "salt", "n", "before", number.alias("shard"))
    placed = written(placed, "shard-places")
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("before")).collect()}
    start = F.coalesce(*(F.when(F.col("shard") == k, F.lit(v)) for k, v in first.items()), F.lit(0)) if first else F.lit(0)
    unit = Window.partitionBy("digest", "salt").orderBy(F.col("id").asc_nulls_last())
    return rows.join(placed.select("digest", "salt", "shard", (F.col("before") - start).alias("from")), ["digest", "salt"]).select(
        "id", "size", "crc", "shard", (F.col("from") + F.row_number().over(unit) - 1).cast("long").alias("slot"),
    )


def places(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
