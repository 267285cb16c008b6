"""Group operators that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

# Spark keeps only the best n rows of every input partition before a ranking
# window shuffles, up to this n (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank", splits: int = 64) -> DataFrame:
    """First ``n`` rows of every group, with their 1-based position in ``rank``.

    For small ``n`` Spark already cuts every input partition to ``n`` rows before
    the shuffle. Above that limit the group is first cut in ``splits`` slices, so
    the last step sees at most ``splits * n`` rows of a group.
    """
    if n > _GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(splits))
        first = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_slice", salt).withColumn("_pos", F.row_number().over(first))
        df = df.where(F.col("_pos") <= n).drop("_slice", "_pos")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, rank="_first").drop("_first")


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def in_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_span``: ranges of (keys, order) with about as many rows each, numbered in that order.

    A hot key is in many ranges, even if all its rows are of one moment, as long as ``order`` tells them apart. The rows
    are stored, so that all that is computed on them sees the same ranges.
    """
    return stored(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_span", F.spark_partition_id()), "ranges")


def _on(keys: list[str]) -> Column:
    return F.expr(" AND ".join([f"l.{k} <=> c.{k}" for k in keys] + ["l._span = c._span"]))


def carry_forward(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Fill each of ``values`` with its latest non-null value at or before a row, in the given order.

    A running window over a whole key would put a hot key in one task. The rows are cut in ranges of (key, order)
    instead: a window inside each range, plus one row per range and key that carries the last value of those before it.
    """
    cut = in_ranges(df, keys, order)
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_here_{v}") for v in values])
    # the last value of a range, found by its rows' place in it
    place = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*order)))
    last = place.groupBy(*keys, "_span").agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("_at"))).alias(f"_last_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_span", *[F.last(f"_last_{v}", ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])
    out = local.alias("l").join(carried.alias("c"), _on(keys), "left")
    keep = [F.col(f"l.{c}") for c in df.columns if c not in values]
    return out.select(*keep, *[F.coalesce(f"l._here_{v}", f"c._in_{v}").alias(v) for v in values])


def running_count(df: DataFrame, keys: list[str], order: list[Column], counted: Column, name: str) -> DataFrame:
    """Number of ``counted`` rows of the key at or before each row.

    Like ``carry_forward``: a window inside each range of rows plus a prefix sum over ranges.
    """
    cut = in_ranges(df.withColumn("_one", F.when(counted, 1).otherwise(0).cast("long")), keys, order)
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_here", F.sum("_one").over(inside))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_span").agg(F.sum("_one").alias("_n"))
    shift = totals.select(*keys, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = local.alias("l").join(shift.alias("c"), _on(keys))
    return out.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._here") + F.col("c._before")).alias(name))


_RUN = "[a-z0-9]"


def _grams(text: Column) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(f"(?=({_RUN}{{{n}}}))"), F.lit(1)) for n in (1, 2, 4)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *parts))


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, on: list[str] = ()) -> DataFrame:
    """Pairs whose lower-case ``text`` contains ``term``, as an equi-join.

    A contained term brings its first run of letters or digits into the text, so
    the first 4 (or 2, or 1) characters of that run are the join key; the
    substring test then decides.
    """
    run = F.regexp_extract(term, f"{_RUN}+", 0)
    size = F.when(F.length(run) >= 4, 4).when(F.length(run) >= 2, 2).otherwise(F.length(run))
    right = terms.withColumn("_gram", run.substr(F.lit(1), size))
    left = texts.withColumn("_gram", F.explode(_grams(F.col(text))))
    return left.join(right, [*on, "_gram"]).where(F.col(text).contains(F.col(term))).drop("_gram")
