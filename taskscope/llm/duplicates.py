"""Exact dedup as a stream with keyed state, in DataFrame operations only.

A table of (digest, id, place) is streamed into a state that never expires and lives on disk (RocksDB, checkpointed in
the shared folder): for each digest the number of rows, the identifier that stays (the largest) and its place, which
locates the retained text. Each micro-batch updates it, so new documents only cost their own digests. Where a digest has
several rows, the full bytes of every row are compared with the retained text. Rows whose bytes differ in spite of an
equal digest are grouped by their text instead, so the result doesn't rest on the digest.

The comparison meets the copies of one text in many tasks: the retained text goes to as many salts as its group needs.

Defined results: a null text counts as empty; A-Z and a-z are equal, other letters differ by case; a null id is smaller
than any other; rows that repeat an id and a text both count in ``group_size``, and both are ``kept`` if theirs is the
id that stays (``survivors`` returns one of them); other columns are ignored, and stay as they are in ``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .store import shared_path, write, written

#: Rows of a group that one task compares with a copy of the retained text.
ROWS_PER_SALT = 1000
#: Files of digests in one micro-batch.
FILES_PER_BATCH = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z in lower case; ``lower`` does the same, and faster, where all other letters are lower case."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[^\x00-\x7F\p{Ll}]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _state(digests: DataFrame, folder: str) -> DataFrame:
    """Stream the digests into keyed state; one row for each digest: its rows, and the id that stays."""
    spark = digests.sparkSession
    out = shared_path(spark, "dedup-state")

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")

    session = spark.newSession()  # the state store's settings are the session's
    for k, v in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # many small stores: no space reserved ahead, and commits that upload changes instead of whole files
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }.items():
        session.conf.set(k, v)
    if digests.inputFiles():
        stream = session.readStream.schema(digests.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)
        changes = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "place")).alias("last"))
        changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "place")).alias("last")).write.parquet(f"{out}/changes/batch=0")
    changes = spark.read.parquet(f"{out}/changes")
    # counts and ids only grow, so the last change of a digest is the largest
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max("last").alias("last"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: (id, digest, keep_id, group_size)."""
    texts = docs.select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("text"))
    # the place of a text tells copies of one id apart; it is found again by id and by a second hash
    digests = texts.select("id", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("place"))
    folder = write(digests, "digests")
    digests = docs.sparkSession.read.schema(digests.schema).parquet(folder)
    state = written(_state(digests, folder), "dedup-groups")
    groups = state.where("n > 1").select(F.col("digest").alias("_digest"), "n", F.col("last.id").alias("keep_id"), F.col("last.place").alias("keep_place"))
    # full bytes of every row whose digest was seen before
    hits = written(texts.withColumn("digest", digest(F.col("text"))).join(groups, F.expr("digest = _digest")).select(
        "id", "text", "digest", (F.expr("id <=> keep_id") & (F.xxhash64("text") == F.col("keep_place"))).alias("retained"),
        F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts"),
    ), "dedup-hits")
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    first = hits.where("retained").dropDuplicates(["digest"]).select(
        F.col("digest").alias("_digest"), F.col("text").alias("_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"),
    )
    differ = salted.join(first, F.expr("digest = _digest and salt = _salt")).where("text <> _text").select("id", "digest", "text")
    apart = written(differ, "dedup-collisions")  # empty unless two texts share a digest
    own = apart.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("own_n"), F.max("id").alias("own_id"))
    lost = own.groupBy("digest").agg(F.sum("own_n").alias("lost"))
    rows = digests.select("id", "digest", "place")
    joined = rows.join(state.select("digest", "n", F.col("last.id").alias("keep_id")), "digest").join(lost, "digest", "left")
    joined = joined.join(
        own.select("digest", F.xxhash64("text").alias("place"), "own_n", "own_id"), ["digest", "place"], "left",
    )
    return joined.select(
        "id", "digest", "place", F.when(F.col("own_n").isNull(), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
        F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    return classes(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one for each text, with all their columns."""
    stay = classes(docs, id_col, text_col).where("id <=> keep_id").groupBy("id", "place").agg(F.count(F.lit(1)).alias("__n"))
    stay = written(stay.select(F.col("id").alias("__id"), F.col("place").alias("__place"), "__n"), "dedup-stay")
    columns = [F.col(c) for c in docs.columns]
    joined = docs.withColumn("__p", F.xxhash64(folded(F.col(text_col)))).join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & F.expr("__p = __place"))
    if stay.where("__n > 1").isEmpty():
        return joined.select(*columns)
    # of rows that repeat an id and a text, one stays
    return joined.where("__n = 1").select(*columns).unionAll(joined.where("__n > 1").dropDuplicates(["__id", "__place"]).select(*columns))
