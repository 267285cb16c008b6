"""Streams of tool events: ingest, evidence of stops, counters and latest reports."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.parsing import extract_signals
from ..operators.telemetry import latest
from ..session import shared_folder

SALTS = 8
#: Stops or times of one value of the keyed state.
_PIECE = 10_000
EVENT_SCHEMA = "ts TIMESTAMP, event STRING, workspace STRING, payload STRING"


def ingest(spark: SparkSession, path: str, schema: StructType | str = EVENT_SCHEMA, lateness: str = "10 minutes") -> DataFrame:
    """Telemetry lines with their signals; corrupt lines are skipped, late ones bounded by the watermark."""
    raw = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return with_signals(raw.where(F.col("ts").isNotNull()), lateness)


def with_signals(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return extract_signals(stream.withWatermark("ts", lateness))


def correlate(
    stops: DataFrame, events: DataFrame, lateness: str | None = "10 minutes", longest: str | None = None, per_stop: bool = True
) -> DataFrame:
    """Signals of the events between the prompt of a stop and the stop.

    ``stops(workspace, stop_id, ts, since)``, ``events(workspace, ts, signals)`` as streams.
    A missing workspace goes with every workspace, and a stop without ``since`` takes all events up to it, as in
    ``telemetry.evidence_window``. ``longest`` bounds the time between prompt and stop, and so the state kept; without
    it nothing is dropped, and all events stay in the state. ``lateness`` is null for streams that
    have their watermark already, as ``ingest`` gives it.
    """
    marked = lambda df: df if lateness is None else df.withWatermark("ts", lateness)
    s = marked(stops).select("workspace", "stop_id", F.col("ts").alias("stop_ts"), "since")
    e = marked(events).select(F.col("workspace").alias("_w"), F.col("ts").alias("event_ts"), "signals")
    # keys as (side without a workspace, workspace or salt), so that each pair meets under one key
    named = lambda c: F.struct(F.lit("").alias("none"), F.col(c).cast("string").alias("at"))
    salted = lambda none, n: F.struct(F.lit(none).alias("none"), n.cast("string").alias("at"))
    salts = lambda none: [salted(none, F.lit(k)) for k in range(SALTS)]
    salt = F.pmod(F.xxhash64("event_ts", "signals"), F.lit(SALTS))
    s = s.withColumn("_k", F.explode(F.when(F.col("workspace").isNull(), F.array(*salts("stop"))).otherwise(F.array(named("workspace"), *salts("event")))))
    # a stop without a workspace meets all events, one with a workspace its own and those without
    e = e.withColumn("_e", F.explode(F.when(F.col("_w").isNull(), F.array(salted("event", salt), salted("stop", salt))).otherwise(F.array(named("_w"), salted("stop", salt)))))
    window = F.expr("event_ts <= stop_ts" + (f" AND event_ts >= stop_ts - INTERVAL {longest}" if longest is not None else ""))
    pairs = s.join(e, (F.col("_k") == F.col("_e")) & window & (F.col("since").isNull() | (F.col("event_ts") >= F.col("since"))))
    found = pairs.select("workspace", "stop_id", "stop_ts", "event_ts", F.explode("signals").alias("signal"))
    if not per_stop:
        return found
    # one small set of signal words per stop
    return found.groupBy(F.window("stop_ts", "1 minute"), "workspace", "stop_id").agg(F.array_sort(F.collect_set("signal")).alias("signals")).drop("window")


class _LastSeen(StatefulProcessor):
    """The times of each signal of a key that may still matter: the last one the watermark has passed, and all later ones.

    A signal is in the evidence of a stop if and only if its last time up to the stop is not before ``since``. So one time
    for each signal is enough once no late event can come before it; a stop waits for the watermark, then it is answered.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        # pieces of bounded size, so that no call and no list holds all times or all stops of a key
        self.times = handle.getMapState("times", "signal string, piece long", "us array<long>")
        self.stops = handle.getMapState("stops", "due long, piece long", "workspace array<string>, stop_id array<long>, until array<long>, since array<long>")
        self.piece = handle.getValueState("piece", "n long")
        self.timer = handle.getValueState("timer", "ms long")
        self.handle = handle

    def _wake(self, until: int) -> None:
        """One timer for a key: that of its earliest open stop."""
        due = until // 1000 + 1
        now = self.timer.get() if self.timer.exists() else None
        if now is None or due < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def _keep(self, workspace, stop_id, until, since) -> int:
        """Store stops as one more piece; its earliest end."""
        n = self.piece.get()[0] if self.piece.exists() else 0
        self.piece.update((n + 1,))
        due = int(until.min())
        names = [None if pd.isna(w) else w for w in workspace]
        self.stops.updateValue((due, n), (names, stop_id.tolist(), until.tolist(), since.tolist()))
        return due

    def _seen(self) -> dict[str, np.ndarray]:
        """Sorted times of each signal."""
        pieces: dict[str, list[tuple[int, np.ndarray]]] = {}
        for (signal, n), (us,) in self.times.iterator():
            pieces.setdefault(signal, []).append((n, np.array(us, dtype=np.int64)))
        return {signal: np.concatenate([us for _, us in sorted(found, key=lambda x: x[0])]) for signal, found in pieces.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        fresh: dict[str, list[np.ndarray]] = {}
        first = None
        for batch in rows:
            marks = batch[batch["signal"].notna()]
            for signal, times in marks.groupby("signal")["us"]:
                fresh.setdefault(signal, []).append(np.unique(times.to_numpy(dtype=np.int64)))
            open_ = batch[batch["signal"].isna()]
            for at in range(0, len(open_), _PIECE):
                some = open_.iloc[at:at + _PIECE]
                due = self._keep(some["workspace"], *(some[c].astype("int64").to_numpy() for c in ("stop_id", "us", "since")))
                first = due if first is None else min(first, due)
        if first is not None:
            self._wake(first)
        if self.timer.exists():  # the earliest open stop is not answered yet
            passed = min(passed, (self.timer.get()[0] - 1) * 1000)
        seen = self._seen() if fresh else {}
        for signal, new in fresh.items():
            known = seen.get(signal, np.empty(0, np.int64))
            every = np.unique(np.concatenate([known, *new]))
            every = every[max(0, int(np.searchsorted(every, passed, "right")) - 1):]
            for n in range(-(-max(len(every), len(known)) // _PIECE)):
                some = every[n * _PIECE:(n + 1) * _PIECE]
                self.times.updateValue((signal, n), (some.tolist(),)) if len(some) else self.times.removeKey((signal, n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        seen = self._seen()
        wait = []
        for due, n in sorted(tuple(k) for k in self.stops.keys()):
            if due >= passed:
                wait.append(due)
                continue
            workspace, stop_id, until, since = (np.array(v, dtype=t) for v, t in zip(self.stops.getValue((due, n)), (object, np.int64, np.int64, np.int64), strict=True))
            self.stops.removeKey((due, n))
            late = until >= passed
            if late.any():
                wait.append(self._keep(workspace[late], stop_id[late], until[late], since[late]))
            for signal, times in seen.items():
                at = np.searchsorted(times, until, "right") - 1
                hit = ~late & (at >= 0) & (times[np.maximum(at, 0)] >= since)
                if hit.any():
                    yield pd.DataFrame({"workspace": workspace[hit], "stop_id": stop_id[hit], "signal": signal})
        if wait:
            self._wake(min(wait))

    def close(self) -> None:
        pass


def stop_signals(stops: DataFrame, events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The signals of each stop's evidence, once the watermark has passed it: (workspace, stop_id, signal).

    ``stops(workspace, stop_id long, ts, since)`` and ``events(workspace, ts, signals)`` as streams; what belongs together
    is as in ``telemetry.evidence_window``, over gaps of any length. The state of a workspace holds about one time for
    each of its signal words, not its events. Events without a workspace are dealt to ``SALTS`` keys, and a stop without one
    asks ``SALTS`` keys that all events are dealt to, so a signal may come more than once; ``distinct`` per stop joins them.
    Rows without a time have no place.
    Needs the RocksDB state store, as ``rocksdb`` sets it.
    """
    events, stops = (df.where(F.col("ts").isNotNull()) for df in (events, stops))
    e = events.withWatermark("ts", lateness).select("ts", F.col("workspace").cast("string").alias("workspace"), F.explode("signals").alias("signal"))
    salt = F.pmod(F.xxhash64("ts", "signal"), F.lit(SALTS)).cast("string")
    own = lambda c: F.concat(F.lit("own:"), c)
    known = F.col("workspace").isNotNull()
    every = F.concat(F.lit("all:"), salt)
    e = e.withColumn("key", F.explode(F.array(F.when(known, own(F.col("workspace"))).otherwise(F.concat(F.lit("none:"), salt)), every)))
    s = stops.withWatermark("ts", lateness).withColumn("workspace", F.col("workspace").cast("string"))
    salts = lambda name: [F.lit(f"{name}:{k}") for k in range(SALTS)]
    s = s.withColumn("key", F.explode(F.when(known, F.array(own(F.col("workspace")), *salts("none"))).otherwise(F.array(*salts("all")))))
    null = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")  # a null would make pandas read the numbers as floats
    rows = e.select("key", "ts", F.unix_micros("ts").alias("us"), "signal", null("string").alias("workspace"), zero.alias("stop_id"), zero.alias("since"))
    rows = rows.unionAll(s.select(
        "key", "ts", F.unix_micros("ts").alias("us"), null("string").alias("signal"), "workspace", F.col("stop_id").cast("long").alias("stop_id"),
        F.coalesce(F.unix_micros("since"), F.lit(-(2**62)).cast("long")).alias("since"),
    ))
    return rows.groupBy("key").transformWithStateInPandas(_LastSeen(), "workspace string, stop_id long, signal string", "Append", "EventTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed state with timers needs, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def running_counts(stream: DataFrame) -> DataFrame:
    """Events by workspace and name; for update mode."""
    return stream.groupBy("workspace", "event").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and name."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "event", "n"
    )


# --- sinks --------------------------------------------------------------------


def upsert_latest(stream: DataFrame, path: str, key: list[str], ts: str, checkpoint: str):
    """Keep the latest record of every key under ``path``.

    Every micro-batch adds its own latest records as one partition, replaced when the
    batch is retried; ``read_latest`` resolves the partitions.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, key, ts).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: list[str], ts: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), key, ts)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read its result as a table.

    Append results go to a file sink. Update results are kept per micro-batch with the
    batch number in ``batch``; the newest row of a key is the current one.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        handle = writer.format("parquet").option("path", f"{folder}/table").start()
    else:
        handle = writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/table/batch={n}")).start()
    handle.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{folder}/table")
