"""Cooldown and repeat-request gates: the next start depends on the last *accepted* one.

The batch form cuts a key in time spans. A span is summarised as a step function
from "earliest allowed start" to "last start inside the span"; the functions of a key
are chained span by span, and every span is then resolved by itself. So a key that
holds a large share of all events is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as C


def _helpers(gap: int, strict: bool):
    """Numpy helpers shipped by value; times are microseconds."""
    none = np.iinfo(np.int64).min
    side = "right" if strict else "left"

    def allowed(last: int) -> int:
        """First microsecond at which a start is allowed after the start at ``last``."""
        return last + gap + (1 if strict else 0)

    def exits(ts: np.ndarray) -> np.ndarray:
        """For each event, taken as a start: the last start of its chain inside ``ts``."""
        follow = np.searchsorted(ts, ts + gap, side=side)
        out = np.empty(len(ts), dtype=np.int64)
        for i in range(len(ts) - 1, -1, -1):
            out[i] = ts[i] if follow[i] >= len(ts) else out[follow[i]]
        return out

    def starts(ts: np.ndarray, earliest: int) -> np.ndarray:
        """Positions of the events that start when nothing may start before ``earliest``."""
        taken = []
        i = int(np.searchsorted(ts, earliest, side="left"))
        while i < len(ts):
            taken.append(i)
            i = int(np.searchsorted(ts, ts[i] + gap, side=side))
        return np.array(taken, dtype=np.int64)

    return none, allowed, exits, starts


def _gate(df: DataFrame, key: str, ts: str, order: str, gap_seconds: int, strict: bool, span_seconds: int) -> DataFrame:
    gap = gap_seconds * 1_000_000
    none, allowed, exits, starts = _helpers(gap, strict)
    span = max(span_seconds, gap_seconds + 1) * 1_000_000
    kind = df.schema[key].dataType.simpleString()
    oid = df.schema[order].dataType.simpleString()
    cut = df.select(F.col(key).alias("k"), F.unix_micros(ts).alias("us"), F.col(order).alias("o")).withColumn("span", F.floor(F.col("us") / span).cast("long"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf["us"].to_numpy())
        last = exits(times)
        # one step per run of first events with the same last start
        keep = np.append(last[1:] != last[:-1], True)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "span": pdf["span"].iloc[0], "upto": times[keep], "exit": last[keep]})

    steps = cut.groupBy("k", "span").applyInPandas(summarise, f"k {kind}, span long, upto long, exit long")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["span", "upto"])
        last, out = none, []
        for number, part in pdf.groupby("span", sort=False):
            out.append((pdf["k"].iloc[0], number, last))
            earliest = none if last == none else allowed(last)
            at = int(np.searchsorted(part["upto"].to_numpy(), earliest, side="left"))
            if at < len(part):
                last = int(part["exit"].to_numpy()[at])
        return pd.DataFrame(out, columns=["k", "span", "last"])

    before = steps.groupBy("k").applyInPandas(chain, f"k {kind}, span long, last long")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "o"]).reset_index(drop=True)
        last = pdf["last"].iloc[0]
        times = pdf["us"].to_numpy()
        taken = starts(times, none if last == none else allowed(last))
        flag = np.zeros(len(pdf), dtype=bool)
        flag[taken] = True
        at = np.where(flag, times, none)
        at = np.maximum.accumulate(np.maximum(at, last))
        return pd.DataFrame({"k": pdf["k"], "o": pdf["o"], "started": flag, "since": np.where(at == none, times, at)})

    joined = cut.join(before, ["k", "span"])
    out = joined.groupBy("k", "span").applyInPandas(resolve, f"k {kind}, o {oid}, started boolean, since long")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "started", F.timestamp_micros("since").alias("started_at"))


def cooldown(
    events: DataFrame, key: str = "workspace", ts: str = "ts", order: str = "event_id", seconds: int = C.COOLDOWN_SECONDS, span_seconds: int = 6 * 3600
) -> DataFrame:
    """Which events start work: not within ``seconds`` of the last start of their key.

    Gives ``started`` and ``started_at``, the start an event falls under.
    """
    return _gate(events, key, ts, order, seconds, False, span_seconds)


def repeat_requests(
    requests: DataFrame, key: str = "key", ts: str = "ts", order: str = "request_id", seconds: int = C.CACHE_TTL_SECONDS, span_seconds: int = 6 * 3600
) -> DataFrame:
    """Cache hits: a request at most ``seconds`` after the creation of its key's entry.

    A hit does not renew the entry.
    """
    out = _gate(requests, key, ts, order, seconds, True, span_seconds)
    return out.select(key, order, (~F.col("started")).alias("cache_hit"), F.col("started_at").alias("created_at"))


def request_key(payload_columns: list[str]):
    """sha256 over the stable parts of a request."""
    return F.sha2(F.to_json(F.struct(*payload_columns)), 256)


def stream_cooldown(stream: DataFrame, key: str = "workspace", ts: str = "ts", order: str = "event_id", seconds: int = C.COOLDOWN_SECONDS) -> DataFrame:
    """The same gate on a stream, with the last start of every key as its state.

    Events of one micro-batch are put in time order; an event older than the last
    start has a negative age and does not block. The stream needs a watermark on
    ``ts``; a key is forgotten once the watermark has passed its cooldown.
    """
    kind = stream.schema[key].dataType.simpleString()
    oid = stream.schema[order].dataType.simpleString()
    gap = pd.Timedelta(seconds=seconds)

    def step(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # one micro-batch of one key; the trigger bounds its size
        rows = pd.concat(list(batches)).sort_values([ts, order])
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        flags = []
        for at in rows[ts]:
            age = None if last is None else at - last
            start = age is None or age < pd.Timedelta(0) or age >= gap
            flags.append(start)
            if start:
                last = at
        state.update((int(last.value // 1000),))
        horizon = int(last.value // 1_000_000) + seconds * 1000 + 1
        state.setTimeoutTimestamp(max(horizon, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], order: rows[order].to_numpy(), "started": flags})

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {order} {oid}, started boolean", "last long", "append", "EventTimeTimeout"
    )
