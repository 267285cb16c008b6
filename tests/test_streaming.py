"""Streams over several files and micro-batches, with corrupt and late lines."""

import json

from pyspark.sql import functions as F

from taskscope.operators import telemetry
from taskscope.streaming import events as ev, gates


def _line(ts, event="tool", workspace="w", payload=None):
    return json.dumps({"ts": f"2024-01-01T{ts}Z", "event": event, "workspace": workspace, "payload": json.dumps(payload or {"tool": "query_graph"})})


def _write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_ingest_skips_corrupt_lines(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "a.json", _line("10:00:00"), "{broken", _line("10:05:00", payload={"command": "rtk ls"}), json.dumps({"event": "no time"}))
    _write(folder, "b.json", _line("10:06:00", payload={"x": "nothing"}))
    out = ev.run_available(ev.ingest(spark, str(folder))).orderBy("ts").collect()
    assert [(r.signals, r.tool_signals, r.command_signals) for r in out] == [(["query_graph"], ["query_graph"], []), (["rtk"], ["rtk ls"], ["rtk ls"]), ([], [], [])]


def test_windows_count_open_and_late_rows_in_update_mode(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "a.json", _line("10:00:00"), _line("10:59:59"), _line("11:00:00", event="stop"))
    stream = spark.readStream.schema(ev.EVENT_SCHEMA).json(str(folder))
    changes = ev.run_available(ev.windowed_counts(stream), "update")
    got = {(r.start.hour, r.event): r.n for r in changes.groupBy("start", "event").agg(F.max("n").alias("n")).collect()}
    assert got == {(10, "tool"): 2, (11, "stop"): 1}


def test_latest_records_over_two_runs(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    stream = lambda: spark.readStream.schema(ev.EVENT_SCHEMA).json(str(folder))
    _write(folder, "a.json", _line("10:00:00", workspace="w"), _line("10:01:00", workspace="w", event="second"), _line("10:00:00", workspace="v"))
    ev.upsert_latest(stream(), table, ["workspace"], "ts", checkpoint).awaitTermination()
    _write(folder, "b.json", _line("09:00:00", workspace="w", event="late"), _line("10:09:00", workspace="v", event="new"))
    ev.upsert_latest(stream(), table, ["workspace"], "ts", checkpoint).awaitTermination()
    got = {r.workspace: r.event for r in ev.read_latest(spark, table, ["workspace"], "ts").collect()}
    assert got == {"w": "second", "v": "new"}


def test_stop_sees_the_signals_since_its_prompt(spark, tmp_path):
    events, stops = tmp_path / "events", tmp_path / "stops"
    _write(events, "a.json", _line("09:00:00", payload={"tool": "rtk"}), _line("10:00:00"), _line("10:01:00", workspace="other", payload={"tool": "agentmemory"}))
    _write(stops, "a.json", json.dumps({"workspace": "w", "stop_id": 1, "ts": "2024-01-01T10:05:00Z", "since": "2024-01-01T09:30:00Z"}))
    stop = spark.readStream.schema("workspace STRING, stop_id INT, ts TIMESTAMP, since TIMESTAMP").json(str(stops)).withWatermark("ts", "10 minutes")
    found = ev.run_available(ev.correlate(stop, ev.ingest(spark, str(events)), lateness=None, per_stop=False)).collect()
    assert [(r.stop_id, r.signal) for r in found] == [(1, "query_graph")]


def test_stream_gate_equals_the_batch_gate(spark, tmp_path):
    folder = tmp_path / "in"
    times = [0, 5, 14, 15, 29, 31, 60]
    _write(folder, "a.json", *[json.dumps({"workspace": "w", "event_id": k, "ts": f"2024-01-01T10:{m:02d}:00Z" if m < 60 else "2024-01-01T11:00:00Z"}) for k, m in enumerate(times)])
    schema = "workspace STRING, event_id LONG, ts TIMESTAMP"
    stream = spark.readStream.schema(schema).json(str(folder)).withWatermark("ts", "1 minute")
    streamed = {r.event_id: r.started for r in ev.run_available(gates.stream_cooldown(stream)).collect()}
    batch = {r.event_id: r.started for r in gates.cooldown(spark.read.schema(schema).json(str(folder))).collect()}
    assert streamed == batch == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_stop_signals_equal_the_batch_evidence_over_long_gaps(spark, tmp_path):
    events, stops = tmp_path / "events", tmp_path / "stops"
    at = lambda h: f"2024-01-0{1 + h // 24}T{h % 24:02d}:00:00Z"
    rows = [(1, "w", 0, "a"), (2, None, 1, "b"), (3, "v", 2, "c"), (4, "w", 20, "d"), (5, None, 21, "e"), (6, "w", 30, "f"), (7, "v", 60, "g")]
    _write(events, "a.json", *[json.dumps({"event_id": i, "workspace": w, "ts": at(h), "signals": [x]}) for i, w, h, x in rows])
    ends = [(1, "w", 22, 0), (2, "w", 22, None), (3, None, 22, 2), (4, None, 31, None), (5, "v", 22, 1)]
    _write(stops, "a.json", *[json.dumps({"stop_id": i, "workspace": w, "ts": at(h), "since": at(p) if p is not None else None}) for i, w, h, p in ends])
    e, s = "event_id LONG, workspace STRING, ts TIMESTAMP, signals ARRAY<STRING>", "stop_id LONG, workspace STRING, ts TIMESTAMP, since TIMESTAMP"
    stream = lambda schema, folder: spark.readStream.schema(schema).json(str(folder))
    batch = lambda schema, folder: spark.read.schema(schema).json(str(folder)).withColumn("log", F.lit("l"))
    found = ev.run_available(ev.correlate(stream(s, stops), stream(e, events), per_stop=False))
    want = telemetry.evidence_window(batch(s, stops), batch(e, events))
    got = sorted((r.stop_id, r.signal) for r in found.collect())
    assert got == sorted((r.stop_id, x) for r in want.collect() for x in r.signals)
    assert [x for i, x in got if i == 2] == ["a", "b", "d", "e"] and [x for i, x in got if i == 4] == list("abcdef")

    # the same from keyed state, which holds a time for each signal instead of all events
    late = [(8, "z", 200, "z")]  # moves the watermark past every stop
    _write(events, "b.json", *[json.dumps({"event_id": i, "workspace": w, "ts": at(h), "signals": [x]}) for i, w, h, x in late])
    _write(stops, "b.json", json.dumps({"stop_id": 99, "workspace": "z", "ts": at(205), "since": None}))
    with ev.rocksdb(spark):
        kept = ev.run_available(ev.stop_signals(stream(s, stops), stream(e, events)))
    assert sorted({(r.stop_id, r.signal) for r in kept.collect()}) == got


def test_late_events_count_until_the_watermark_has_passed(spark, tmp_path):
    events, stops = tmp_path / "events", tmp_path / "stops"
    e, s = "workspace STRING, ts TIMESTAMP, signals ARRAY<STRING>", "stop_id LONG, workspace STRING, ts TIMESTAMP, since TIMESTAMP"
    event = lambda ts, *x, w="w": json.dumps({"workspace": w, "ts": f"2024-01-01T{ts}Z", "signals": x})
    stop = lambda i, ts, since, w="w": json.dumps({"stop_id": i, "workspace": w, "ts": f"2024-01-01T{ts}Z", "since": since and f"2024-01-01T{since}Z"})
    _write(events, "1.json", event("10:00:00", "a"), event("10:20:00", "a", "b"))
    _write(stops, "1.json", stop(1, "10:10:00", "10:05:00"), stop(2, "10:20:00", "10:15:00"))
    # after the stop in arrival, before it in time
    _write(events, "2.json", event("10:06:00", "late"), event("10:30:00", "c"))
    _write(stops, "2.json", stop(3, "10:12:00", None))
    _write(events, "3.json", event("14:00:00", "z"))
    _write(stops, "3.json", stop(4, "14:00:00", "13:00:00"))
    read = lambda schema, folder: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(folder))
    with ev.rocksdb(spark):
        out = ev.run_available(ev.stop_signals(read(s, stops), read(e, events), "30 minutes"))
    assert sorted((r.stop_id, r.signal) for r in out.collect()) == [(1, "late"), (2, "a"), (2, "b"), (3, "a"), (3, "late")]


class _Held(dict):
    """Keyed state in memory that notes the longest list it was ever given."""

    longest = 0

    def updateValue(self, key, value):
        _Held.longest = max([_Held.longest, *map(len, value)])
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))

    removeKey = dict.pop
    getValue = dict.get
    containsKey = dict.__contains__

    # a value or a list
    def update(self, value):
        self["v"] = value

    def appendList(self, values):
        _Held.longest = max(_Held.longest, len(values))
        self.setdefault("l", []).extend(values)

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def clear(self):
        self.pop("v", None)


class _Handle:
    def getMapState(self, *_):
        return _Held()

    getListState = getValueState = getMapState

    def registerTimer(self, ms):
        pass

    deleteTimer = registerTimer


def test_keyed_state_never_holds_all_stops_or_times_in_one_list():
    import pandas as pd

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    n, clock, processor = 45_000, Clock(), ev._LastSeen()
    _Held.longest = 0
    processor.init(_Handle())
    frame = lambda signal, at, **more: pd.DataFrame({"us": at, "signal": signal, "workspace": None, "stop_id": 0, "since": 0} | more)
    ticks = [range(k, k + 9_000) for k in range(0, n, 9_000)]
    rows = [frame("a", [2_000 * t for t in tick]) for tick in ticks] + [frame(None, [2_000 * t + 1 for t in tick], stop_id=list(tick), since=[2_000 * t + t % 2 for t in tick]) for tick in ticks]
    list(processor.handleInputRows(("k",), iter(rows), clock))
    assert 0 < _Held.longest <= 10_000
    clock.now = n  # half of the stops are open still
    half = pd.concat(processor.handleExpiredTimer(("k",), clock, None))
    assert sorted(half["stop_id"]) == list(range(0, n // 2, 2))
    clock.now = 3 * n
    rest = pd.concat(processor.handleExpiredTimer(("k",), clock, None))
    assert sorted([*half["stop_id"], *rest["stop_id"]]) == list(range(0, n, 2)) and not processor.stops
