"""Chrome and FXT files, the Parquet store, streaming."""

from __future__ import annotations

import json
import struct

import pytest
import zstandard
from helpers import of_duck, of_spark
from pyspark.sql.streaming import StreamingQuery

from spanforge.catalog import ORACLES, QUERIES
from spanforge.sources import chrome, fxt, scratch, store
from spanforge.streaming import ingest

EVENTS = [
    {"ph": "B", "ts": 10.0, "name": "a", "pid": 1, "tid": 2, "args": {"x": 3}, "loc": "c:/src/a.cpp:12"},
    {"ph": "X", "ts": 11.0, "dur": 2.0, "name": "b", "pid": 1, "tid": 2},
    {"ph": "E", "ts": 20.0, "pid": 1, "tid": 2},
    {"ph": "i", "ts": 12.0, "name": "hello", "pid": 1, "tid": 2},
    {"ph": "i", "ts": 13.0, "name": "Frame mark", "pid": 1, "tid": 2},
    {"ph": "C", "ts": 14.0, "name": "mem", "pid": 1, "tid": 2, "args": {"used_bytes": 5, "text": "no"}},
    {"ph": "M", "ts": 0.0, "name": "thread_name", "pid": 1, "tid": 2, "args": {"name": "main"}},
]


def test_chrome(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"traceEvents": EVENTS}))
    (tmp_path / "b.json.zst").write_bytes(zstandard.compress(json.dumps(EVENTS).encode()))
    t = chrome.tables(chrome.read(spark, str(tmp_path)))
    zones = t["zones"].collect()
    assert sorted((r.name, r.start, r.end, r.depth) for r in zones) == sorted([("a", 0, 10_000, 0), ("b", 1_000, 3_000, 1)] * 2)
    a = next(r for r in zones if r.name == "a")
    assert (a.text, a.file, a.line, a.thread) == ("x: 3\n", "c:/src/a.cpp", 12, (1 << 32) | 2)
    assert [r.text for r in t["messages"].collect()] == ["hello"] * 2 and t["frames"].count() == 2
    assert {(r.plot, r.val) for r in t["plot_points"].collect()} == {("mem-used_bytes", 5.0)}
    assert {(r.plot, r.format) for r in t["plots"].collect()} == {("mem-used_bytes", "Memory")}
    assert {(r.name, r.shown) for r in t["threads"].collect()} == {("main", "(PID 1 TID 2) main")}
    assert {(r.name, r.line) for r in t["source_locations"].collect()} == {("a", 12), ("b", None)}


def _word(*parts: tuple[int, int]) -> bytes:
    return struct.pack("<Q", sum(v << at for v, at in parts))


def fxt_file() -> bytes:
    out = struct.pack("<Q", fxt.MAGIC)
    out += _word((1, 0), (2, 4)) + struct.pack("<Q", 1_000_000)  # a microsecond a tick
    out += _word((2, 0), (2, 4), (1, 16), (4, 32)) + b"work\0\0\0\0"
    out += _word((3, 0), (3, 4), (1, 16)) + struct.pack("<QQ", 7, 9)
    event = lambda kind, ticks, extra=b"", n=0: _word((4, 0), (2 + len(extra) // 8, 4), (kind, 16), (n, 20), (1, 24), (1, 32), (1, 48)) + struct.pack("<Q", ticks) + extra
    out += event(2, 5) + event(3, 8)
    out += event(4, 10, struct.pack("<Q", 30))
    out += event(1, 11, _word((3, 0), (2, 4), (1, 16)) + struct.pack("<q", -4), 1)
    return out


def test_fxt(spark, tmp_path):
    rows = [(k, t, th, n, v, d) for k, t, th, n, _, v, d, _ in fxt.decode(fxt_file())]
    tid = 9 | 7 << 32
    assert rows == [("begin", 5000, tid, "work", None, None), ("end", 8000, tid, "work", None, None), ("complete", 10_000, tid, "work", None, 20_000), ("counter", 11_000, tid, "work", -4.0, None)]  # a plot is called as its argument
    (tmp_path / "a.fxt").write_bytes(fxt_file())
    (tmp_path / "broken.fxt").write_bytes(fxt_file()[:50])
    assert fxt.read(spark, str(tmp_path)).count() == 4
    assert fxt.decode(b"") == []


def test_fxt_gives_the_tables_of_a_chrome_trace(spark, tmp_path):
    name = lambda index, text: _word((2, 0), (1 + (len(text) + 7) // 8, 4), (index, 16), (len(text), 32)) + text.encode().ljust((len(text) + 7) // 8 * 8, b"\0")
    text_arg = lambda key, value: _word((6, 0), (1, 4), (key, 16), (value, 32))
    out = struct.pack("<Q", fxt.MAGIC) + _word((1, 0), (2, 4)) + struct.pack("<Q", 1_000_000)
    for i, text in enumerate(("zone", "loc", "a:b.cpp:12", "a frame", "note", "used", "main", "process"), 1):
        out += name(i, text)
    out += _word((3, 0), (3, 4), (1, 16)) + struct.pack("<QQ", 0, 9)
    event = lambda kind, ticks, ref, extra=b"", n=0: _word((4, 0), (2 + len(extra) // 8, 4), (kind, 16), (n, 20), (1, 24), (1, 32), (ref, 48)) + struct.pack("<Q", ticks) + extra
    out += event(2, 100, 1, text_arg(2, 3), 1) + event(0, 101, 4) + event(0, 102, 5) + event(1, 103, 1, _word((5, 0), (2, 4), (6, 16)) + struct.pack("<d", 1.5), 1) + event(3, 104, 1) + event(3, 105, 1)
    out += _word((7, 0), (4, 4), (2, 16), (7, 24), (1, 40)) + struct.pack("<Q", 9) + _word((8, 0), (2, 4), (8, 16)) + struct.pack("<Q", 0)
    (tmp_path / "a.fxt").write_bytes(out)
    t = fxt.tables(fxt.read(spark, str(tmp_path)))
    assert [(r.name, r.file, r.line, r.text, r.start, r.end, r.depth) for r in t["zones"].collect()] == [("zone", "a:b.cpp", 12, "loc: a:b.cpp:12\n", 0, 4000, 0)]
    assert [(r.frame_set, r.time) for r in t["frames"].collect()] == [("a frame", 1000)] and [r.text for r in t["messages"].collect()] == ["note"]
    assert [(r.plot, r.time, r.val) for r in t["plot_points"].collect()] == [("used", 3000, 1.5)] and [r.format for r in t["plots"].collect()] == ["Number"]
    assert [(r.thread, r.shown) for r in t["threads"].collect()] == [(9, "(9) main")]
    assert set(t) == set(chrome.tables(chrome.read(spark, str(tmp_path))))


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 2)], "capture_id string, thread long, time long")
    path, target = f"{tmp_path}/t", f"{tmp_path}/s"
    sizes = store.snapshot({"messages": rows, "samples": rows}, path)
    assert set(sizes) == {"messages", "samples"} and all(v > 0 for v in sizes.values())
    store.strip(spark, path, target, "m")
    assert set(store.read(spark, target)) == {"samples"}
    assert set(store.read(spark, path, without=("samples",))) == {"messages"}


def test_stream_keeps_open_zones_over_batches(spark, tmp_path):
    schema = "capture_id string, seq long, time long, thread long, kind string, name string"
    rows = [("A", 0, 0, 1, "begin", "a"), ("A", 1, 1, 1, "begin", "a"), ("A", 2, 2, 1, "end", None), ("A", 3, 3, 1, "begin", "b"), ("A", 4, 7, 1, "end", None), ("A", 5, 9, 1, "end", None), ("A", 6, 9, 1, "end", None)]
    for k in range(0, 7, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    log = ingest.event_log(spark, f"{tmp_path}/log", schema, files_per_batch=1)
    got = ingest.capture(log, f"{tmp_path}/zones", f"{tmp_path}/cp").collect()
    assert sorted((r.zone_id, r.start, r.end, r.depth, r.self_time, r.reentrant) for r in got) == [(0, 0, 9, 0, 4, False), (1, 1, 2, 1, 1, True), (3, 3, 7, 1, 4, False)]


class _Session:
    """What ``shared_dir`` asks a session for."""

    def __init__(self, master, path=None):
        self.master, self.path, self.sparkContext, self.conf = master, path, self, self

    def get(self, key, default):
        return self.path if key == "spark.checkpoint.dir" and self.path else default

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.path = path


def test_no_machine_local_folder_on_a_cluster():
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError, match="share"):
            scratch.shared_dir(_Session(master))
        assert scratch.shared_dir(_Session(master, "hdfs://x/")) == "hdfs://x"
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert "spanforge-" in scratch.shared_dir(_Session(master))


def test_late_events_are_told(spark, tmp_path):
    schema = "capture_id string, seq long, time long, thread long, kind string, name string"
    for rows in ([("A", 0, 0, 1, "begin", "a"), ("A", 3, 9, 1, "end", None)], [("A", 1, 2, 1, "begin", "b"), ("A", 2, 4, 1, "end", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    got = ingest.capture(ingest.event_log(spark, f"{tmp_path}/log", schema, files_per_batch=1), f"{tmp_path}/zones", f"{tmp_path}/cp").collect()
    assert sorted((r.zone_id, r.late) for r in got) == [(0, 0), (1, 2)]


def test_a_part_of_a_log_is_no_capture(spark, tmp_path):
    schema = "capture_id string, seq long, time long, thread long, kind string, name string"
    for k in range(0, 8, 2):
        spark.createDataFrame([("A", k, k, 1, "begin", "a"), ("A", k + 1, k + 1, 1, "end", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    log = ingest.event_log(spark, f"{tmp_path}/log", schema, files_per_batch=1)
    with pytest.raises(TimeoutError, match="a part of its zones"):
        ingest.capture(log, f"{tmp_path}/zones", f"{tmp_path}/cp", timeout=0.05)
    assert not spark.streams.active
    with pytest.raises(ValueError):
        ingest.capture(log, f"{tmp_path}/zones", f"{tmp_path}/cp", timeout=-1)
    assert not spark.streams.active
    got = ingest.capture(log, f"{tmp_path}/zones", f"{tmp_path}/cp", timeout=600).collect()
    assert sorted((r.zone_id, r.start, r.end) for r in got) == [(k, k, k + 1) for k in range(0, 8, 2)]


def test_the_capture_query_waits_for_its_whole_log(spark, duck, sf_dir, monkeypatch):
    """As with a log that takes longer than any limit."""
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda query, timeout=None: wait(query) if timeout is None else False)
    assert of_spark(QUERIES["q11_capture"](spark, sf_dir)) == of_duck(duck, ORACLES["q11_capture"])


def test_fxt_round_trip():
    rows = [("begin", 5, 7, 3, "näme", 0.0), ("instant", 6, 7, 3, "x", 0.0), ("counter", 7, 7, 3, "used", 2.5), ("end", 9, 7, 3, "", 0.0)]
    tid = 3 | 7 << 32
    assert [(k, t, th, n, v) for k, t, th, n, _, v, _, _ in fxt.decode(fxt.encode(rows))] == [("begin", 5, tid, "näme", None), ("instant", 6, tid, "x", None), ("counter", 7, tid, "used", 2.5), ("end", 9, tid, "", None)]
