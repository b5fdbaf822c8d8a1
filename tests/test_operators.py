"""Operators on traces made by hand, and state machines as second oracles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanforge.functions import predicates as P
from spanforge.operators import cpu, findzone, frames, gpu, locks, memory, sampling, trace
from spanforge.operators import zones as zone_operators
from spanforge.plans import stats
from spanforge.plans.intervals import as_of, covering, overlapping


def test_two_percentile_rules(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "dur long")
    assert stats.nearest_rank(df, [], "dur", (0.9,)).first().p90 == 10
    assert abs(stats.interpolated(df, [], "dur", 0.9, "p").first().p - 9.1) < 1e-9


def test_order_statistics_equal_sorting(spark):
    rnd = random.Random(5)
    groups = {"wide": [rnd.randint(-(1 << 60), 1 << 60) for _ in range(300)], "same": [7] * 50, "near": [(1 << 50) + rnd.randint(0, 40) for _ in range(300)], "small": [rnd.randint(-3, 3) for _ in range(90)], "one": [5], None: [2, 1, 2]}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [("one", None), ("none", None)], "g string, v long")
    got = {r.g: r for r in stats.nearest_rank(df, ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x = sorted(x)
        assert [got[g][c] for c in ("p50", "p75", "p90", "p99", "p99_9")] == [x[min(len(x) - 1, int(p * len(x)))] for p in stats.RANKS]


def test_bins_equal_a_scan_of_edges(spark):
    rnd = random.Random(6)
    groups = {"a": [rnd.randint(1, 40) for _ in range(60)], "b": [10 ** rnd.randint(0, 15) + rnd.randint(0, 9) for _ in range(200)], "c": [5, 5], "d": [3, 4, 6]}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "g string, v long")
    for bins in (1, 7, 32, 500):
        for r in stats.binned(df, ["g"], "v", bins).collect():
            low, span = min(groups[r.g]), max(groups[r.g]) - min(groups[r.g])
            edges = [low + i * span // bins for i in range(bins + 1)]
            assert (r.bin, r.lo, r.hi) == (k := sum(e <= r.v for e in edges[1:bins]), edges[k], edges[k + 1])
        logs = stats.binned(df, ["g"], "v", bins, log=True).collect()
        assert all((r.lo <= r.v or r.bin == 0) and (r.v < r.hi or r.bin == bins - 1) for r in logs)


def test_hot_keys_are_cut_by_their_rows(spark, monkeypatch):
    """Sums, minima and neighbours of a key in blocks equal those of a plain window, whatever the unit of time."""
    from spanforge.plans import blocks

    rnd = random.Random(7)
    rows = [("a" if rnd.random() < 0.9 else "b", rnd.randint(0, 200), i, rnd.randint(-5, 5) or None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v long")
    args = (["k"], ["t", "seq"])
    forms = {
        "sum": lambda: blocks.running_sum(df, *args, F.col("v"), "x"), "min": lambda: blocks.running_min(df, *args, "v", "x"), "last": lambda: blocks.last_before(df, *args, "v", "x"), "before": lambda: blocks.previous(df.fillna(0), *args, "v", "x"),
    }
    plain = {n: sorted(map(str, f().collect())) for n, f in forms.items()}
    assert blocks.block_width(df, ["k"], "t") is None
    monkeypatch.setattr(blocks, "HOT", 50)
    monkeypatch.setattr(blocks, "ROWS", 20)
    assert 5 <= blocks.block_width(df, ["k"], "t") <= 20
    for n, f in forms.items():
        assert sorted(map(str, f().collect())) == plain[n], n


def test_histogram_counts_add_up(spark):
    df = spark.createDataFrame([("x", v) for v in (5, 5, 5)] + [("y", v) for v in (1, 2, 3, 50, 100)], "name string, dur long")
    for log in (False, True):
        bins = stats.histogram(df, ["name"], "dur", 8, log=log)
        assert {r.name: r.n for r in bins.groupBy("name").agg(F.sum("count").alias("n")).collect()} == {"x": 3, "y": 5}


def test_interval_joins_equal_loops(spark):
    rnd = random.Random(1)
    spans = [(k, s, s + rnd.choice([0, 1, 5, 70]), i) for i, (k, s) in enumerate((rnd.randint(0, 1), rnd.randint(0, 100)) for _ in range(60))]
    points = [(k, t, i) for i, (k, t) in enumerate((rnd.randint(0, 1), rnd.randint(0, 120)) for _ in range(60))]
    a = spark.createDataFrame(spans, "k int, start long, end long, id int")
    p = spark.createDataFrame(points, "k int, t long, pid int")
    assert {(r.pid, r.id) for r in covering(p, a, ["k"]).collect()} == {(i, j) for k, t, i in points for q, s, e, j in spans if k == q and s <= t < e}
    b = spark.createDataFrame([(k, s, e, i) for k, s, e, i in spans if e > s], "k int, r_start long, r_end long, rid int")
    left = a.where("end > start")
    got = sorted((r.id, r.rid) for r in overlapping(left, b, ["k"]).collect())
    assert got == sorted((i, j) for k, s, e, i in spans if e > s for q, u, v, j in spans if v > u and k == q and s < v and u < e)


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, time long")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40)], "k string, time long, v int")
    assert {(r.k, r.time): r.v for r in as_of(left, right, ["k"], ["v"]).collect()} == {("a", 1): 10, ("a", 5): 40, ("b", 5): None}
    assert {(r.k, r.time): r.v for r in as_of(left, right, ["k"], ["v"], forward=True).collect()} == {("a", 1): 10, ("a", 5): None, ("b", 5): None}
    assert {(r.k, r.time): r.v for r in as_of(left, right, ["k"], ["v"], strict=True).collect()} == {("a", 1): None, ("a", 5): 40, ("b", 5): None}


OPS = "capture_id string, pool string, ptr long, seq long, time long, kind string, size long, thread long, callstack int"


def test_memory_frees_come_first_and_anomalies(spark):
    ops = spark.createDataFrame([("A", "p", 1, 0, 1, "alloc", 10, 1, 1), ("A", "p", 1, 1, 2, "free", None, 1, 0), ("A", "p", 2, 2, 2, "alloc", 20, 1, 1)], OPS)
    assert [(r.time, r.usage) for r in memory.usage(memory.pair(ops)).orderBy("time", "side").collect()] == [(1, 10), (2, 0), (2, 20)]
    odd = spark.createDataFrame([("A", "p", 9, 0, 1, "free", None, 1, 0), ("A", "p", 5, 1, 1, "alloc", 1, 1, 0), ("A", "p", 5, 2, 2, "alloc", 1, 1, 0), ("A", "p", 0, 3, 3, "free", None, 1, 0)], OPS)
    assert {(r.seq, r.anomaly) for r in memory.anomalies(odd).collect()} == {(0, "unknown free"), (2, "allocated twice")}


def test_arena_discard_frees_what_is_active(spark):
    ops = spark.createDataFrame([("A", "p", i, i, i, "alloc", 10, 1, 1) for i in (1, 2, 8)], OPS)
    gone = spark.createDataFrame([("A", "p", 5)], "capture_id string, pool string, time long")
    assert {r.ptr: r.time_free for r in memory.discard(memory.pair(ops), gone).collect()} == {1: 5, 2: 5, 8: None}


def test_locks(spark):
    rows = [("A", 1, i, t, th, k, 0) for i, (th, t, k) in enumerate([(1, 0, "Wait"), (1, 1, "Obtain"), (2, 2, "Wait"), (1, 5, "Release"), (2, 5, "Obtain"), (2, 6, "Release")])]
    e = spark.createDataFrame(rows, "capture_id string, lock_id int, seq long, time long, thread long, type string, srcloc int")
    w = locks.wait_stats(e).first()
    assert (w.total, w["count"], w.avg) == (4, 2, 2.0)
    i = locks.info(e).first()
    assert (i.max_waiters, i.wait_time, i.hold_time) == (1, 4, 5)


def test_frames(spark):
    f = spark.createDataFrame([("A", "F", True, i, s, None) for i, s in enumerate((0, 16, 33))], "capture_id string, frame_set string, continuous boolean, idx long, start long, end_raw long")
    ended = frames.with_ends(f, 40)
    assert [r.time for r in ended.orderBy("idx").collect()] == [16, 17, 7]
    s = frames.frame_stats(ended).first()
    assert (s["count"], s.total, s.min, s.max) == (3, 40, 7, 17)


def test_symbols_count_once_per_sample(spark):
    s = spark.createDataFrame([("A", 1, 0, 5, [7, 8, 7])], "capture_id string, thread long, seq long, time long, frames array<long>")
    assert {r.symbol: (r.incl, r.excl) for r in sampling.symbol_counts(s).collect()} == {7: (1, 1), 8: (1, 0)}


def test_ghost_zones_equal_a_fold(spark):
    rnd = random.Random(3)
    rows = [("A", 1, i, 10 * i + rnd.randint(0, 5), [rnd.randint(0, 1), 5, rnd.randint(8, 9)]) for i in range(40)]
    expected, open_, before = [], {}, []
    for k, (_, _, _, t, f) in enumerate(rows):
        path = f[::-1]
        nxt = rows[k + 1][3] if k + 1 < len(rows) else 1 << 62
        for d in range(1, 4):
            if before[:d] != path[:d] or not before:
                open_[d] = [d, t, None, path[d - 1]]
                expected.append(open_[d])
            open_[d][2] = min(t + 12, nxt)
        before = path
    s = spark.createDataFrame(rows, "capture_id string, thread long, seq long, time long, frames array<long>")
    got = sorted((r.depth, r.start, r.end, r.symbol) for r in sampling.ghost_zones(s, 12).collect())
    assert got == sorted(map(tuple, expected))


def test_gpu_wraps_and_query_reuse(spark):
    s = spark.createDataFrame([("A", 0, i, r) for i, r in enumerate((10, 250, 5, 3))], "capture_id string, ctx int, seq long, raw long")
    assert [r.ticks for r in gpu.unwrapped(s, 8).orderBy("seq").collect()] == [10, 250, 261, 515]
    t = spark.createDataFrame([("A", 0, 4, i, 10 * i) for i in range(4)], "capture_id string, ctx int, query_id int, seq long, time long")
    assert sorted((r.use, r.gpu_start, r.gpu_end) for r in gpu.pair_queries(t).collect()) == [(1, 0, 10), (2, 20, 30)]


def test_merge_names(spark):
    d = spark.createDataFrame([("p", 1, 5, "t"), ("p", 2, 5, "t"), ("p", 2, 6, "u")], "process string, pid long, thread long, name string")
    assert sorted(r.display for r in trace.merge_threads(d).collect()) == ["p/u", "p[1]/t", "p[2]/t"]


def test_source_diff(spark):
    a = spark.createDataFrame([("x", "1\n2"), ("y", "same"), ("only", "z")], "file string, content string")
    b = spark.createDataFrame([("x", "1\n3"), ("y", "same"), ("new", "z")], "file string, content string")
    rows = {r.file: r for r in findzone.source_diff(a, b).collect()}
    assert {k: r.status for k, r in rows.items()} == {"x": "changed", "only": "only this", "new": "only other"}
    assert "-2" in rows["x"].diff and "+3" in rows["x"].diff


def test_texts(spark):
    df = spark.createDataFrame([("void ns::A<int>::run(int) const", 1_500, 2_000_000)], "n string, t long, b long")
    r = df.select(P.short_name(F.col("n")).alias("n"), P.format_time(F.col("t")).alias("t"), P.format_bytes(F.col("b")).alias("b")).first()
    assert (r.n, r.t, r.b) == ("run", "1.5 μs", "1953.12 KB")
    times = {0: "0 ns", 1005: "1 μs", 1006: "1.01 μs", 1995: "2 μs", 999_995: "1000 μs", -1_500_000: "-1.5 ms", 90_500_000_000: "1:30.5", 119_960_000_000: "1:60", 5400 * 10**9: "1:30:00", 198_000 * 10**9: "2d07:00:00"}
    assert {r.t: r.shown for r in spark.createDataFrame([(t,) for t in times], "t long").withColumn("shown", P.format_time(F.col("t"))).collect()} == times
    deep = {"f<" + "a<" * 12 + "x" + ">" * 13 + "(" * 9 + ")" * 9: "f", "void a<b<c>>::g<d>(h<i(*)(j)>) const": "g", "bool X::operator<(X const&)": "operator_", "main()": "main"}
    assert {r.n: r.shown for r in spark.createDataFrame([(n,) for n in deep], "n string").withColumn("shown", P.short_name(F.col("n"))).collect()} == deep
    f = spark.createDataFrame([("alpha",), ("beta",), ("alphabet",)], "n string")
    assert [r.n for r in f.where(P.text_filter(F.col("n"), "ALPHA, -bet")).collect()] == ["alpha"]


def test_listings_are_whole_by_default(spark):
    rows = spark.range(3000).select(F.col("id").alias("alloc_id"), F.when(F.col("id") < 1500, "a").otherwise("b").alias("pool"))
    assert (memory.listing(rows).count(), memory.listing(rows, "a").count(), memory.listing(rows, "b", 9).count()) == (3000, 1500, 9)
    runs = spark.range(3000).select(F.col("id").alias("seq"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.lit(3).alias("thread"))
    assert (cpu.thread_switches(runs, 3).count(), cpu.thread_switches(runs, 3, 9).count(), cpu.thread_switches(runs, 4).count()) == (3000, 9, 0)


def test_child_statistics_take_all_parents(spark):
    n = 100_001
    pairs = spark.range(2 * n).select(
        F.lit(0).alias("capture_id"), F.col("id").alias("zone_id"), F.when(F.col("id") >= n, F.col("id") - n).alias("parent_id"), F.when(F.col("id") < n, "view").otherwise("click").alias("name"),
        F.col("id").alias("start"), (F.col("id") + 5).alias("end"), F.lit(5).cast("long").alias("dur"),
    )
    count = lambda df: {r.name: r[1] for r in df.select("name", "count").collect()}
    assert count(zone_operators.child_statistics(pairs, "view")) == {"click": n}
    assert count(zone_operators.child_statistics(pairs, "view", 10)) == {"click": 10}


def test_cpu_states(spark):
    df = spark.createDataFrame([(2,), (99,)], "c int")
    assert [r.s for r in df.select(cpu.state_name(F.col("c")).alias("s")).collect()] == ["Running", "Unknown"]
