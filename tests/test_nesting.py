"""Zone trees against a stack machine, and traces made by hand."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanforge.operators import zones as Z
from spanforge.plans.nesting import ancestors, nest, nest_blocks, with_effective_end, with_self_time

SCHEMA = "capture_id string, thread long, seq long, time long, kind string, srcloc int"


def stack_machine(rows):
    """zone id -> (depth, parent, end, re-entrant)"""
    out, stacks = {}, {}
    for _, thread, seq, time, kind, srcloc in sorted(rows, key=lambda r: (r[1], r[3], r[2])):
        stack = stacks.setdefault(thread, [])
        if kind == "begin":
            out[seq] = [len(stack), stack[-1][0] if stack else None, None, any(s == srcloc for _, s in stack)]
            stack.append((seq, srcloc))
        elif stack:
            out[stack.pop()[0]][2] = time
    return {k: tuple(v) for k, v in out.items()}


def trace(spark, *rows):
    """Rows as (thread, kind, srcloc, time)."""
    data = [("A", t, i, time, {"B": "begin", "E": "end"}[k], s) for i, (t, k, s, time) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def zones(spark, *rows):
    names = spark.createDataFrame([(i, f"s{i}", None, f"f{i}", i) for i in range(5)], "srcloc int, name string, function string, file string, line int")
    return Z.named(with_self_time(nest(trace(spark, *rows))), names)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from("BE"), st.integers(0, 2), st.integers(0, 3)), max_size=25))
def test_random_streams_equal_a_stack(spark, steps):
    time, rows = 0, []
    for i, (thread, kind, srcloc, gap) in enumerate(steps):
        time += gap
        rows.append(("A", thread, i, time, "begin" if kind == "B" else "end", srcloc if kind == "B" else None))
    got = {r.zone_id: (r.depth, r.parent_id, r.end, r.reentrant) for r in nest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == stack_machine(rows)
    blocks = {r.zone_id: (r.depth, r.parent_id, r.end, r.reentrant) for r in nest_blocks(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert blocks == got
    up = {}
    for r in ancestors(nest(spark.createDataFrame(rows, SCHEMA))).collect():
        up.setdefault(r.zone_id, {})[r.distance] = r.ancestor_id
    for zone, (depth, parent, _, _) in got.items():
        assert len(up[zone]) == depth + 1 and up[zone][0] == zone and (depth == 0 or up[zone][1] == parent)


def test_one_thread_with_all_events_is_cut(spark, monkeypatch):
    """A hot thread is nested in blocks by default; paths and sums along parents equal a walk."""
    import random

    from pyspark.sql import functions as F

    from spanforge.plans import blocks
    from spanforge.plans.nesting import along_parents

    rnd = random.Random(1)
    rows, time = [], 10**18
    for i in range(3000):
        time += rnd.randint(0, 3)
        rows.append(("A", 1, i, time, "begin" if rnd.random() < 0.53 else "end", rnd.randint(0, 2)))
    events = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(blocks, "HOT", 500)
    monkeypatch.setattr(blocks, "ROWS", 200)
    z = nest(events)
    assert {r.zone_id: (r.depth, r.parent_id, r.end, r.reentrant) for r in z.collect()} == stack_machine(rows)
    tree = {r.zone_id: (r.parent_id, r.srcloc, r.depth) for r in z.collect()}

    def path(zone):
        parent, loc, _ = tree[zone]
        return ([] if parent is None else path(parent)) + [str(loc)]

    got = {r.zone_id: r.path for r in along_parents(z, F.col("srcloc").cast("string"), lambda a, b: F.concat_ws("/", a, b), "path").collect()}
    assert got == {zone: "/".join(path(zone)) for zone in tree} and max(d for _, _, d in tree.values()) > 40


def test_self_time_and_parent(spark):
    rows = {r.name: r for r in zones(spark, (1, "B", 0, 0), (1, "B", 1, 2), (1, "E", 1, 5), (1, "E", 0, 10)).collect()}
    assert rows["s0"].self_time == 7 and rows["s1"].self_time == 3
    assert (rows["s1"].depth, rows["s1"].parent_id) == (1, rows["s0"].zone_id)


def test_recursion_counts_once_without_reentrancy(spark):
    z = zones(spark, *[(1, "B", 0, t) for t in (0, 1, 2)], *[(1, "E", 0, t) for t in (3, 4, 5)])
    assert [(r["count"], r.total) for r in Z.nonreentrant(z).collect()] == [(1, 5)]
    assert Z.accumulated(z, "children").first().total == 9


def test_zero_span_enters_root_stats_only(spark):
    z = zones(spark, (1, "B", 0, 0), (1, "E", 0, 0))
    assert Z.statistics(z, "name").count() == 0 and Z.root_statistics(z).first()["count"] == 1


def test_open_zone_ends_with_last_event_below(spark):
    z = nest(trace(spark, (1, "B", 0, 0), (1, "B", 1, 1), (1, "E", 1, 4)))
    assert {r.zone_id: r.end_eff for r in with_effective_end(z).collect()} == {0: 4, 1: 4}


def test_leading_end_is_passed_over(spark):
    assert [(r.start, r.end) for r in nest(trace(spark, (1, "E", 0, 0), (1, "B", 0, 1), (1, "E", 0, 2))).collect()] == [(1, 2)]


def test_self_times_sum_to_roots(spark):
    z = zones(spark, (1, "B", 0, 0), (1, "B", 1, 2), (1, "B", 2, 3), (1, "E", 2, 4), (1, "E", 1, 5), (1, "E", 0, 9), (1, "B", 1, 10), (1, "E", 1, 12))
    rows = z.collect()
    assert sum(r.self_time for r in rows) == sum(r.dur for r in rows if r.parent_id is None)


def test_running_time_is_clipped(spark):
    z = zones(spark, (1, "B", 0, 10), (1, "E", 0, 20))
    runs = spark.createDataFrame([("A", 1, 0, 12, 0), ("A", 1, 15, 40, 1)], "capture_id string, thread long, start long, end long, cpu int")
    assert [(r.running, r.regions, r.cpus) for r in Z.running(z, runs).collect()] == [(7, 2, 2)]


def test_locations_that_share_a_name_merge_by_name(spark):
    names = spark.createDataFrame([(0, "same", "f", "a", 1), (1, "same", "g", "b", 2)], "srcloc int, name string, function string, file string, line int")
    z = Z.named(with_self_time(nest(trace(spark, (1, "B", 0, 0), (1, "E", 0, 2), (1, "B", 1, 3), (1, "E", 1, 7)))), names)
    assert Z.statistics(z, "name").first().total == 6 and Z.statistics(z, "srcloc").count() == 2


def test_empty_trace(spark):
    assert nest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rule, ids", [("contained", {1}), ("start_half_open", {1, 2}), ("clamped", {0, 1, 2}), ("closed", {1, 2, 3})])
def test_range_rules(spark, rule, ids):
    from pyspark.sql import functions as F

    from spanforge.functions.predicates import RangeRule, in_range

    df = spark.createDataFrame([(0, 5, 12), (1, 11, 15), (2, 18, 25), (3, 20, 30)], "id long, s long, e long")
    assert {r.id for r in df.where(in_range(RangeRule(rule), F.col("s"), F.col("e"), 10, 20)).collect()} == ids
