"""Scheduling: run intervals of CPUs and threads, usage over time, wait stacks, fibers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import running_sum
from ..plans.intervals import as_of

#: Names of thread states by code.
STATES = ("Initialized", "Ready", "Running", "Standby", "Terminated", "Waiting", "Transition", "DeferredReady")
FIBER = 99  # reason of switches that fibers make


def intervals(switches: DataFrame, wakeups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Switch events (cpu, seq, time, old_thread, new_thread, reason, state) to intervals by CPU and by thread.

    A CPU runs a thread until its next switch; a thread's interval carries why it ended and, with ``wakeups`` (thread,
    time, cpu), the last wake-up before it."""
    w = Window.partitionBy("capture_id", "cpu").orderBy("time", "seq")
    nxt = F.lead(F.struct("time", "reason", "state")).over(w)
    runs = switches.withColumn("n", nxt).where("new_thread <> 0").select("capture_id", "cpu", "seq", F.col("new_thread").alias("thread"), F.col("time").alias("start"), F.col("n.time").alias("end"), F.col("n.reason").alias("reason"), F.col("n.state").alias("state"))
    by_thread = runs
    if wakeups is not None:
        rows = as_of(runs.withColumn("time", F.col("start")), wakeups.select("capture_id", "thread", "time", F.col("time").alias("wakeup"), F.col("cpu").alias("wakeup_cpu")), ["capture_id", "thread"], ["wakeup", "wakeup_cpu"])
        by_thread = rows.drop("time")
    return runs.select("capture_id", "cpu", "seq", "start", "end", "thread"), by_thread


def thread_switches(switches: DataFrame, thread: int, max_count: int | None = None) -> DataFrame:
    """Ended runs of one thread in order of start, all or up to ``max_count``."""
    rows = switches.where((F.col("thread") == thread) & F.col("end").isNotNull()).orderBy("start", "seq")
    return rows if max_count is None else rows.limit(max_count)


def thread_data(switches: DataFrame) -> DataFrame:
    """Running time, regions and migrations (a CPU other than before) of each thread."""
    w = Window.partitionBy("capture_id", "thread").orderBy("start", "seq")
    rows = switches.withColumn("before", F.lag("cpu").over(w))
    return rows.groupBy("thread").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("running_time"), F.count(F.lit(1)).alias("regions"), F.count(F.when(F.col("cpu") != F.col("before"), 1)).alias("migrations"))


def process_rollup(threads: DataFrame, tid_pid: DataFrame) -> DataFrame:
    """Per process: sums over its threads and its share of all."""
    rows = threads.join(tid_pid, "thread", "left").groupBy(F.coalesce("pid", F.lit(0)).alias("pid")).agg(*[F.sum(c).alias(c) for c in ("running_time", "regions", "migrations")])
    whole = rows.agg(*[F.sum(c).alias(f"all_{c}") for c in ("running_time", "regions", "migrations")])
    both = rows.crossJoin(F.broadcast(whole))  # one row
    return both.select("pid", "running_time", "regions", "migrations", *[(F.col(c) * 100.0 / F.col(f"all_{c}")).alias(f"{c}_share") for c in ("running_time", "regions", "migrations")])


def usage(switches: DataFrame, own: Column) -> DataFrame:
    """How many CPUs run own and other threads, after each time at which that changes.

    Changes are summed per time first; the running sums then go over blocks of time, so no task sees all of a capture."""
    mine = F.when(own, 1).otherwise(0)
    closed = switches.where("end is not null")
    edges = closed.select("capture_id", F.col("start").alias("time"), mine.alias("o"), (1 - mine).alias("x")).unionByName(closed.select("capture_id", F.col("end").alias("time"), (-mine).alias("o"), (mine - 1).alias("x")))
    steps = edges.groupBy("capture_id", "time").agg(F.sum("o").alias("o"), F.sum("x").alias("x")).where("o <> 0 or x <> 0")
    both = running_sum(steps, ["capture_id"], ["time"], F.col("o"), "own")
    return running_sum(both, ["capture_id"], ["time"], F.col("x"), "other").select("capture_id", "time", "own", "other")


def usage_at(levels: DataFrame, times: DataFrame) -> DataFrame:
    """The level at each of ``times`` (capture_id, time)."""
    return as_of(times, levels, ["capture_id"], ["own", "other"])


def migrations(switches: DataFrame) -> DataFrame:
    """From which CPU to which a thread moves next, and how often."""
    w = Window.partitionBy("capture_id", "thread").orderBy("start", "seq")
    rows = switches.withColumn("to_cpu", F.lead("cpu").over(w)).where("to_cpu is not null and to_cpu <> cpu")
    return rows.groupBy(F.col("cpu").alias("from_cpu"), "to_cpu").agg(F.count(F.lit(1)).alias("moves"))


def wait_stacks(samples: DataFrame, since: int, until: int, threads: list[int] | None = None) -> DataFrame:
    rows = samples.where((F.col("time") >= since) & (F.col("time") < until))
    if threads is not None:
        rows = rows.where(F.col("thread").isin(threads))
    return rows.groupBy("callstack").agg(F.count(F.lit(1)).alias("count"))


def state_name(code: Column) -> Column:
    names = F.array(*[F.lit(s) for s in STATES])
    return F.when((code >= 0) & (code < len(STATES)), F.element_at(names, (code + 1).cast("int"))).otherwise("Unknown")


def fibers(events: DataFrame) -> DataFrame:
    """Enter and leave rows to spans of fibers, as virtual threads: a fiber leaves when its thread leaves or enters another."""
    w = Window.partitionBy("capture_id", "thread").orderBy("time", "seq")
    rows = events.withColumn("until", F.lead("time").over(w)).where("kind = 'enter'")
    virtual = F.shiftleft(F.lit(1).cast("long"), 32).bitwiseOR(F.col("fiber"))
    return rows.select("capture_id", virtual.alias("thread"), F.col("thread").alias("carrier"), "seq", F.col("time").alias("start"), F.col("until").alias("end"), F.lit(FIBER).alias("reason"))


def first_pid(tid_pid: DataFrame) -> DataFrame:
    """The first mapping of a thread wins (seq gives the order)."""
    return tid_pid.groupBy("tid").agg(F.min_by("pid", "seq").alias("pid"))
