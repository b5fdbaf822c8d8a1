"""Locks as running sums over their events; no state machine is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import running_sums


def _is(*kinds: str):
    return F.when(F.col("type").isin(*kinds), 1).otherwise(0)


def states(events: DataFrame) -> DataFrame:
    """After each event: threads that wait and that hold, in both flavours, and whether that is contention."""
    steps = {"waiting": _is("Wait") - _is("Obtain"), "holding": _is("Obtain") - _is("Release"), "waiting_shared": _is("WaitShared") - _is("ObtainShared"), "sharing": _is("ObtainShared") - _is("ReleaseShared")}
    rows = running_sums(events, ["capture_id", "lock_id"], ["time", "seq"], steps)
    contended = ((F.col("holding") != 0) & (F.col("waiting") + F.col("waiting_shared") != 0)) | ((F.col("sharing") != 0) & (F.col("waiting") != 0))
    return rows.withColumn("contended", contended)


def summary(events: DataFrame) -> DataFrame:
    return states(events).groupBy("lock_id").agg(F.max("contended").alias("contended"), F.countDistinct("thread").alias("threads"), F.count(F.lit(1)).alias("events"), F.min("time").alias("announce"), F.max("time").alias("terminate"))


def contended_only(events: DataFrame) -> DataFrame:
    return summary(events).where("contended and threads >= 2")


def wait_stats(events: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Per contended lock: each obtain paired with the thread's latest wait before it, and the lock's threads in order of
    their first event; with ``locks`` (capture_id, lock_id, name), its name."""
    w = Window.partitionBy("capture_id", "lock_id", "thread").orderBy("time", "seq")
    kinds = ("Wait", "WaitShared", "Obtain", "ObtainShared")
    rows = events.where(F.col("type").isin(*kinds)).withColumn("before", F.lag(F.struct("type", "time")).over(w))
    pairs = rows.where(F.col("type").startswith("Obtain") & F.col("before.type").startswith("Wait")).withColumn("wait", F.col("time") - F.col("before.time"))
    contended = summary(events).where("contended").select("lock_id")
    stats = pairs.join(contended, "lock_id", "left_semi").groupBy("lock_id").agg(F.sum("wait").alias("total"), (F.sum("wait") / F.count(F.lit(1))).alias("avg"), F.count(F.lit(1)).alias("count"))
    first = events.groupBy("lock_id", "thread").agg(F.min(F.struct("time", "seq")).alias("at"))
    listed = first.groupBy("lock_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "thread"))), lambda x: x["thread"]).alias("threads"))
    stats = stats.join(listed, "lock_id")
    return stats if locks is None else stats.join(locks.select("lock_id", "name"), "lock_id", "left")


def info(events: DataFrame) -> DataFrame:
    """Time in which a lock is held and in which someone waits, as unions over threads, and the most that wait at once."""
    w = Window.partitionBy("capture_id", "lock_id").orderBy("time", "seq")
    rows = states(events).withColumn("until", F.lead("time").over(w)).withColumn("span", F.col("until") - F.col("time"))
    held, wanted = F.col("holding") + F.col("sharing") != 0, F.col("waiting") + F.col("waiting_shared") != 0
    return rows.groupBy("lock_id").agg(F.coalesce(F.sum(F.when(held, F.col("span"))), F.lit(0)).alias("hold_time"), F.coalesce(F.sum(F.when(wanted, F.col("span"))), F.lit(0)).alias("wait_time"), F.max(F.col("waiting") + F.col("waiting_shared")).alias("max_waiters"), (F.max("time") - F.min("time")).alias("lifetime"))


def thread_states(events: DataFrame) -> DataFrame:
    """What a lock is to each of its threads over time: wait, has, or has while others wait (blocking)."""
    own = Window.partitionBy("capture_id", "lock_id", "thread").orderBy("time", "seq")
    rows = events.withColumn("state", F.when(F.col("type").startswith("Wait"), "wait").when(F.col("type").startswith("Obtain"), "has").otherwise("none"))
    rows = rows.withColumn("until", F.lead("time").over(own)).where("state <> 'none' and until is not null and until > time")
    return rows.select("capture_id", "lock_id", "thread", "seq", "state", F.col("time").alias("start"), F.col("until").alias("end"))
