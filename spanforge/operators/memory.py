"""Allocations: pairing, pools, usage over time, call trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import running_sum
from ..plans.intervals import as_of, covering
from ..plans.stats import prefixes


def pair(ops: DataFrame) -> DataFrame:
    """Allocations with the free that follows them at the same address of the pool."""
    w = Window.partitionBy("capture_id", "pool", "ptr").orderBy("time", "seq")
    nxt = F.lead(F.struct("kind", "time", "thread", "callstack")).over(w)
    rows = ops.withColumn("n", F.when(nxt["kind"] == "free", nxt)).where("kind = 'alloc'")
    return rows.select(
        "capture_id", "pool", F.col("seq").alias("alloc_id"), "ptr", "size", F.col("time").alias("time_alloc"), F.col("n.time").alias("time_free"), F.col("thread").alias("thread_alloc"), F.col("n.thread").alias("thread_free"), F.col("callstack").alias("cs_alloc"), F.col("n.callstack").alias("cs_free")
    )


def anomalies(ops: DataFrame, ignore_null: bool = True) -> DataFrame:
    """Allocations at an address in use and frees of unknown ones; where these would stop a capture, they are listed."""
    w = Window.partitionBy("capture_id", "pool", "ptr").orderBy("time", "seq")
    before = F.lag("kind").over(w)
    rows = ops.withColumn("before", before)
    wrong = F.when((F.col("kind") == "alloc") & (F.col("before") == "alloc"), "allocated twice").when((F.col("kind") == "free") & ((F.col("before") != "alloc") | F.col("before").isNull()), "unknown free")
    rows = rows.withColumn("anomaly", wrong).where("anomaly is not null")
    return rows.where("kind <> 'free' or ptr <> 0") if ignore_null else rows


def discard(events: DataFrame, discards: DataFrame) -> DataFrame:
    """A pool's discards (capture_id, pool, time) free what is active then."""
    rows = as_of(events.withColumn("time", F.col("time_alloc")), discards.withColumn("at", F.col("time")), ["capture_id", "pool"], ["at"], forward=True)
    freed = F.least(F.col("time_free"), F.col("at"))
    return rows.withColumn("time_free", freed).drop("time", "at")


def pools(events: DataFrame) -> DataFrame:
    active = F.col("time_free").isNull()
    return events.groupBy("pool").agg(F.min("ptr").alias("low"), F.max(F.col("ptr") + F.col("size")).alias("high"), F.coalesce(F.sum(F.when(active, F.col("size"))), F.lit(0)).alias("usage"), F.count(F.lit(1)).alias("alloc_count"), F.count(F.when(active, 1)).alias("active_count"))


def usage(events: DataFrame) -> DataFrame:
    """Bytes in use after each allocation and free of a pool; frees come first at equal times."""
    up = events.select("capture_id", "pool", F.col("time_alloc").alias("time"), F.lit(1).alias("side"), F.col("alloc_id").alias("seq"), F.col("size").alias("d"))
    down = events.where("time_free is not null").select("capture_id", "pool", F.col("time_free").alias("time"), F.lit(0).alias("side"), F.col("alloc_id").alias("seq"), (-F.col("size")).alias("d"))
    both = up.unionByName(down)
    return running_sum(both, ["capture_id", "pool"], ["time", "side", "seq"], F.col("d"), "usage").select("pool", "time", "side", "seq", "usage")


def listing(events: DataFrame, pool: str | None = None, max_count: int | None = None) -> DataFrame:
    """Allocations in order, all or up to ``max_count``: of one pool, or of all."""
    rows = (events if pool is None else events.where(F.col("pool") == pool)).orderBy("alloc_id")
    return rows if max_count is None else rows.limit(max_count)


def active_in(events: DataFrame, since: int, until: int) -> DataFrame:
    """Allocated in [since, until) and not freed before its end."""
    return events.where((F.col("time_alloc") >= since) & (F.col("time_alloc") < until) & (F.col("time_free").isNull() | (F.col("time_free") >= until)))


def at_address(events: DataFrame, address: int) -> DataFrame:
    return events.where((F.col("ptr") <= address) & (F.col("ptr") + F.col("size") > address))


def per_zone(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Allocations and frees of a zone's thread while it lasts, and the change of bytes in use."""
    spans = zones.where("end > start").select("capture_id", "thread", "start", "end", "zone_id")
    up = events.select("capture_id", F.col("thread_alloc").alias("thread"), F.col("time_alloc").alias("t"), F.col("size").alias("d"))
    down = events.where("time_free is not null").select("capture_id", F.col("thread_free").alias("thread"), F.col("time_free").alias("t"), (-F.col("size")).alias("d"))
    met = covering(up.unionByName(down), spans, ["capture_id", "thread"])
    return met.groupBy("zone_id").agg(F.count(F.when(F.col("d") > 0, 1)).alias("allocs"), F.count(F.when(F.col("d") < 0, 1)).alias("frees"), F.sum("d").alias("change"))


def page_map(events: DataFrame, chunk: int, now: int) -> DataFrame:
    """Per pool and chunk of addresses the state that was written last: how recent, negative if it is free."""
    age = lambda t: F.greatest(F.lit(1), F.lit(127) - F.shiftright(F.lit(now) - t, 24)).cast("int")
    rows = events.withColumn("at", F.coalesce("time_free", "time_alloc")).withColumn("v", F.when(F.col("time_free").isNull(), age(F.col("time_alloc"))).otherwise(-age(F.col("time_free"))))
    chunks = F.sequence(F.call_function("div", F.col("ptr"), F.lit(chunk)), F.call_function("div", F.col("ptr") + F.col("size") - 1, F.lit(chunk)))
    return rows.select("pool", F.explode(chunks).alias("chunk"), "at", "alloc_id", "v").groupBy("pool", "chunk").agg(F.max_by("v", F.struct("at", "alloc_id")).alias("value"))


def zone_of_alloc(events: DataFrame, zones: DataFrame) -> DataFrame:
    """The deepest closed zone of the thread at each allocation."""
    spans = zones.where("end > start").select("capture_id", "thread", "start", "end", "zone_id", "depth")
    points = events.select("capture_id", F.col("thread_alloc").alias("thread"), F.col("time_alloc").alias("t"), "alloc_id")
    return covering(points, spans, ["capture_id", "thread"]).groupBy("alloc_id").agg(F.max_by("zone_id", "depth").alias("zone_id"))


def by_callstack(events: DataFrame, which: str = "full") -> DataFrame:
    """Count and bytes by call stack of the allocation (0: none); which of full, active, inactive."""
    rows = {"full": events, "active": events.where("time_free is null"), "inactive": events.where("time_free is not null")}[which]
    return rows.where("cs_alloc <> 0").groupBy(F.col("cs_alloc").alias("callstack")).agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("bytes"))


def call_tree(weights: DataFrame, stacks: DataFrame, bottom_up: bool, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the prefixes of call stacks (frames innermost first). Bottom-up starts at the outermost
    frame, top-down at the innermost, as the views of this kind are named."""
    frames = F.reverse("frames") if bottom_up else F.col("frames")
    rows = prefixes(weights.join(stacks, "callstack").withColumn("path", frames), "path")
    return rows.groupBy("prefix").agg(*[F.sum(v).alias(v) for v in values]).select(F.array_join(F.transform("prefix", lambda x: x.cast("string")), "/").alias("path"), *values)
