"""Begin and end rows to a tree of zones, by windows alone: no loop over levels, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, cut_to, drop
from .blocks import block_width, last_before, running_min, running_sum


def nest(events: DataFrame) -> DataFrame:
    """Zones of begin/end rows (capture_id, seq, time, thread, kind in begin/end, srcloc).

    A thread's rows form a stack; an end on an empty stack is passed over. Adds depth, parent_id, end, end_seq and
    re-entrancy (an open ancestor has the same source location). Where a thread has many rows, they are nested in blocks.
    """
    width = block_width(events.select("capture_id", "thread", "time"), ["capture_id", "thread"], "time")
    return _nest_threads(events) if width is None else nest_blocks(events, width)


def _nest_threads(events: DataFrame) -> DataFrame:
    by = ["capture_id", "thread"]
    order = ["time", "seq"]
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy(*by).orderBy(*order)
    step = F.when(F.col("kind") == "begin", 1).otherwise(-1)
    rows = events.where(F.col("kind").isin("begin", "end")).withColumn("d", step)
    rows = rows.withColumn("s", F.sum("d").over(so_far))
    # reflecting at zero: what the running sum lost below zero was ends without a begin
    rows = rows.withColumn("open", F.col("s") - F.least(F.lit(0), F.min("s").over(so_far)))
    rows = rows.withColumn("level", F.when(F.col("d") == 1, F.col("open")).otherwise(F.coalesce(F.lag("open").over(at), F.lit(0)))).where("level > 0")
    level = Window.partitionBy(*by, "level").orderBy(*order)
    rows = rows.withColumn("nx", F.lead(F.struct("d", "time", "seq")).over(level)).where("d = 1")
    closed = F.col("nx.d") == -1
    zones = rows.select(
        *by, F.col("seq").alias("zone_id"), "srcloc", F.col("time").alias("start"), F.when(closed, F.col("nx.time")).alias("end"), F.when(closed, F.col("nx.seq")).alias("end_seq"), (F.col("level") - 1).cast("int").alias("depth")
    )
    # parent: the last begin one level up; each begin is a row of its own level and a candidate for the level below
    own = zones.withColumn("key", F.col("depth")).withColumn("candidate", F.lit(None).cast("long"))
    below = zones.withColumn("key", F.col("depth") + 1).withColumn("candidate", F.col("zone_id"))
    up = Window.partitionBy(*by, "key").orderBy("start", "zone_id").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(below).withColumn("parent_id", F.last("candidate", ignorenulls=True).over(up)).where("candidate is null").drop("key", "candidate")
    both = both.withColumn("parent_id", F.when(F.col("depth") > 0, F.col("parent_id")))
    return _with_reentrancy(both)


def _with_reentrancy(zones: DataFrame) -> DataFrame:
    by = ["capture_id", "thread"]
    begins = zones.select("*", F.lit(1).alias("d"), F.col("start").alias("t"), F.col("zone_id").alias("q"))
    ends = zones.where("end is not null").select("*", F.lit(-1).alias("d"), F.col("end").alias("t"), F.col("end_seq").alias("q"))
    so_far = Window.partitionBy(*by, "srcloc").orderBy("t", "q").rowsBetween(Window.unboundedPreceding, 0)
    flagged = begins.unionByName(ends).withColumn("reentrant", F.sum("d").over(so_far) > 1)
    return flagged.where("d = 1").drop("d", "t", "q")


def nest_blocks(events: DataFrame, width: int) -> DataFrame:
    """``nest`` for captures in which a few threads hold most events: no task sees all rows of a thread.

    Sums and minima run within blocks of ``width`` ns and over the blocks before; the steps are written to the shared folder. At one level of a thread begins and ends
    take turns, so the k-th end there closes the k-th begin: numbers from running counts and an equi-join pair them.
    """
    by, order = ["capture_id", "thread"], ["time", "seq"]
    rows = events.where(F.col("kind").isin("begin", "end")).select(*by, *order, "srcloc", F.when(F.col("kind") == "begin", 1).otherwise(-1).alias("d"))
    rows = running_min(running_sum(rows, by, order, F.col("d"), "s", width), by, order, "s", "low", width)
    floor_before = F.least(F.lit(0), F.coalesce("low", F.lit(0)))
    # an end on an empty stack takes the sum below all before
    rows = rows.where((F.col("d") == 1) | (F.col("s") >= floor_before)).withColumn("open", F.col("s") - F.least(floor_before, F.col("s")))
    rows = cut(rows.withColumn("level", F.when(F.col("d") == 1, F.col("open")).otherwise(F.col("open") + 1)), "nest-levels")
    numbered = running_sum(rows, [*by, "level"], order, F.when(F.col("d") == 1, 1).otherwise(0), "begun", width)
    begins = numbered.where("d = 1").select(*by, "level", F.col("begun").alias("k"), F.col("seq").alias("zone_id"), "srcloc", F.col("time").alias("start"))
    ends = numbered.where("d = -1").select(*by, "level", F.col("begun").alias("k"), F.col("time").alias("end"), F.col("seq").alias("end_seq"))
    zones = begins.join(ends, [*by, "level", "k"], "left").select(*by, "zone_id", "srcloc", "start", "end", "end_seq", (F.col("level") - 1).cast("int").alias("depth"))
    zones = cut(zones, "nest-zones")
    own = zones.withColumn("key", F.col("depth")).withColumn("candidate", F.lit(None).cast("long"))
    both = own.unionByName(zones.withColumn("key", F.col("depth") + 1).withColumn("candidate", F.col("zone_id")))
    up = last_before(both, [*by, "key"], ["start", "zone_id"], "candidate", "parent_id", width).where("candidate is null").drop("key", "candidate")
    up = cut(up.withColumn("parent_id", F.when(F.col("depth") > 0, F.col("parent_id"))), "nest-parents")
    marks = up.select("*", F.lit(1).alias("d"), F.col("start").alias("t"), F.col("zone_id").alias("q")).unionByName(up.where("end is not null").select("*", F.lit(-1).alias("d"), F.col("end").alias("t"), F.col("end_seq").alias("q")))
    flagged = running_sum(marks, [*by, "srcloc"], ["t", "q"], F.col("d"), "n", width).where("d = 1")
    return flagged.withColumn("reentrant", F.col("n") > 1).drop("d", "t", "q", "n")


def with_effective_end(zones: DataFrame) -> DataFrame:
    """``end_eff``: an open zone ends with the last event below it. All that follows on its thread is below it."""
    last = F.max(F.greatest("start", F.coalesce("end", "start"))).over(Window.partitionBy("capture_id", "thread"))
    return zones.withColumn("end_eff", F.coalesce("end", last))


def with_self_time(zones: DataFrame) -> DataFrame:
    """``dur`` (inclusive) and ``self_time`` (without closed direct children) of every zone; null while open."""
    zones = zones.withColumn("dur", F.col("end") - F.col("start"))
    spent = zones.where("dur is not null and parent_id is not null").groupBy("capture_id", F.col("parent_id").alias("zone_id")).agg(F.sum(F.greatest("dur", F.lit(0))).alias("below"))
    joined = zones.join(spent, ["capture_id", "zone_id"], "left")
    return joined.withColumn("self_time", F.col("dur") - F.coalesce("below", F.lit(0))).drop("below")


def along_parents(zones: DataFrame, value: Column, join: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """capture_id, zone_id and ``name``: ``value`` of all zones from the outermost one down to the zone, put together by
    ``join`` (above, below), which must be associative.

    Pointers double: in each round a zone takes over what the zone it points to has gathered, and points where that one
    points. Rounds are the logarithm of the depth, and rows stay as many as zones.
    """
    by, paths = ["capture_id", "zone_id"], []
    rows, path = cut_to(zones.select(*by, F.col("parent_id").alias("up"), value.alias(name)), "paths")
    paths.append(path)
    while rows.where("up is not null").limit(1).count():
        above = rows.select("capture_id", F.col("zone_id").alias("up"), F.col("up").alias("_up"), F.col(name).alias("_above"))
        met = rows.where("up is not null").join(above, ["capture_id", "up"], "left").select(*by, F.col("_up").alias("up"), F.when(F.col("_above").isNull(), F.col(name)).otherwise(join(F.col("_above"), F.col(name))).alias(name))
        rows, path = cut_to(rows.where("up is null").select(*by, "up", name).unionByName(met), "paths")
        paths.append(path)
        drop(zones.sparkSession, paths.pop(0))
    return rows.drop("up")


def ancestors(zones: DataFrame) -> DataFrame:
    """(capture_id, zone_id, ancestor_id, distance): every zone with itself and each zone above it.

    An ancestor encloses the zone on its thread and has a smaller depth, so one range join finds them all; zones of one
    thread are bucketed by powers of two of time to keep the join from comparing every pair.
    """
    from .intervals import covering

    pts = zones.select("capture_id", "thread", F.col("start").alias("t"), "zone_id", "depth")
    ended = with_effective_end(zones).select("capture_id", "thread", "start", F.col("end_eff").alias("end"), F.col("zone_id").alias("ancestor_id"), F.col("depth").alias("above"))
    met = covering(pts, ended, ["capture_id", "thread"], closed=True).where("above < depth")
    # at equal times the enclosing zone began first
    met = met.where("start < t or ancestor_id < zone_id")
    chain = met.select("capture_id", "zone_id", "ancestor_id", (F.col("depth") - F.col("above")).alias("distance"))
    own = zones.select("capture_id", "zone_id", F.col("zone_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    # closed neighbours that end exactly where the zone starts are no ancestors: one per level is, the latest to begin
    pick = Window.partitionBy("capture_id", "zone_id", "distance").orderBy(F.desc("ancestor_start"), F.desc("ancestor_id"))
    starts = zones.select("capture_id", F.col("zone_id").alias("ancestor_id"), F.col("start").alias("ancestor_start"))
    chain = chain.join(starts, ["capture_id", "ancestor_id"]).withColumn("r", F.row_number().over(pick)).where("r = 1").select("capture_id", "zone_id", "ancestor_id", "distance")
    return chain.unionByName(own)
