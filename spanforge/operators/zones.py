"""Zone statistics. All functions take zones (``spanforge.schema``), with ``dur`` and ``self_time`` where they say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import RangeRule, in_range, zone_name
from ..plans.intervals import covering, overlapping
from ..plans.nesting import along_parents
from ..plans.stats import deviation, interpolated, pooled, sum_sq, total



def named(zones: DataFrame, locations: DataFrame) -> DataFrame:
    """``zones`` with name, file and line of their source location, and ``zone_name``: the name that the zone was given while
    it ran (``name_override``), if any, before that of its location. Statistics of locations go by ``name``, what shows
    single zones by ``zone_name``. Source locations are a dimension; adaptive execution broadcasts a small one."""
    override = F.col("_z.name_override") if "name_override" in zones.columns else F.lit(None).cast("string")
    name, shown = F.coalesce("_l.name", "_l.function").alias("name"), zone_name(override, F.col("_l.name"), F.col("_l.function")).alias("zone_name")
    return zones.alias("_z").join(locations.alias("_l"), "srcloc").select("_z.*", name, shown, F.col("_l.file"), F.col("_l.line"))


def counted(zones: DataFrame) -> DataFrame:
    """Zones that enter statistics: closed, longer than nothing."""
    return zones.where("dur > 0")


def csv_aggregate(zones: DataFrame, last_time: int, own: bool = False) -> DataFrame:
    """Per source location: total, share of the whole trace, count, integer mean, min, max, standard deviation.

    ``own``: of self times, squares included."""
    x = "self_time" if own else "dur"
    rows = counted(zones).groupBy("srcloc", "name", "file", "line").agg(
        total(x).alias("total_ns"), F.count(F.lit(1)).alias("counts"), F.min(x).alias("min_ns"), F.max(x).alias("max_ns"), sum_sq(x).alias("sq")
    )
    mean = F.call_function("div", F.col("total_ns"), F.col("counts"))
    rows = rows.withColumn("mean_ns", mean).withColumn("total_perc", F.col("total_ns") * F.lit(100.0) / F.lit(last_time))
    rows = rows.withColumn("std_ns", deviation(F.col("total_ns"), F.col("sq"), F.col("counts"), F.col("mean_ns")))
    return rows.select("name", F.col("file").alias("src_file"), F.col("line").alias("src_line"), "total_ns", "total_perc", "counts", "mean_ns", "min_ns", "max_ns", "std_ns")


def truncated(zones: DataFrame, percentile: float = 90, own: bool = False) -> DataFrame:
    """Interpolated percentile per source location and the integer mean of what isn't above it."""
    x = "self_time" if own else "dur"
    p = min(max(percentile, 1), 99) / 100
    rows = counted(zones)
    ends = interpolated(rows, ["srcloc"], x, p, "limit")
    kept = rows.join(ends, "srcloc").where(F.col(x) <= F.col("limit"))
    out = kept.groupBy("srcloc", "name").agg(F.first("limit").alias("limit"), F.call_function("div", total(x), F.count(F.lit(1))).alias("truncated_mean_ns"))
    return out.select("srcloc", "name", F.round("limit").cast("long").alias("percentile_ns"), "truncated_mean_ns")


def statistics(zones: DataFrame, *by: str) -> DataFrame:
    return counted(zones).groupBy(*by).agg(*pooled())


def root_statistics(zones: DataFrame) -> DataFrame:
    """Closed zones without a parent, those of no length too."""
    return zones.where("parent_id is null and dur is not null").groupBy("name").agg(*pooled())


def child_statistics(zones: DataFrame, name: str, max_parents: int | None = None) -> DataFrame:
    """Direct closed children of the closed zones called ``name``; ``max_parents``: of the first so many by start."""
    parents = zones.where((F.col("name") == name) & F.col("end").isNotNull())
    if max_parents is not None:
        parents = parents.orderBy("start", "zone_id").limit(max_parents)
    own = parents.select("capture_id", F.col("zone_id").alias("parent_id"))
    return zones.where("dur is not null").join(own, ["capture_id", "parent_id"], "left_semi").groupBy("name").agg(*pooled())


def zones_in_frames(zones: DataFrame, frames: DataFrame) -> DataFrame:
    """Per frame and name: closed zones that start in the frame, with their full length; below closed parents only."""
    # whatever begins on a thread after a zone that never closes lies below it
    stuck = zones.where("end is null").groupBy("capture_id", "thread").agg(F.min(F.struct("start", "zone_id")).alias("stuck"))
    joined = zones.where("dur is not null").join(stuck, ["capture_id", "thread"], "left")
    closed = joined.where(F.col("stuck").isNull() | (F.struct("start", "zone_id") < F.col("stuck")))
    spans = frames.select("capture_id", "idx", "start", "end")
    points = closed.select("capture_id", F.col("start").alias("t"), "dur", "name")
    return covering(points, spans, ["capture_id"]).groupBy("idx", "name").agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("total"))


def listing(zones: DataFrame, name: str, columns: list[str], max_samples: int | None = None) -> DataFrame:
    """Rows of the closed zones called ``name`` in order of start, all or up to ``max_samples``."""
    rows = zones.where((F.col("name") == name) & F.col("dur").isNotNull()).orderBy("start", "zone_id")
    return (rows if max_samples is None else rows.limit(max_samples)).select(*columns)


def locations_by_name(locations: DataFrame) -> DataFrame:
    """The first source location of each name."""
    rows = locations.withColumn("name", F.coalesce("name", "function"))
    return rows.groupBy("name").agg(F.min(F.struct("srcloc", "function", "file", "line")).alias("l")).select("name", "l.*")


def accumulated(zones: DataFrame, mode: str, rule: tuple[int, int] | None = None) -> DataFrame:
    """Statistics view: threads, count and total per source location; mode self, children or nonreentrant."""
    rows = counted(zones)
    if rule:
        rows = rows.where(in_range(RangeRule.CONTAINED, F.col("start"), F.col("end"), *rule))
    if mode == "nonreentrant":
        rows = rows.where(~F.col("reentrant"))
    spent = total("self_time" if mode == "self" else "dur")
    return rows.groupBy("srcloc", "name", "file", "line").agg(F.countDistinct("thread").alias("threads"), F.count(F.lit(1)).alias("count"), spent.alias("total"))


def ordered(stats: DataFrame, key: str = "total", descending: bool = True) -> DataFrame:
    keys: dict[str, list[Column]] = {"name": [F.col("name")], "location": [F.col("file"), F.col("line")], "total": [F.col("total")], "count": [F.col("count")], "mean": [F.col("total").cast("double") / F.col("count")], "threads": [F.col("threads")]}
    return stats.orderBy(*[c.desc() if descending else c.asc() for c in keys[key]], "srcloc")


def nonreentrant(zones: DataFrame) -> DataFrame:
    rows = counted(zones).where(~F.col("reentrant"))
    return rows.groupBy("srcloc").agg(F.count(F.lit(1)).alias("count"), F.min("dur").alias("min"), F.max("dur").alias("max"), F.sum("dur").alias("total"))


def thread_counts(zones: DataFrame) -> DataFrame:
    return counted(zones).groupBy("srcloc", "thread").agg(F.count(F.lit(1)).alias("count"))


def descendants(zones: DataFrame, zone_name: str, exclusive: bool = False) -> DataFrame:
    """Time and count of all zones below the zones called ``zone_name``, by name; ``exclusive``: without their children."""
    # a zone counts once for each of them that it lies below
    top = F.when((F.col("name") == zone_name) & F.col("end").isNotNull(), 1).otherwise(0).cast("long")
    held = along_parents(zones, top, lambda above, below: above + below, "_tops")
    rows = zones.where("dur is not null").join(held, ["capture_id", "zone_id"]).withColumn("_tops", F.col("_tops") - top).where("_tops > 0")
    return rows.groupBy("name").agg(F.sum(F.col("self_time" if exclusive else "dur").cast("decimal(19,0)") * F.col("_tops").cast("decimal(10,0)")).alias("time"), F.sum("_tops").alias("count"))


def children(zones: DataFrame) -> DataFrame:
    """Direct closed children of each closed zone, grouped by name, with their share of the parent."""
    parent = zones.where("dur > 0").select("capture_id", F.col("zone_id").alias("parent_id"), F.col("dur").alias("parent_dur"))
    rows = zones.where("dur is not null").join(parent, ["capture_id", "parent_id"])
    return rows.groupBy("parent_id", "name").agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("time"), (F.sum("dur") * 100.0 / F.first("parent_dur")).alias("share"))


def share_of_mean(zones: DataFrame) -> DataFrame:
    rows = counted(zones)
    whole = rows.groupBy("srcloc").agg(total("dur").cast("double").alias("_total"), F.count(F.lit(1)).alias("_n"))
    return rows.join(whole, "srcloc").select("zone_id", "name", "dur", (F.col("dur") / F.col("_total") * F.col("_n") * 100.0).alias("share"))


def running(zones: DataFrame, switches: DataFrame) -> DataFrame:
    """On-CPU time of closed zones: run intervals of the thread clipped to the zone, their number and the CPUs."""
    spans = zones.where("dur > 0").select("capture_id", "thread", "zone_id", "start", "end")
    runs = switches.where("end is not null and end > start").select("capture_id", "thread", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "cpu")
    met = overlapping(spans, runs, ["capture_id", "thread"])
    clip = F.least("end", "r_end") - F.greatest("start", "r_start")
    return met.groupBy("zone_id").agg(F.sum(clip).alias("running"), F.count(F.lit(1)).alias("regions"), F.countDistinct("cpu").alias("cpus"))


def zone_at(zones: DataFrame, points: DataFrame) -> DataFrame:
    """The deepest closed zone around each point (capture_id, thread, t, point_id)."""
    spans = zones.where("end > start").select("capture_id", "thread", "start", "end", "zone_id", "depth")
    return covering(points, spans, ["capture_id", "thread"]).groupBy("point_id").agg(F.max_by("zone_id", "depth").alias("zone_id"), F.max("depth").alias("depth"))


def self_time_in(zones: DataFrame, since: int, until: int) -> DataFrame:
    """Self time inside a range: the zone's and its children's overlaps with it."""
    clip = F.greatest(F.least("end", F.lit(until)) - F.greatest("start", F.lit(since)), F.lit(0))
    rows = zones.where("dur is not null").withColumn("inside", clip)
    below = rows.where("parent_id is not null").groupBy("capture_id", F.col("parent_id").alias("zone_id")).agg(F.sum("inside").alias("below"))
    return rows.join(below, ["capture_id", "zone_id"], "left").where("inside > 0").select("zone_id", "inside", (F.col("inside") - F.coalesce("below", F.lit(0))).alias("self_inside"))


def parent_chain(zones: DataFrame) -> DataFrame:
    """Names from the outermost zone down to the zone itself."""
    return along_parents(zones, F.col("zone_name" if "zone_name" in zones.columns else "name"), lambda above, below: F.concat_ws("/", above, below), "path").select("zone_id", "path")


def attached(events: DataFrame) -> DataFrame:
    """Texts, value notes and colours that events attach to a zone: texts and values (as number and hexadecimal) are joined
    by line ends in order; the last colour wins, as red, green, blue from lowest byte to highest."""
    value = F.format_string("%d [0x%x]", F.col("value"), F.col("value"))
    rows = events.withColumn("part", F.coalesce("text", F.when(F.col("value").isNotNull(), value)))
    parts = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("time", "seq", "part"))))
    color = (F.shiftleft("b", 16)).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("r"))
    return rows.groupBy("zone_id").agg(F.array_join(F.transform(parts, lambda s: s["part"]), "\n").alias("text"), F.max_by(color, F.struct("time", "seq")).alias("color"))
