"""Frames, plots, messages and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import previous
from ..plans.intervals import covering
from ..plans.stats import histogram, nearest_rank, sum_sq


def with_ends(frames: DataFrame, last_time: int) -> DataFrame:
    """``end`` and ``time``: a continuous frame ends where the next begins, the last with the trace; a discontinuous one at
    its own end, an open one with the trace."""
    by = ["capture_id", "frame_set", "idx"]  # frames are numbered in turn: the next one is found by its number
    nxt = frames.where("continuous").select("capture_id", "frame_set", (F.col("idx") - 1).alias("idx"), F.col("start").alias("_next"))
    end = F.coalesce(F.when(F.col("continuous"), F.col("_next")).otherwise(F.col("end_raw")), F.lit(last_time))
    return frames.join(nxt, by, "left").withColumn("end", end).withColumn("time", F.col("end") - F.col("start")).select(*frames.columns, "end", "time")


def full_count(frames: DataFrame) -> DataFrame:
    """Frames that are complete: the last one of a continuous set and open discontinuous ones are not."""
    last = F.col("_last")
    ends = frames.groupBy("capture_id", "frame_set").agg(F.max("idx").alias("_last"))
    rows = frames.join(ends, ["capture_id", "frame_set"]).withColumn("full", F.when(F.col("continuous"), F.col("idx") < last).otherwise(F.col("end_raw").isNotNull()))
    return rows.groupBy("frame_set").agg(F.count(F.when(F.col("full"), 1)).alias("full_frames"), F.count(F.lit(1)).alias("frames"))


def frame_range(ended: DataFrame, since: int, until: int) -> DataFrame:
    """First and last (exclusive) index of the frames that meet [since, until)."""
    return ended.where((F.col("start") < until) & (F.col("end") > since)).groupBy("frame_set").agg(F.min("idx").alias("first_idx"), (F.max("idx") + 1).alias("end_idx"))


def frame_stats(ended: DataFrame) -> DataFrame:
    """min, max, total and squares of times above 0; the count is of all frames and divides the total."""
    t = F.when(F.col("time") > 0, F.col("time"))
    rows = ended.withColumn("t", t)
    return rows.groupBy(F.col("frame_set").alias("name")).agg(F.min("t").alias("min"), F.max("t").alias("max"), F.sum("t").alias("total"), sum_sq("t").alias("sum_sq"), F.count(F.lit(1)).alias("count"), (F.sum("t") / F.count(F.lit(1))).alias("avg"))


def frame_distribution(ended: DataFrame) -> DataFrame:
    rows = ended.where("time > 0")
    base = rows.groupBy("frame_set").agg(F.count(F.lit(1)).alias("count"), (F.sum("time") / F.count(F.lit(1))).alias("mean"))
    return base.join(nearest_rank(rows, ["frame_set"], "time"), "frame_set")


def frame_histogram(ended: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(ended.where("time > 0"), ["frame_set"], "time", bins)


def overview(ended: DataFrame, group: int) -> DataFrame:
    """Longest frame of every ``group`` frames."""
    return ended.groupBy("frame_set", F.call_function("div", F.col("idx"), F.lit(group)).alias("bucket")).agg(F.max("time").alias("max_time"))


def label(idx: Column, offset: int = 0, name: str = "Frame") -> Column:
    """Index 0 is what ran before the first frame mark."""
    return F.when(idx == 0, F.lit("Init")).otherwise(F.concat(F.lit(f"{name} "), (idx + offset).cast("string")))


def images_in_range(ended: DataFrame, since: int, until: int) -> DataFrame:
    """Frames of which at least three quarters lie in the range."""
    inside = F.least("end", F.lit(until)) - F.greatest("start", F.lit(since))
    return ended.where((F.col("time") > 0) & (inside * 4 >= F.col("time") * 3)).select("frame_set", "idx")


def attach_images(frames: DataFrame, images: DataFrame, offset: int = 0) -> DataFrame:
    """Images name the frame they were taken in, counted from 1 without the offset; of several the first stays."""
    first = images.withColumn("idx", F.col("frame_ref") - offset + 1).groupBy("capture_id", "idx").agg(F.min("image_id").alias("image"))
    return frames.join(first, ["capture_id", "idx"], "left")


def plot_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("plot").agg(F.min("val").alias("min"), F.max("val").alias("max"), F.round(F.sum("val"), 4).alias("sum"), F.count("val").alias("count"), F.round(F.sum("val") / F.count("val"), 6).alias("avg"))


def plot_lod(points: DataFrame, since: int, until: int, width: int) -> DataFrame:
    """Points in view by bucket of ``width`` ns: exact min, max and count; buckets under four points keep their points."""
    rows = points.where(F.col("time").between(since, until)).withColumn("bucket", F.call_function("div", F.col("time") - since, F.lit(width)))
    return rows.groupBy("plot", "bucket").agg(F.min("val").alias("min"), F.max("val").alias("max"), F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) >= 4).alias("folded"))


def plot_changes(points: DataFrame) -> DataFrame:
    rows = previous(points, ["capture_id", "plot"], ["time", "seq"], "val", "before")
    return rows.withColumn("change", F.col("val") - F.col("before")).drop("before")


def power(points: DataFrame) -> DataFrame:
    """Watts from an energy counter in microjoules; a series' first sample only sets the base."""
    keyed = points.withColumn("point", F.struct("time", "val"))
    rows = previous(keyed, ["capture_id", "plot"], ["time", "seq"], "point", "before")
    rows = rows.withColumn("dt", F.col("time") - F.col("before.time")).withColumn("de", F.col("val") - F.col("before.val"))
    return rows.where("dt > 0").select("plot", "seq", "time", (F.col("de") * 1000 / F.col("dt")).alias("watts"))


def messages_in_zones(messages: DataFrame, zones: DataFrame, own: bool = False) -> DataFrame:
    """Messages of a zone's thread between its start and end, both included; ``own``: only where it is the deepest."""
    spans = zones.where("end is not null").select("capture_id", "thread", "start", "end", "zone_id", "depth")
    met = covering(messages.withColumnRenamed("time", "t").select("capture_id", "thread", "t", "seq"), spans, ["capture_id", "thread"], closed=True)
    if own:
        met = met.withColumn("deepest", F.max("depth").over(Window.partitionBy("seq"))).where("depth = deepest")
    return met.groupBy("zone_id").agg(F.count(F.lit(1)).alias("messages"))


def pair_sections(events: DataFrame) -> DataFrame:
    """Enter and leave rows of an id, in whatever order they arrive."""
    enter, leave = F.when(F.col("kind") == "enter", F.col("time")), F.when(F.col("kind") == "leave", F.col("time"))
    rows = events.groupBy("capture_id", "category", "id").agg(F.min(enter).alias("start"), F.max(leave).alias("end"), F.min("text").alias("text"))
    return rows.where("start is not null")


def section_ranges(sections: DataFrame, last_time: int) -> DataFrame:
    return sections.select("category", "id", "start", F.coalesce("end", F.lit(last_time)).alias("end"))
