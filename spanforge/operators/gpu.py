"""GPU timestamps, zone pairing and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import as_of
from ..plans.stats import pooled


def unwrapped(stamps: DataFrame, bits: int) -> DataFrame:
    """Raw timestamps (capture_id, ctx, seq, raw) of a counter of ``bits`` bits that wraps around: each fall adds 2**bits."""
    w = Window.partitionBy("capture_id", "ctx").orderBy("seq")
    fell = F.when(F.col("raw") < F.lag("raw").over(w), 1).otherwise(0)
    wraps = F.sum("fell").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stamps.withColumn("fell", fell).withColumn("ticks", F.col("raw") + wraps * (1 << bits)).drop("fell")


def to_ns(stamps: DataFrame, contexts: DataFrame, calibrations: DataFrame | None = None) -> DataFrame:
    """Ticks to ns of the trace: period and offset of the context, or of the last calibration (capture_id, ctx, seq,
    at_ticks, at_ns, factor) before."""
    rows = stamps.join(contexts.select("capture_id", "ctx", "period", "time_diff"), ["capture_id", "ctx"])
    plain = F.round(F.col("ticks") * F.col("period")).cast("long") + F.col("time_diff")
    if calibrations is None:
        return rows.withColumn("time", plain)
    rows = as_of(rows, calibrations, ["capture_id", "ctx"], ["at_ticks", "at_ns", "factor"], time="seq")
    calibrated = F.col("at_ns") + F.round((F.col("ticks") - F.col("at_ticks")) * F.col("period") * F.col("factor")).cast("long")
    return rows.withColumn("time", F.coalesce(calibrated, plain)).drop("at_ticks", "at_ns", "factor")


def pair_queries(stamps: DataFrame) -> DataFrame:
    """Times of a query id, start and end in turn; an id that is used again starts a new zone."""
    w = Window.partitionBy("capture_id", "ctx", "query_id").orderBy("seq")
    rows = stamps.withColumn("n", F.row_number().over(w)).withColumn("gpu_end", F.lead("time").over(w)).where("n % 2 = 1")
    return rows.select("capture_id", "ctx", "query_id", "seq", F.call_function("div", F.col("n") + 1, F.lit(2)).alias("use"), F.col("time").alias("gpu_start"), "gpu_end")


def listing(zones: DataFrame, name: str, max_samples: int | None = None) -> DataFrame:
    """Ended GPU zones called ``name`` in order of start, all or up to ``max_samples``."""
    rows = zones.where((F.col("name") == name) & F.col("gpu_end").isNotNull()).orderBy("gpu_start", "gpu_zone_id")
    rows = rows if max_samples is None else rows.limit(max_samples)
    return rows.select(F.col("gpu_start").alias("start"), F.col("gpu_end").alias("end"), (F.col("gpu_end") - F.col("gpu_start")).alias("dur"))


def drift_corrected(zones: DataFrame, drift: int) -> DataFrame:
    """``drift`` ns a second from the context's first time on, in whole numbers."""
    begin = F.min("gpu_start").over(Window.partitionBy("capture_id", "ctx"))
    fix = lambda t: F.col(t) + F.call_function("div", F.col(t) - F.col("begin"), F.lit(1_000_000_000)) * drift
    return zones.withColumn("begin", begin).select("gpu_zone_id", fix("gpu_start").alias("start"), fix("gpu_end").alias("end"))


def statistics(zones: DataFrame) -> DataFrame:
    rows = zones.withColumn("dur", F.col("gpu_end") - F.col("gpu_start")).where("dur > 0")
    return rows.groupBy("name").agg(*pooled())


def child_statistics(zones: DataFrame, name: str) -> DataFrame:
    rows = zones.withColumn("dur", F.col("gpu_end") - F.col("gpu_start")).where("dur is not null")
    parents = rows.where(F.col("name") == name).select("capture_id", F.col("gpu_zone_id").alias("parent_id"))
    return rows.join(parents, ["capture_id", "parent_id"], "left_semi").groupBy("name").agg(*pooled())


def contexts(zones: DataFrame) -> DataFrame:
    return zones.groupBy("ctx").agg(F.count(F.lit(1)).alias("zones"), F.countDistinct("thread").alias("threads"), F.min("gpu_start").alias("first"))


def open_end(zones: DataFrame, last_time: int) -> DataFrame:
    """An open GPU zone lasts to the end of the trace."""
    return zones.withColumn("end_eff", F.coalesce("gpu_end", F.lit(last_time)))
