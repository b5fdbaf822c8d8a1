"""Distribution and grouping of one zone's durations; comparison of two traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.intervals import covering
from ..plans.stats import RANKS, binned, nearest_rank, sum_sq, total

GROUPS = ("thread", "text", "name", "callstack", "parent", "none")


def sorted_durations(zones: DataFrame, x: str = "dur") -> DataFrame:
    """Durations in ascending order (a global sort by ranges), ties by zone."""
    return zones.where(F.col(x) > 0).orderBy(x, "zone_id").select("zone_id", F.col(x).alias("value"))


def distribution(zones: DataFrame, keys: list[str], x: str = "dur") -> DataFrame:
    """count, total, mean, deviation and nearest-rank percentiles of each group."""
    rows = zones.where(F.col(x) > 0)
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), total(x).alias("total"), sum_sq(x).alias("sq"))
    n, t = F.col("count"), F.col("total").cast("double")
    base = base.withColumn("mean", t / n)
    spread = (F.col("sq") - F.lit(2.0) * t * F.col("mean") + F.col("mean") * F.col("mean") * n) / (n - 1)
    base = base.withColumn("sigma", F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)).drop("sq")
    return base.join(nearest_rank(rows, keys, x, RANKS), keys)


def mode(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Midpoint of the fullest bin, the first of equals."""
    best = bins.groupBy(*keys).agg(F.max(F.struct("count", (-F.col("bin")).alias("first"), "lo", "hi")).alias("b"))
    return best.select(*keys, F.call_function("div", F.col("b.lo") + F.col("b.hi"), F.lit(2)).alias("mode"))


def trimmed(bins: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Bins from the first to the last that hold at least ``least`` values."""
    ends = bins.where(F.col("count") >= least).groupBy(*keys).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    return bins.join(ends, keys).where(F.col("bin").between(F.col("low"), F.col("high"))).drop("low", "high")


def group_key(by: str) -> Column:
    if by == "parent":
        return F.coalesce(F.col("parent_id"), F.lit(0)).cast("string")
    return F.lit("") if by == "none" else F.col(by).cast("string")


def grouped(zones: DataFrame, by: str) -> DataFrame:
    """Groups of a zone's occurrences: count, total, mean, median and start of the first."""
    rows = zones.where("dur > 0").withColumn("key", group_key(by))
    base = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), total("dur").alias("total"), (total("dur").cast("double") / F.count(F.lit(1))).alias("mean"), F.min("start").alias("first"))
    middle = nearest_rank(rows.withColumn("key", F.coalesce("key", F.lit("\0"))), ["key"], "dur", (0.5,)).withColumnRenamed("p50", "median")
    return base.join(middle.withColumn("key", F.when(F.col("key") != "\0", F.col("key"))).withColumnRenamed("key", "own"), F.col("key").eqNullSafe(F.col("own"))).drop("own")


def sort_groups(groups: DataFrame, key: str) -> DataFrame:
    by = {"order": [F.col("first")], "count": [F.desc("count")], "time": [F.desc("total")], "mean": [F.desc("mean")]}[key]
    return groups.orderBy(*by, "first", "key")


def sampled_symbols(zones: DataFrame, samples: DataFrame, stacks: DataFrame) -> DataFrame:
    """Samples inside any of the zones, by symbol of the innermost frame; a sample counts once however many zones hold it."""
    spans = zones.where("end > start").select("capture_id", "thread", "start", "end")
    points = samples.withColumnRenamed("time", "t").select("capture_id", "thread", "t", "seq")
    inside = covering(points, spans, ["capture_id", "thread"]).select("capture_id", "seq").distinct()
    return stacks.join(inside, ["capture_id", "seq"], "left_semi").groupBy(F.col("frames")[0].alias("symbol")).agg(F.count(F.lit(1)).alias("count"))


def match_zones(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Source locations of two traces, matched on name and, if wanted, file and line; what has no partner is kept."""
    a = one.select(*keys).distinct().withColumn("in_this", F.lit(True))
    b = other.select(*keys).distinct().withColumn("in_other", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("in_this", F.lit(False)).alias("in_this"), F.coalesce("in_other", F.lit(False)).alias("in_other"))


def side_by_side(zones: DataFrame, this: str, other: str) -> DataFrame:
    """Statistics of each name in both captures, with the factor and difference of the means."""
    stats = distribution(zones, ["capture_id", "name"])
    cols = ["count", "total", "mean", "sigma", "p50", "p75", "p90", "p99", "p99_9"]
    a = stats.where(F.col("capture_id") == this).select("name", *[F.col(c).alias(f"this_{c}") for c in cols])
    b = stats.where(F.col("capture_id") == other).select("name", *[F.col(c).alias(f"other_{c}") for c in cols])
    both = a.join(b, "name")
    return both.withColumn("factor", F.col("this_mean") / F.col("other_mean")).withColumn("difference", F.col("this_mean") - F.col("other_mean")).withColumn("verdict", F.when(F.col("factor") < 1, "less").otherwise("more"))


def common_histogram(zones: DataFrame, bins: int, normalised: bool = False) -> DataFrame:
    """Counts of both captures over the same bins; ``normalised``: as shares of the capture."""
    rows = zones.where("dur > 0")
    placed = binned(rows.select("capture_id", "name", "dur"), ["name"], "dur", bins)
    counts = placed.groupBy("name", "bin", "lo").agg(F.count(F.when(F.col("capture_id") == "A", 1)).alias("a"), F.count(F.when(F.col("capture_id") == "B", 1)).alias("b"))
    if not normalised:
        return counts
    sizes = rows.groupBy("name").agg(F.count(F.when(F.col("capture_id") == "A", 1)).alias("na"), F.count(F.when(F.col("capture_id") == "B", 1)).alias("nb"))
    return counts.join(sizes, "name").select("name", "bin", "lo", (F.col("a") / F.col("na")).alias("a"), (F.col("b") / F.col("nb")).alias("b"))


def source_diff(one: DataFrame, other: DataFrame) -> DataFrame:
    """Files (file, content) of one trace only, and unified diffs of those that changed."""
    import pandas as pd

    @F.pandas_udf("string")
    def unified(a, b):
        from difflib import unified_diff

        return pd.Series(["\n".join(unified_diff(x.split("\n"), y.split("\n"), "this", "other", lineterm="")) for x, y in zip(a, b, strict=True)])

    a, b = one.select("file", F.col("content").alias("mine")), other.select("file", F.col("content").alias("theirs"))
    both = a.join(b, "file", "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))
    status = F.when(F.col("theirs").isNull(), "only this").when(F.col("mine").isNull(), "only other").otherwise("changed")
    diff = unified(F.coalesce("mine", F.lit("")), F.coalesce("theirs", F.lit("")))
    return both.select("file", status.alias("status"), F.when(status == "changed", diff).alias("diff"))
