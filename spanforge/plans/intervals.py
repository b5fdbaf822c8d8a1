"""Joins on time: interval, point-in-interval and as-of joins without comparing every pair of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _class_of(length: Column) -> Column:
    """Power of two (exponent) that is at least a length: intervals of one class meet at most two buckets of that size."""
    return F.ceil(F.log2(F.greatest(length.cast("double"), F.lit(1.0)))).cast("int")


def covering(points: DataFrame, spans: DataFrame, keys: list[str], closed: bool = False, point: str = "t") -> DataFrame:
    """Pairs of points (keys, ``t``, ...) and spans (keys, start, end, ...) with start <= t < end (``closed``: <= end).

    Spans fall into classes by length, a power of two; a span lies in the bucket(s) of its class that it touches, two at
    most, whatever its length. A point looks into one bucket of each class that its key has, found by an equi-join.
    """
    spans = spans.withColumn("_c", _class_of(F.col("end") - F.col("start") + 1))
    bucket = lambda t, c: F.call_function("shiftright", t.cast("long"), c)  # noqa: E731 (a whole number below, as of negative times too)
    spread = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("start"), F.col("_c")), bucket(F.col("end"), F.col("_c")))))
    classes = spans.groupBy(*keys).agg(F.collect_set("_c").alias("_cs"))  # at most 63 to a key
    probes = points.join(classes, keys).withColumn("_c", F.explode("_cs")).drop("_cs")
    probes = probes.withColumn("_b", bucket(F.col(point), F.col("_c")))
    t = F.col(point)
    inside = (F.col("start") <= t) & ((t <= F.col("end")) if closed else (t < F.col("end")))
    return probes.join(spread, [*keys, "_c", "_b"]).where(inside).drop("_c", "_b")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans that share time: left (keys, start, end, ...), right (keys, r_start, r_end, ...).

    Two spans overlap if one starts inside the other, so two point joins find each pair once.
    """
    left, right = cut(left, "spans"), cut(right, "spans")  # each is read twice
    l_cols, r_cols = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    starts_left = covering(right.withColumn("t", F.col("r_start")), left, keys).select(*keys, *l_cols, *r_cols)
    inner = right.withColumnRenamed("r_start", "_s").withColumnRenamed("r_end", "_e")
    as_span = inner.select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), *[c for c in r_cols if c not in ("r_start", "r_end")])
    outer = left.withColumnRenamed("start", "l_start").withColumnRenamed("end", "l_end").withColumn("t", F.col("l_start"))
    met = covering(outer, as_span, keys).where("start < t")  # equal starts are found above
    renamed = met.withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end").withColumnRenamed("l_start", "start").withColumnRenamed("l_end", "end")
    return starts_left.unionByName(renamed.select(*keys, *l_cols, *r_cols))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], time: str = "time", forward: bool = False, strict: bool = False) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before its time (``forward``: the first at
    or after it; ``strict``: not at it), over one window instead of a join."""
    packed = F.struct(*values)
    rank = 0 if (not strict) != forward else 2
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType))
    b = right.select(*keys, F.col(time), packed.alias("_v")).withColumn("_side", F.lit(rank))
    both = a.unionByName(b, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(1, Window.unboundedFollowing)
        found = F.first("_v", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, -1)
        found = F.last("_v", ignorenulls=True).over(w)
    rows = both.withColumn("_f", found).where("_side = 1")
    return rows.select(*left.columns, *[F.col(f"_f.{v}").alias(v) for v in values])


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a run begins where ``new`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(w))
