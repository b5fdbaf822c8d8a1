"""Running sums over keys that hold many rows: within blocks of time, plus the sums of the blocks before.

A plain window gives one task all rows of a key. Where a few keys (pools, plots, locks, a thread, a whole capture) hold a
table, rows are windowed per (key, block) instead; only one row per key and block is windowed over the whole key. Whether
and how wide is derived from the rows: a key of more than ``HOT`` rows is cut into blocks of about ``ROWS`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows is cut; rows of a block, if they come evenly.
HOT, ROWS = 4_000_000, 1_000_000
_widths: dict[tuple, int | None] = {}


def block_width(df: DataFrame, keys: list[str], time: str, hot: int | None = None, rows: int | None = None) -> int | None:
    """Width in units of ``time`` of blocks for the largest key; None where no key needs them. One aggregation, made once for
    a plan; it decides about cost alone."""
    hot, rows = hot or HOT, rows or ROWS
    own = (id(df.sparkSession._jsparkSession), df.semanticHash(), tuple(keys), time, hot, rows)
    if own not in _widths:
        if len(_widths) > 1000:
            _widths.clear()
        t = F.col(time)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t) + 1).alias("span"))
        top = sizes.agg(F.max(F.struct("n", "span"))).first()[0]
        _widths[own] = None if top is None or top["n"] <= hot else max(1, int(top["span"] or 1) * rows // top["n"])
    return _widths[own]


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum up to the row, within the row's key; ``order`` begins with a
    time; nulls count as 0. ``width``: of blocks; None: as the rows need it."""
    width = width or block_width(df, keys, order[0])
    if width is None:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.coalesce(F.sum(v).over(so_far), F.lit(0)) for name, v in values.items()})
    rows = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())}).withColumn("_block", F.floor(F.col(order[0]) / width))
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(values))])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_base{i}") for i in range(len(values))])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"_in{i}": F.sum(f"_v{i}").over(inside) for i in range(len(values))}).join(base, [*keys, "_block"])
    named = summed.withColumns({name: F.col(f"_base{i}") + F.coalesce(f"_in{i}", F.lit(0)) for i, name in enumerate(values)})
    return named.drop("_block", *[f"{x}{i}" for x in ("_v", "_in", "_base") for i in range(len(values))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to each row of its key."""
    return running_sums(df, keys, order, {name: value}, width)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in its key (null for the first)."""
    width = width or block_width(df, keys, order[0])
    if width is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    lasts = rows.groupBy(*keys, "_block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = lasts.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    first = F.row_number().over(inside) == 1
    joined = rows.withColumn("_p", F.lag(value).over(inside)).withColumn("_first", first).join(carried, [*keys, "_block"])
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_p"))).drop("_block", "_p", "_first", "_carry")


def running_min(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``: the least ``value`` of the rows before each row of its key (null for the first)."""
    width = width or block_width(df, keys, order[0])
    if width is None:
        return df.withColumn(name, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    rows = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    least = rows.groupBy(*keys, "_block").agg(F.min(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = least.select(*keys, "_block", F.min("_m").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_in", F.min(value).over(inside)).join(carried, [*keys, "_block"])
    return joined.withColumn(name, F.least("_in", "_carry")).drop("_block", "_in", "_carry")


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that isn't null of the rows before each row of its key."""
    width = width or block_width(df, keys, order[0])
    if width is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    rows = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    lasts = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    all_blocks = rows.select(*keys, "_block").distinct().join(lasts, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inside)).join(carried, [*keys, "_block"])
    return joined.withColumn(name, F.coalesce("_in", "_carry")).drop("_block", "_in", "_carry")
