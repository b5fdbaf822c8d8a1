"""Aggregates that several operators share: exact sums of squares, two percentile rules, histograms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

RANKS = (0.5, 0.75, 0.9, 0.99, 0.999)


def sum_sq(x: str) -> Column:
    """Sum of squares of whole numbers, exact in 38 digits, as double."""
    v = F.col(x).cast("decimal(18,0)")
    return F.sum(v * v).cast("double")


def total(x: str | Column) -> Column:
    """Sum of whole numbers, exact beyond the range of a long: a decimal, which ``fitted`` makes a long where it is one."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)"))


def fitted(df: DataFrame, *totals: str) -> DataFrame:
    """``df``, written first, with those of its ``totals`` as long that are in the range of one in all rows; the others stay
    decimals."""
    rows = cut(df, "totals")
    beyond = rows.agg(*[F.max(F.abs(c) > (1 << 63) - 1).alias(c) for c in totals]).first()
    return rows.withColumns({c: F.col(c).cast("long") for c in totals if not beyond[c]})


def pooled(x: str = "dur") -> list[Column]:
    """min, max, total, sum_sq, count, avg: what a client needs to pool results."""
    return [F.min(x).alias("min"), F.max(x).alias("max"), total(x).alias("total"), sum_sq(x).alias("sum_sq"), F.count(x).alias("count"), (total(x).cast("double") / F.count(x)).alias("avg")]


def deviation(total: Column, squares: Column, n: Column, mean: Column) -> Column:
    """Sample standard deviation from sums; 0 for fewer than two values."""
    spread = (squares - F.lit(2.0) * total.cast("double") * mean.cast("double") + mean.cast("double") * mean.cast("double") * n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(F.lit(0.0))


def _bucket(x: str) -> Column:
    """A number that grows with a value: 1024 steps to each power of two, one for all between -1 and 1."""
    v = F.col(x).cast("double")

    def steps(a: Column) -> Column:
        power = F.floor(F.log2(a))
        return power * 1024 + F.floor((a / F.pow(F.lit(2.0), power) - 1) * 1024) + 1

    return F.when(v >= 1, steps(v)).when(v <= -1, -steps(-v)).otherwise(F.lit(0).cast("long"))


def order_statistics(df: DataFrame, keys: list[str], x: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys``, n_values and, for each of ``picks``, the element of a group's sorted values at an index that is a function of
    their number.

    Values are counted by buckets first (at most 1024 for each power of two of a group's range); only the buckets that hold
    a wanted index are sorted, so that no task sorts all the values of a group.
    """
    counts = cut(df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_k")).withColumn("_b", _bucket(x)), "counts")
    whole = Window.partitionBy(*keys)
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_k").alias("_n"))
    upto = totals.withColumn("_all", F.sum("_n").over(whole)).withColumn("_upto", F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), index(F.col("_all")).cast("long").alias("at")) for name, index in picks.items()]))
    found = upto.select(*keys, "_b", "_upto", "_n", "_all", wanted.alias("_w")).where("_w.at < _upto and _w.at >= _upto - _n")
    found = found.select(*keys, "_b", "_all", F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_upto") + F.col("_n")).alias("_rest"))
    own = [F.col(f"_f._{k}") for k in range(len(keys))]
    aliased = found.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_b").alias("_fb"), "_all", "_name", "_rest").alias("_f")
    same = reduce(lambda a, b: a & b, [F.col(f"_c.{k}").eqNullSafe(o) for k, o in zip(keys, own, strict=True)], F.col("_c._b") == F.col("_f._fb"))
    met = counts.alias("_c").join(aliased, same).select(*[F.col(f"_c.{k}") for k in keys], F.col(f"_c.{x}").alias("_x"), "_k", "_all", "_name", "_rest")
    inside = Window.partitionBy(*keys, "_name").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    hit = met.withColumn("_so_far", F.sum("_k").over(inside)).where("_so_far > _rest")
    return hit.groupBy(*keys).agg(F.first("_all").alias("n_values"), *[F.min(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in picks])


def nearest_rank(df: DataFrame, keys: list[str], x: str, ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """Element at index min(n - 1, floor(p * n)) of each group's sorted values, for each p; columns p50, p75, ..."""
    name = lambda p: "p" + f"{100 * p:g}".replace(".", "_")
    return order_statistics(df, keys, x, {name(p): (lambda n, p=p: F.least(n - 1, F.floor(F.lit(p) * n))) for p in ranks}).drop("n_values")


def interpolated(df: DataFrame, keys: list[str], x: str, p: float, name: str) -> DataFrame:
    """``keys`` and ``name``: the linearly interpolated percentile of each group; p in (0, 1)."""
    place = lambda n: (n - 1) * F.lit(p)
    ends = order_statistics(df, keys, x, {"_low": lambda n: F.floor(place(n)), "_high": lambda n: F.ceil(place(n))})
    at = place(F.col("n_values"))
    between = (F.ceil(at) - at) * F.col("_low") + (at - F.floor(at)) * F.col("_high")
    return ends.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(between).alias(name))


def binned(df: DataFrame, keys: list[str], x: str, bins: int, log: bool = False) -> DataFrame:
    """``df`` with bin, lo and hi: the place of a value among ``bins`` bins between its group's least and largest value.

    Bin i ends at tmin + (i + 1) * range div bins (``log``: the whole part of ten to evenly spaced exponents); a value on
    an edge belongs to the next bin; the last bin takes the rest. A bin is found by division, and its edges put it right.
    """
    ends = df.groupBy(*keys).agg(F.min(x).alias("_tmin"), F.max(x).alias("_tmax"))
    joined = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    v, tmin, span = F.col(x), F.col("_tmin"), F.col("_tmax") - F.col("_tmin")
    if log:
        low, high = F.log10(F.col("_tmin").cast("double")), F.log10(F.col("_tmax").cast("double"))
        step = (high - low) / bins
        edge = lambda i: F.pow(F.lit(10.0), low + i * step).cast("long")
        guess = F.when(step > 0, F.ceil((F.log10(v.cast("double") + 1) - low) / step) - 1).otherwise(bins - 1)
    else:
        edge = lambda i: tmin + F.call_function("div", i * span, F.lit(bins))
        guess = F.when(span > 0, F.ceil((v - tmin + 1).cast("double") * bins / span) - 1).otherwise(bins - 1)
    near = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess)).cast("long")
    rows = joined.withColumn("_g", near)
    g = F.col("_g")
    put = g + F.when((g < bins - 1) & (edge(g + 1) <= v), 1).when((g > 0) & (edge(g) > v), -1).otherwise(0)
    rows = rows.withColumn("bin", put.cast("int"))
    at = F.col("bin").cast("long")
    return rows.withColumns({"lo": F.when(at == 0, tmin).otherwise(edge(at)), "hi": edge(at + 1)}).drop("_tmin", "_tmax", "_g")


def histogram(df: DataFrame, keys: list[str], x: str, bins: int, log: bool = False) -> DataFrame:
    """(keys, bin, lo, hi, count, time): values by bins as of ``binned``. Bins without values are left out."""
    rows = binned(df.select(*keys, x), keys, x, bins, log)
    return rows.groupBy(*keys, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"), F.sum(x).alias("time"))


def summarised(df: DataFrame, keys: list[str], x: str, bins: int, shown: int = 32, log: bool = False) -> DataFrame:
    """A histogram of ``bins`` bins put together to ``shown`` ones, for a reader with little room: keys, bin, start, end,
    count, time of all of them, empty ones too."""
    few = histogram(df, keys, x, bins, log).withColumn("bin", F.call_function("div", F.col("bin").cast("long") * shown, F.lit(bins)).cast("int"))
    sums = few.groupBy(*keys, "bin").agg(F.sum("count").alias("count"), F.sum("time").alias("time"))
    ends = df.groupBy(*keys).agg(F.min(x).alias("_tmin"), F.max(x).alias("_tmax"))
    all_bins = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(shown - 1))).alias("bin"))
    if log:
        low, high = F.log10(F.col("_tmin").cast("double")), F.log10(F.col("_tmax").cast("double"))
        edge = lambda i: F.pow(F.lit(10.0), low + i / shown * (high - low)).cast("long")
    else:
        edge = lambda i: (F.col("_tmin") + i / shown * (F.col("_tmax") - F.col("_tmin"))).cast("long")
    place = F.col("bin").cast("double")
    joined = all_bins.join(sums, [*keys, "bin"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(*keys, "bin", edge(place).alias("start"), edge(place + 1).alias("end"), F.coalesce("count", zero).alias("count"), F.coalesce("time", zero).alias("time"))


def prefixes(df: DataFrame, path: str) -> DataFrame:
    """A row for every non-empty prefix of the array ``path``, as ``prefix`` with its length ``depth``: one pass makes all
    the levels of a tree."""
    heads = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(F.col(path), F.lit(1), i))
    return df.where(F.size(path) > 0).select("*", F.explode(heads).alias("prefix")).withColumn("depth", F.size("prefix"))
