"""Call stacks, samples, symbols, hardware counters, flame graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import covering
from ..plans.nesting import along_parents
from ..plans.stats import prefixes, total


def intern(samples: DataFrame) -> DataFrame:
    """Distinct frame arrays with a stable number, the hash of the array; arrays are told apart by their frames."""
    return samples.select("capture_id", F.xxhash64("frames").alias("callstack"), "frames").dropDuplicates(["capture_id", "frames"])


def without_switch_samples(samples: DataFrame, switches: DataFrame) -> DataFrame:
    """Samples taken at the start of a run interval of their thread belong to the switch, not to the statistics."""
    starts = switches.select("capture_id", "thread", F.col("start").alias("time"))
    return samples.join(starts, ["capture_id", "thread", "time"], "left_anti")


def symbol_counts(samples: DataFrame) -> DataFrame:
    """Inclusive (once per sample) and exclusive (innermost frame) counts of each symbol."""
    frames = samples.select("seq", F.posexplode(F.array_distinct("frames")).alias("at", "symbol"))
    return frames.groupBy("symbol").agg(F.count(F.lit(1)).alias("incl"), F.count(F.when(F.col("at") == 0, 1)).alias("excl"))


def entry_stacks(samples: DataFrame) -> DataFrame:
    """What called each executing symbol, as stacks with counts."""
    rest = F.slice("frames", 2, F.greatest(F.size("frames") - 1, F.lit(0)))
    return samples.groupBy(F.col("frames")[0].alias("symbol"), rest.alias("parents")).agg(F.count(F.lit(1)).alias("count"))


def symbol_stats(samples: DataFrame, symbols: DataFrame) -> DataFrame:
    return symbol_counts(samples).join(symbols.withColumnRenamed("sym_addr", "symbol"), "symbol").select("symbol", "incl", "excl", "name", "file", "line", "image")


def samples_of(samples: DataFrame, symbol: int) -> DataFrame:
    return samples.where(F.col("frames")[0] == symbol).select("time", "thread")


def merged(stats: DataFrame, base: Column) -> DataFrame:
    """Inlined symbols counted for the function that they are part of."""
    return stats.groupBy(base.alias("base")).agg(F.sum("incl").alias("incl"), F.sum("excl").alias("excl"))


def symbol_at(addresses: DataFrame, symbols: DataFrame) -> DataFrame:
    """Addresses (t) to the symbols whose code [sym_addr, sym_addr + size) holds them."""
    spans = symbols.select("capture_id", F.col("sym_addr").alias("start"), (F.col("sym_addr") + F.col("size")).alias("end"), "name")
    return covering(addresses, spans, ["capture_id"])


def top_symbols(stats: DataFrame, pattern: str, limit: int) -> DataFrame:
    return stats.where(F.col("name").rlike(pattern)).orderBy(F.desc("excl"), "symbol").limit(limit)


def parents_of(samples: DataFrame, symbol: int, limit: int) -> DataFrame:
    """The most frequent parent stacks of a symbol and their share of its samples."""
    rows = entry_stacks(samples.where(F.col("frames")[0] == symbol))
    whole = rows.agg(F.sum("count").alias("all"))
    shared = rows.crossJoin(F.broadcast(whole)).withColumn("share", F.col("count") * 100.0 / F.col("all"))  # one row
    path = F.array_join(F.transform("parents", lambda x: x.cast("string")), "/")
    return shared.select(path.alias("parents"), "count", "share").orderBy(F.desc("count"), "parents").limit(limit)


def flattened(stacks: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of a call stack with those inlined into them, in order."""
    at = stacks.select("callstack", F.posexplode("frames").alias("pos", "frame_id"))
    return at.join(frames, "frame_id").select("callstack", "pos", "inline_idx", "name", "file", "line", "sym_addr")


def stack_text(stacks: DataFrame, frames: DataFrame) -> DataFrame:
    """A call stack as lines: physical frames are numbered, inlined ones are not."""
    rows = flattened(stacks, frames)
    last = F.max("inline_idx").over(Window.partitionBy("callstack", "pos"))
    line = F.when(F.col("inline_idx") == last, F.format_string("%d. %s (%s:%d)", "pos", "name", "file", "line")).otherwise(F.format_string("inline. %s (%s:%d)", "name", "file", "line"))
    lines = F.array_sort(F.collect_list(F.struct("pos", "inline_idx", "shown")))
    return rows.withColumn("shown", line).groupBy("callstack").agg(F.array_join(F.transform(lines, lambda x: x["shown"]), "\n").alias("text"))


def callees(samples: DataFrame) -> DataFrame:
    """Pairs of a frame and the one it called."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("frames") - 1), lambda i: F.struct(F.element_at("frames", (i + 1).cast("int")).alias("caller"), F.element_at("frames", i.cast("int")).alias("callee")))
    return samples.where(F.size("frames") > 1).select(F.explode(pairs).alias("p")).groupBy("p.caller", "p.callee").agg(F.count(F.lit(1)).alias("count"))


def ip_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.col("frames")[0].alias("ip")).agg(F.count(F.lit(1)).alias("count"))


def line_counts(samples: DataFrame, symbols: DataFrame) -> DataFrame:
    return ip_counts(samples).join(symbols.withColumnRenamed("sym_addr", "ip"), "ip").groupBy("file", "line").agg(F.sum("count").alias("count"))


def ghost_zones(samples: DataFrame, period: int) -> DataFrame:
    """Zones from samples: a level goes on while its prefix (outermost first) is that of the thread's sample before."""
    w = Window.partitionBy("capture_id", "thread").orderBy("time", "seq")
    rows = samples.withColumn("path", F.reverse("frames")).withColumn("before", F.lag("path").over(w)).withColumn("next", F.lead("time").over(w))
    levels = prefixes(rows, "path")
    fresh = ~F.coalesce(F.slice("before", 1, F.col("depth")) == F.col("prefix"), F.lit(False))
    so_far = Window.partitionBy("capture_id", "thread", "depth").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = levels.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(so_far))
    end = F.least(F.col("time") + period, F.coalesce("next", F.lit((1 << 63) - 1)))
    return runs.groupBy("thread", "depth", "run").agg(F.min("time").alias("start"), F.max_by(end, F.struct("time", "seq")).alias("end"), F.element_at(F.first("prefix"), -1).alias("symbol")).select("thread", "depth", "start", "end", "symbol")


def counters(hw: DataFrame) -> DataFrame:
    """Counter hits per address and what follows from them; values are numbers of samples, not of events."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    kinds = ("cycles", "retired", "cache_ref", "cache_miss", "branch_ret", "branch_miss")
    rows = hw.groupBy("ip").agg(*[n(k) for k in kinds])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    cost = lambda miss, whole: F.sqrt((F.col(miss) * F.col(whole)).cast("double"))
    return rows.select("ip", *kinds, ratio("retired", "cycles").alias("ipc"), ratio("cache_miss", "cache_ref").alias("cache_miss_rate"), ratio("branch_miss", "branch_ret").alias("branch_miss_rate"), cost("cache_miss", "cache_ref").alias("cache_cost"), cost("branch_miss", "branch_ret").alias("branch_cost"))


def flame_of_samples(samples: DataFrame, period: int) -> DataFrame:
    """Time (samples by period) of every path from the outermost frame; address 0 is left out."""
    rows = prefixes(samples.withColumn("path", F.filter(F.reverse("frames"), lambda x: x != 0)), "path")
    return rows.groupBy("prefix").agg((F.count(F.lit(1)) * period).alias("time")).select(F.array_join(F.transform("prefix", lambda x: x.cast("string")), "/").alias("path"), "time")


def zone_paths(zones: DataFrame) -> DataFrame:
    """Each zone with the names from the outermost zone down to it."""
    return along_parents(zones, F.col("name"), lambda above, below: F.concat_ws("/", above, below), "path")


def flame_of_zones(zones: DataFrame, since: int | None = None, until: int | None = None, running: DataFrame | None = None) -> DataFrame:
    """Time of closed zones by path of names, clipped to a range if one is given; ``running``: on-CPU time instead."""
    rows = zones.where("dur is not null").join(zone_paths(zones), ["capture_id", "zone_id"])
    if running is not None:
        rows = rows.join(running.select("zone_id", F.col("running").alias("t")), "zone_id")
    elif since is not None:
        rows = rows.withColumn("t", F.greatest(F.least("end", F.lit(until)) - F.greatest("start", F.lit(since)), F.lit(0))).where("t > 0")
    else:
        rows = rows.withColumn("t", F.col("dur"))
    return rows.groupBy("path").agg(total("t").alias("time"), F.count(F.lit(1)).alias("count"))
