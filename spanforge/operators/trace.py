"""Whole traces: information, threads, merging, level of detail, source search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import islands


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


def threads(zones: DataFrame, dims: DataFrame) -> DataFrame:
    used = zones.groupBy("thread").agg(F.count(F.lit(1)).alias("count"))
    return used.join(dims, "thread", "left").select("thread", "count", F.coalesce("is_fiber", F.lit(False)).alias("is_fiber"), F.coalesce("name", F.lit("???")).alias("name"))


def crash(reports: DataFrame) -> DataFrame:
    """The crash of each capture that has one (capture_id, seq, time, thread, message, callstack): a later report takes the
    place of an earlier one; callstack 0 is none."""
    last = reports.groupBy("capture_id").agg(F.max_by(F.struct("thread", "time", "message", F.coalesce("callstack", F.lit(0)).alias("callstack")), F.struct("time", "seq")).alias("c"))
    return last.select("capture_id", "c.*")


def thread_order(dims: DataFrame, first_seq: DataFrame) -> DataFrame:
    """Position by descending priority (smaller hint first), then arrival."""
    rows = dims.join(first_seq, "thread")
    return rows.orderBy("group_hint", "seq", "thread").select("thread", "group_hint", "seq")


def merged_thread(tid, pid):
    """Thread ids of several traces side by side: process above, thread below."""
    return F.shiftleft(pid.cast("long"), 32).bitwiseOR(tid.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def default_pid(pid, index: int):
    return F.when(pid == 0, F.lit(0xFFFE0000 | index).cast("long")).otherwise(pid)


def merge_threads(dims: DataFrame) -> DataFrame:
    """Threads (process, pid, thread, name) of all traces with their merged id and display name: process/name, with the
    pid where a process has that name more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy("process", "name"))
    shown = F.when(n > 1, F.concat("process", F.lit("["), F.col("pid").cast("string"), F.lit("]/"), "name")).otherwise(F.concat("process", F.lit("/"), "name"))
    return dims.withColumn("display", shown).withColumn("merged_thread", merged_thread(F.col("thread"), F.col("pid")))


def merge(traces: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of several traces one below the other; a table or column that one lacks is null there. Order by (time, seq)."""
    names = sorted({n for t in traces for n in t})
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t[n] for t in traces if n in t]) for n in names}


def folded(spans: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Timeline level of detail: neighbours shorter than ``least`` and nearer than that to the one before make one run."""
    w = Window.partitionBy(*keys).orderBy("start", "id")
    small = (F.col("end") - F.col("start")) < least
    rows = spans.withColumn("small", small).withColumn("gap", F.col("start") - F.lag("end").over(w)).withColumn("after", F.lag("small").over(w))
    joins = F.col("small") & F.coalesce(F.col("after"), F.lit(False)) & (F.col("gap") < least)
    runs = islands(rows, keys, ["start", "id"], ~F.coalesce(joins, F.lit(False)))
    return runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("items"), F.first("small").alias("folded"))


def search(files: DataFrame, pattern: str) -> DataFrame:
    """Lines (file, content) that match a regular expression, with their number."""
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    return lines.where(F.col("text").rlike(pattern)).select("file", (F.col("at") + 1).alias("line"), "text")


def annotations_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    parsed = F.from_json(column, "text string, min long, max long, color int, visible boolean")
    return rows.select(parsed.alias("a")).select("a.text", F.col("a.min").alias("start"), F.col("a.max").alias("end"), "a.color", F.coalesce("a.visible", F.lit(True)).alias("visible"))
