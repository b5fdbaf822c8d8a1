"""Trace tables from the tables of a star schema: an event stream becomes zones, frames, plots, memory, locks, ...

All take (spark, sf_dir) and give tables in the schema of ``spanforge.schema``. The order of events is (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.nesting import nest

SEVERITIES = ("Trace", "Debug", "Info", "Warning", "Error", "Fatal")
COUNTERS = ("cycles", "retired", "cache_ref", "cache_miss", "branch_ret", "branch_miss")
CAPTURE = "A"


def events(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """event_id, time, user_id, event_type, value, props, k and capture_id (``split``: by parity of event_id)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    capture = F.when(F.col("event_id") % 2 == 0, "A").otherwise("B") if split else F.lit(CAPTURE)
    return rows.select(
        capture.alias("capture_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time"), "user_id", "event_type", "value", "props", F.get_json_object("props", "$.k").cast("long").alias("k")
    )


def trace_events(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """Views and clicks open a zone named after the type; purchases and errors close the innermost one."""
    e = events(spark, sf_dir, split)
    begins = F.col("event_type").isin("view", "click")
    srcloc = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2)
    return e.where(begins | F.col("event_type").isin("purchase", "error")).select(
        "capture_id", F.col("event_id").alias("seq"), "time", F.col("user_id").alias("thread"), F.when(begins, "begin").otherwise("end").alias("kind"), F.col("event_type").alias("name"), srcloc.alias("srcloc"), "props", "k"
    )


def source_locations(spark: SparkSession) -> DataFrame:
    rows = [(1, None, "click", "src/click.cpp", 10), (2, "view", "render_view", "src/view.cpp", 20), (3, "idle", "idle", "src/idle.cpp", 30)]
    return spark.createDataFrame(rows, "srcloc int, name string, function string, file string, line int")


def zones(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """Nested zones with text (props) and a call stack number (k)."""
    e = trace_events(spark, sf_dir, split)
    extra = e.where("kind = 'begin'").select("capture_id", F.col("seq").alias("zone_id"), F.col("props").alias("text"), (F.col("k") % 10).cast("int").alias("callstack"))
    return nest(e).join(extra, ["capture_id", "zone_id"])


def last_time(spark: SparkSession, sf_dir: str) -> int:
    return events(spark, sf_dir).agg(F.max("time")).first()[0] or 0


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'signup'")
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("k") % 6 + 1).cast("int"))
    return e.select("capture_id", F.col("event_id").alias("seq"), "time", F.col("user_id").alias("thread"), F.col("props").alias("text"), F.lit(0).alias("color"), F.lit(None).cast("int").alias("callstack"), F.lit("User").alias("source"), severity.alias("severity"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'signup'")
    idx = F.row_number().over(Window.partitionBy("capture_id").orderBy("time", "event_id")) - 1
    return e.select("capture_id", F.lit("Frame").alias("frame_set"), F.lit(True).alias("continuous"), idx.cast("long").alias("idx"), F.col("time").alias("start"), F.lit(None).cast("long").alias("end_raw"), F.lit(None).cast("int").alias("image_id"))


def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("capture_id", F.col("event_type").alias("plot"), F.col("event_id").alias("seq"), "time", F.col("value").alias("val"))


def mem_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a (pool, address) alternate between allocation and free."""
    e = events(spark, sf_dir).withColumn("pool", F.concat(F.lit("pool"), F.col("user_id") % 4)).withColumn("ptr", F.col("user_id") * 1000 + F.col("k"))
    rn = F.row_number().over(Window.partitionBy("capture_id", "pool", "ptr").orderBy("time", "event_id"))
    return e.withColumn("rn", rn).select(
        "capture_id", "pool", "ptr", F.col("event_id").alias("seq"), "time", F.when(F.col("rn") % 2 == 1, "alloc").otherwise("free").alias("kind"), (F.floor(F.col("value") * 100) + 1).alias("size"), F.col("user_id").alias("thread"), (F.col("k") % 10).cast("int").alias("callstack")
    )


def lock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("lock_id", (F.col("k") % 8).cast("int"))
    rn = F.row_number().over(Window.partitionBy("capture_id", "lock_id", "user_id").orderBy("time", "event_id"))
    kind = F.element_at(F.array(F.lit("Wait"), F.lit("Obtain"), F.lit("Release")), ((rn - 1) % 3 + 1).cast("int"))
    return e.select("capture_id", "lock_id", F.col("event_id").alias("seq"), "time", F.col("user_id").alias("thread"), kind.alias("type"), F.lit(1).alias("srcloc"))


def cpu_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("cpu", (F.col("event_id") % 8).cast("int"))
    end = F.lead("time").over(Window.partitionBy("capture_id", "cpu").orderBy("time", "event_id"))
    return e.select("capture_id", "cpu", F.col("event_id").alias("seq"), F.col("time").alias("start"), end.alias("end"), F.col("user_id").alias("thread"))


def context_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpu_switches(spark, sf_dir).select("capture_id", "thread", "seq", "start", "end", "cpu", (F.col("seq") % 40).cast("int").alias("reason"), (F.col("seq") % 12).cast("int").alias("state"))


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per event with its frames, innermost first."""
    e = events(spark, sf_dir)
    frames_of = F.array(F.col("k"), F.lit(1000) + F.floor(F.col("k") / 10), F.lit(2000).cast("long") + F.length("event_type"))
    return e.select("capture_id", F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), "time", frames_of.alias("frames"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    addr = stacks(spark, sf_dir).select("capture_id", F.explode("frames").alias("sym_addr")).distinct()
    return addr.select(
        "capture_id", "sym_addr", F.concat(F.lit("sym"), "sym_addr").alias("name"), F.concat(F.lit("src/f"), F.col("sym_addr") % 7, F.lit(".cpp")).alias("file"), (F.col("sym_addr") % 100).cast("int").alias("line"), F.concat(F.lit("img"), F.floor(F.col("sym_addr") / 1000)).alias("image"), F.lit(1).alias("size")
    )


def hw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(c) for c in COUNTERS]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("capture_id", F.col("k").alias("ip"), kind.alias("kind"), "time")


def section_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views enter and errors leave the section user_id * 100 + k."""
    e = events(spark, sf_dir).where("event_type in ('view', 'error')")
    return e.select("capture_id", (F.col("k") % 4).cast("int").alias("category"), (F.col("user_id") * 100 + F.col("k")).alias("id"), F.when(F.col("event_type") == "view", "enter").otherwise("leave").alias("kind"), "time", F.col("event_type").alias("text"))


def fiber_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread enters fiber k % 5 with a view and leaves with an error."""
    e = events(spark, sf_dir).where("event_type in ('view', 'error')")
    return e.select("capture_id", F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), "time", F.when(F.col("event_type") == "view", "enter").otherwise("leave").alias("kind"), (F.col("k") % 5).alias("fiber"))


def gpu_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each zone also runs on a GPU context, later by a delay that follows from its number."""
    z = zones(spark, sf_dir)
    late = F.col("zone_id") % 1000 * 10
    return z.select(
        "capture_id", F.col("zone_id").alias("gpu_zone_id"), (F.col("thread") % 4).cast("int").alias("ctx"), "thread", "srcloc", F.col("start").alias("cpu_start"), F.col("end").alias("cpu_end"), (F.col("start") + 500 + late).alias("gpu_start"), (F.col("end") + 700 + late).alias("gpu_end"), "depth", "parent_id"
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat spans without nesting: line items by supplier, named by return flag."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000
    return li.select(F.lit(CAPTURE).alias("capture_id"), F.col("l_suppkey").alias("thread"), F.col("l_returnflag").alias("name"), start.alias("start"), F.col("l_quantity").cast("long").alias("dur"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads are customers that have events; their market segment is the process."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.lit(CAPTURE).alias("capture_id"), F.col("c_custkey").alias("thread"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("is_fiber"), F.col("c_nationkey").alias("group_hint"), (F.col("c_nationkey") + 100).cast("long").alias("pid"), F.col("c_mktsegment").alias("program"))
