"""Queries that pass through sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as T
from ..plans.stats import fitted, total
from ..sources import adapters as A
from ..sources import chrome, fxt, store
from ..sources.scratch import cut, shared_path
from ..streaming import ingest
from . import distribution  # noqa: F401 (its common table expressions)
from .base import CTES, query
from .sampling import gpu
from .zones import zones

T0 = 1_704_067_200_000_000_000


@query("q02_store_round_trip", "SELECT zone_id, thread, start, stop AS \"end\" FROM z", "z")
def _(spark, sf_dir):
    path = shared_path(spark, "trace")
    store.write({"zones": zones(spark, sf_dir), "messages": A.messages(spark, sf_dir)}, path)
    return store.read(spark, path, without=("messages",))["zones"].select("zone_id", "thread", "start", "end")


@query("q19_strip", "SELECT 'plot_points' AS \"table\", count(*) AS rows FROM ev", "ev")
def _(spark, sf_dir):
    path, target = shared_path(spark, "trace"), shared_path(spark, "stripped")
    store.write({"messages": A.messages(spark, sf_dir), "plot_points": A.plot_points(spark, sf_dir), "lock_events": A.lock_events(spark, sf_dir)}, path)
    store.strip(spark, path, target, "lm")
    return T.counts(store.read(spark, target))


CTES["ch"] = (("be",), f"""ch0 AS (SELECT user_id % 8 AS b, min(t) AS base FROM ev WHERE event_type IN ('view', 'click', 'purchase', 'error', 'signup') GROUP BY 1),
ch AS (SELECT thread, event_type AS name, t - base AS start, CASE WHEN nd = -1 THEN nt - base END AS stop, CAST(lvl - 1 AS INTEGER) AS depth FROM be5 JOIN ch0 ON thread % 8 = b WHERE d = 1)""")


def chrome_files(spark, sf_dir):
    """Eight Chrome traces (bucket, value): begins, ends and counters of the users with the same remainder."""
    e = A.events(spark, sf_dir)
    ts = F.expr(f"cast((time - {T0}) div 1000 as double) + ((time - {T0}) % 1000) / 1000.0D")
    ph = F.when(F.col("event_type").isin("view", "click"), "B").when(F.col("event_type").isin("purchase", "error"), "E").otherwise("C")
    arg = F.when(F.col("event_type") == "signup", F.create_map(F.lit("mem_bytes"), F.col("k").cast("string")))
    record = F.to_json(F.struct(ph.alias("ph"), ts.alias("ts"), F.when(ph == "E", F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("name"), F.lit(7).alias("pid"), F.col("user_id").alias("tid"), arg.alias("args")))
    rows = e.select((F.col("user_id") % 8).alias("bucket"), F.struct("time", "event_id", record.alias("json")).alias("r"))
    return rows.groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"]), ","), F.lit("]")).alias("value"))


def chrome_events(spark, sf_dir):
    path = shared_path(spark, "chrome")
    chrome_files(spark, sf_dir).write.partitionBy("bucket").text(path)
    return chrome.tables(chrome.read(spark, f"{path}/*/*.txt"))


@query("q04_chrome_import", 'SELECT thread, name, start, stop AS "end", depth FROM ch', "ch")
def _(spark, sf_dir):
    z = chrome_events(spark, sf_dir)["zones"]
    return z.select(F.col("thread").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("thread"), "name", "start", "end", "depth")


@query("q05_chrome_compressed", 'SELECT thread, name, start, stop AS "end", depth FROM ch', "ch")
def _(spark, sf_dir):
    import pandas as pd

    @F.pandas_udf("binary")
    def compressed(texts):
        import zstandard

        return pd.Series([zstandard.compress(t.encode()) for t in texts])

    files = cut(chrome_files(spark, sf_dir).select(F.format_string("%d.json.zst", "bucket").alias("path"), compressed("value").alias("content")), "chrome-zst")
    z = chrome.tables(chrome.parse(files))["zones"]
    return z.select(F.col("thread").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("thread"), "name", "start", "end", "depth")


def fxt_tables(spark, sf_dir):
    """Tables of the same eight traces in the binary format."""
    e = A.events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("view", "click"), "begin").when(F.col("event_type").isin("purchase", "error"), "end").otherwise("counter")

    def encoded(key, rows):
        import pandas as pd

        rows = rows.sort_values(["time", "event_id"])
        data = fxt.encode([(k, t, 7, u, "mem" if k == "counter" else n, float(v)) for k, t, u, n, v in zip(rows["kind"], rows["time"], rows["user_id"], rows["event_type"], rows["k"], strict=True)])
        return pd.DataFrame({"path": [f"{key[0]}.fxt"], "content": [data]})

    rows = e.select((F.col("user_id") % 8).alias("bucket"), kind.alias("kind"), "time", "event_id", "user_id", "event_type", "k")
    return fxt.tables(fxt.parse(cut(rows.groupBy("bucket").applyInPandas(encoded, "path string, content binary"), "fxt")))


@query("q08_fxt_import", 'SELECT thread, name, start, stop AS "end", depth FROM ch', "ch")
def _(spark, sf_dir):
    z = fxt_tables(spark, sf_dir)["zones"]
    return z.select(F.col("thread").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("thread"), "name", "start", "end", "depth")


@query("q08_fxt_counters", "SELECT 'mem' AS plot, 'Number' AS format, count(*) AS points, CAST(sum(k) AS DOUBLE) AS total, min(t - base) AS first FROM ev JOIN ch0 ON user_id % 8 = b WHERE event_type = 'signup'", "ch")
def _(spark, sf_dir):
    t = fxt_tables(spark, sf_dir)
    return t["plot_points"].join(t["plots"], ["capture_id", "plot"]).groupBy("plot", "format").agg(F.count(F.lit(1)).alias("points"), F.sum("val").alias("total"), F.min("time").alias("first"))


@query("q09_import_threads", "SELECT DISTINCT 'PID 7 TID ' || thread AS shown, thread % 8 || '.fxt' AS capture_id FROM ch", "ch")
def _(spark, sf_dir):
    return fxt_tables(spark, sf_dir)["threads"].select("shown", "capture_id")


@query("q09_import_locations", "SELECT thread % 8 || '.fxt' AS capture_id, name, count(*) AS zones FROM ch GROUP BY 1, 2", "ch")
def _(spark, sf_dir):
    t = fxt_tables(spark, sf_dir)
    used = t["zones"].groupBy("capture_id", "srcloc").agg(F.count(F.lit(1)).alias("zones"))
    return t["source_locations"].join(used, ["capture_id", "srcloc"]).select("capture_id", "name", "zones")


@query("q03_selective_load", "SELECT 'zones' AS \"table\", count(*) AS rows FROM z UNION ALL SELECT 'plot_points', count(*) FROM ev", "z")
def _(spark, sf_dir):
    path = shared_path(spark, "trace")
    store.write({"zones": A.zones(spark, sf_dir), "messages": A.messages(spark, sf_dir), "plot_points": A.plot_points(spark, sf_dir), "lock_events": A.lock_events(spark, sf_dir)}, path)
    return T.counts(store.read(spark, path, without=("messages", "locks")))


@query("q20_snapshot", "SELECT unnest(['messages', 'zones']) AS \"table\", true AS written")
def _(spark, sf_dir):
    sizes = store.snapshot({"zones": A.zones(spark, sf_dir), "messages": A.messages(spark, sf_dir)}, shared_path(spark, "snapshot"))
    return spark.createDataFrame([(t, n > 0) for t, n in sizes.items()], "table string, written boolean")


@query("q149_captures", "SELECT cap AS capture_id, unnest(['plot_points', 'zones']) AS \"table\" FROM (SELECT DISTINCT cap FROM z2)", "z2")
def _(spark, sf_dir):
    return store.captures(spark, _two_captures(spark, sf_dir))


@query("q149_views", "SELECT cap AS capture_id, name, count(*) AS zones, CAST(sum(dur) AS BIGINT) AS total FROM z2 GROUP BY cap, name", "z2")
def _(spark, sf_dir):
    store.register(store.read(spark, _two_captures(spark, sf_dir)), "trace_")
    return fitted(spark.sql('SELECT capture_id, name, count(*) AS zones, sum(CAST(`end` - start AS DECIMAL(19, 0))) AS total FROM trace_zones GROUP BY capture_id, name'), "total")


def _two_captures(spark, sf_dir):
    path = shared_path(spark, "captures")
    points = A.events(spark, sf_dir, split=True).select("capture_id", F.col("event_type").alias("plot"), "time", F.col("value").alias("val"))
    store.write({"zones": zones(spark, sf_dir, split=True), "plot_points": points}, path)
    return path


@query("q06_chrome_counters", "SELECT 'signup-mem_bytes' AS plot, 'Memory' AS format, count(*) AS points, CAST(sum(k) AS DOUBLE) AS total FROM ev WHERE event_type = 'signup'", "ev")
def _(spark, sf_dir):
    t = chrome_events(spark, sf_dir)
    return t["plot_points"].join(t["plots"], ["capture_id", "plot"]).groupBy("plot", "format").agg(F.count(F.lit(1)).alias("points"), F.sum("val").alias("total"))


@query("q07_rebased_messages", "SELECT event_id AS seq, t - (SELECT min(t) FROM ev) AS time FROM ev WHERE event_type = 'signup'", "ev")
def _(spark, sf_dir):
    least = A.events(spark, sf_dir).groupBy("capture_id").agg(F.min("time").alias("base"))
    return A.messages(spark, sf_dir).join(least, "capture_id").select("seq", (F.col("time") - F.col("base")).alias("time"))


@query("q10_streaming_zones", 'SELECT zone_id, thread, name, start, stop AS "end", depth, parent_id, reentrant, dur, self_time FROM zs WHERE stop IS NOT NULL', "zs")
def _(spark, sf_dir):
    log = shared_path(spark, "log")
    write_log(spark, sf_dir, log)
    # a file is a batch: zones stay open over batches
    zones_seen = ingest.capture(ingest.event_log(spark, log, LOG, files_per_batch=1), shared_path(spark, "zones"), shared_path(spark, "stream"))
    return zones_seen.drop("capture_id", "late")


LOG = "capture_id string, seq long, time long, thread long, kind string, name string"


def write_log(spark, sf_dir, path):
    """An event log of four files, one after the other in time."""
    rows = cut(A.trace_events(spark, sf_dir).select("capture_id", "seq", "time", "thread", "kind", "name").repartitionByRange(4, "time", "seq").withColumn("part", F.spark_partition_id()), "log-parts")
    for part in range(4):  # files are read in the order in which they came
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)


@query("q11_capture", "SELECT name, count(*) AS zones, CAST(sum(dur) AS BIGINT) AS total, CAST(0 AS BIGINT) AS late FROM z WHERE stop IS NOT NULL GROUP BY name", "z")
def _(spark, sf_dir):
    log = shared_path(spark, "log")
    write_log(spark, sf_dir, log)
    seen = ingest.capture(ingest.event_log(spark, log, LOG, files_per_batch=2), shared_path(spark, "zones"), shared_path(spark, "stream"))
    return fitted(seen.groupBy("name").agg(F.count(F.lit(1)).alias("zones"), total("dur").alias("total"), F.sum("late").alias("late")), "total")


@query("q13_export_unwrap", "SELECT name, CASE name WHEN 'click' THEN 'src/click.cpp' ELSE 'src/view.cpp' END AS src_file, CASE name WHEN 'click' THEN 10 ELSE 20 END AS src_line, start AS ns_since_start, dur AS exec_time_ns, thread, text AS value FROM z WHERE dur IS NOT NULL", "z")
def _(spark, sf_dir):
    return store.unwrap(zones(spark, sf_dir))


@query("q14_export_gpu", "SELECT name, 'gpu' AS src_file, gpu_start AS \"Time from start of program\", gpu_end - gpu_start AS \"GPU execution time\" FROM gz WHERE gpu_end IS NOT NULL", "gz")
def _(spark, sf_dir):
    return store.export_gpu(gpu(spark, sf_dir).withColumn("file", F.lit("gpu")))


@query("q15_export_messages", "SELECT props AS \"MessageName\", t AS total_ns FROM ev WHERE event_type = 'signup'", "ev")
def _(spark, sf_dir):
    return store.export_messages(A.messages(spark, sf_dir))


@query("q16_export_plots", "SELECT event_type AS name, t AS ns_since_start, round(value, 6) AS v FROM ev", "ev")
def _(spark, sf_dir):
    return store.unwrap_plots(A.plot_points(spark, sf_dir)).select("name", "ns_since_start", F.round(F.col("value").cast("double"), 6).alias("v"))


@query("q17_visible_stats", "SELECT coalesce(loc.name, function) AS name, file AS src_file, line AS src_line, CAST(sum(dur) AS BIGINT) AS total_ns, count(*) AS counts FROM z JOIN loc USING (srcloc) WHERE dur > 0 GROUP BY ALL", "z", "loc")
def _(spark, sf_dir):
    from ..operators.zones import accumulated

    return fitted(store.visible_stats(accumulated(zones(spark, sf_dir), "children")), "total_ns")


@query("q12_csv_export", "SELECT coalesce(loc.name, function) AS name, CAST(sum(dur) AS BIGINT) AS total_ns, count(*) AS counts FROM z JOIN loc USING (srcloc) WHERE dur > 0 GROUP BY ALL", "z", "loc")
def _(spark, sf_dir):
    from ..operators.zones import csv_aggregate

    path = shared_path(spark, "csv")
    store.export_csv(csv_aggregate(zones(spark, sf_dir), A.last_time(spark, sf_dir)), path, separator=";")
    read = spark.read.option("header", True).option("sep", ";").csv(path)
    return fitted(read.select("name", F.col("total_ns").cast("decimal(29,0)").alias("total_ns"), F.col("counts").cast("long").alias("counts")), "total_ns")


