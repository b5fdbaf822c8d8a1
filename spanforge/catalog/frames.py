"""Queries on frames, plots, messages and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as R

from ..sources import adapters as A
from .base import query
from .zones import DAY, SINCE, UNTIL


def ended(spark, sf_dir):
    return R.with_ends(A.frames(spark, sf_dir), A.last_time(spark, sf_dir))


@query("q61_frame_ends", 'SELECT idx, start, stop AS "end", stop - start AS time FROM fr', "fr")
def _(spark, sf_dir):
    return ended(spark, sf_dir).select("idx", "start", "end", "time")


@query("q62_full_frames", "SELECT 'Frame' AS frame_set, count(*) - 1 AS full_frames, count(*) AS frames FROM fr", "fr")
def _(spark, sf_dir):
    return R.full_count(A.frames(spark, sf_dir))


@query("q63_frame_range", f"SELECT 'Frame' AS frame_set, min(idx) AS first_idx, max(idx) + 1 AS end_idx FROM fr WHERE start < {UNTIL} AND stop > {SINCE}", "fr")
def _(spark, sf_dir):
    return R.frame_range(ended(spark, sf_dir), SINCE, UNTIL)


@query("q64_frame_times", "SELECT 'Frame' AS frame_set, stop - start AS time FROM fr", "fr")
def _(spark, sf_dir):
    return ended(spark, sf_dir).select("frame_set", "time")


@query("q65_frame_stats", "WITH t AS (SELECT CASE WHEN stop > start THEN stop - start END AS t FROM fr) SELECT 'Frame' AS name, min(t) AS min, max(t) AS max, CAST(sum(t) AS BIGINT) AS total, CAST(sum(CAST(t AS HUGEINT) * t) AS DOUBLE) AS sum_sq, count(*) AS count, CAST(sum(t) AS DOUBLE) / count(*) AS avg FROM t", "fr")
def _(spark, sf_dir):
    return R.frame_stats(ended(spark, sf_dir))


_RANKS = ", ".join(f"list_sort(list(t))[CAST(least(count(*) - 1, floor({p}::DOUBLE * count(*))) AS BIGINT) + 1] AS {n}" for p, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.99, "p99"), (0.999, "p99_9")))


@query("q66_frame_distribution", f"WITH t AS (SELECT stop - start AS t FROM fr WHERE stop > start) SELECT 'Frame' AS frame_set, count(*) AS count, CAST(sum(t) AS DOUBLE) / count(*) AS mean, {_RANKS} FROM t", "fr")
def _(spark, sf_dir):
    return R.frame_distribution(ended(spark, sf_dir))


@query("q67_frame_overview", "SELECT 'Frame' AS frame_set, idx // 10 AS bucket, max(stop - start) AS max_time FROM fr GROUP BY idx // 10", "fr")
def _(spark, sf_dir):
    return R.overview(ended(spark, sf_dir), 10)


@query("q68_frame_labels", "SELECT idx, CASE WHEN idx = 0 THEN 'Init' ELSE 'Frame ' || CAST(idx + 5 AS VARCHAR) END AS label FROM fr", "fr")
def _(spark, sf_dir):
    return A.frames(spark, sf_dir).select("idx", R.label(F.col("idx"), 5).alias("label"))


@query("q69_frame_images", f"SELECT 'Frame' AS frame_set, idx FROM fr WHERE stop > start AND (least(stop, {UNTIL}) - greatest(start, {SINCE})) * 4 >= (stop - start) * 3", "fr")
def _(spark, sf_dir):
    return R.images_in_range(ended(spark, sf_dir), SINCE, UNTIL)


@query("q146_image_attach", "SELECT idx, CASE WHEN idx % 3 = 1 THEN CAST(idx * 10 AS INTEGER) END AS image FROM fr", "fr")
def _(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    images = f.where("idx % 3 = 1").select("capture_id", (F.col("idx") * 10).cast("int").alias("image_id"), (F.col("idx") - 1).alias("frame_ref"))
    return R.attach_images(f, images).select("idx", "image")


@query("q70_plot_stats", "SELECT event_type AS plot, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(*) AS count, round(sum(value) / count(*), 6) AS avg FROM ev GROUP BY event_type", "ev")
def _(spark, sf_dir):
    return R.plot_stats(A.plot_points(spark, sf_dir))


@query("q71_plot_lod", f"SELECT event_type AS plot, (t - {SINCE}) // {DAY // 8} AS bucket, min(value) AS min, max(value) AS max, count(*) AS count, count(*) >= 4 AS folded FROM ev WHERE t BETWEEN {SINCE} AND {UNTIL} GROUP BY 1, 2", "ev")
def _(spark, sf_dir):
    return R.plot_lod(A.plot_points(spark, sf_dir), SINCE, UNTIL, DAY // 8)


@query("q72_plot_changes", "SELECT event_id AS seq, value AS val, value - lag(value) OVER (PARTITION BY event_type ORDER BY t, event_id) AS change FROM ev", "ev")
def _(spark, sf_dir):
    return R.plot_changes(A.plot_points(spark, sf_dir)).select("seq", "val", "change")


@query("q73_power", "WITH p AS (SELECT event_type AS plot, event_id AS seq, t AS time, t - lag(t) OVER w AS dt, value - lag(value) OVER w AS de FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)) SELECT plot, seq, time, de * 1000 / dt AS watts FROM p WHERE dt > 0", "ev")
def _(spark, sf_dir):
    return R.power(A.plot_points(spark, sf_dir))


@query("q74_messages", "SELECT event_id AS seq, t AS time, props AS text, user_id AS thread FROM ev WHERE event_type = 'signup'", "ev")
def _(spark, sf_dir):
    return A.messages(spark, sf_dir).select("seq", "time", "text", "thread")


@query("q75_message_severities", "SELECT ['Trace', 'Debug', 'Info', 'Warning', 'Error', 'Fatal'][k % 6 + 1] AS severity, count(*) AS total, count(*) FILTER (user_id % 2 = 0) AS visible FROM ev WHERE event_type = 'signup' GROUP BY 1", "ev")
def _(spark, sf_dir):
    return A.messages(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("thread") % 2 == 0, 1)).alias("visible"))


_MZ = "WITH m AS (SELECT event_id, zone_id, depth, max(depth) OVER (PARTITION BY event_id) AS deepest FROM ev JOIN z ON ev.user_id = z.thread AND z.start <= t AND t <= z.stop WHERE event_type = 'signup') SELECT zone_id, count(*) AS messages FROM m {} GROUP BY zone_id"


@query("q76_zone_messages", _MZ.format(""), "z")
def _(spark, sf_dir):
    return R.messages_in_zones(A.messages(spark, sf_dir), A.zones(spark, sf_dir))


@query("q76_zone_messages_own", _MZ.format("WHERE depth = deepest"), "z")
def _(spark, sf_dir):
    return R.messages_in_zones(A.messages(spark, sf_dir), A.zones(spark, sf_dir), own=True)


_SEC = "SELECT CAST(k % 4 AS INTEGER) AS category, user_id * 100 + k AS id, min(t) FILTER (event_type = 'view') AS start, max(t) FILTER (event_type = 'error') AS stop, min(event_type) AS text FROM ev WHERE event_type IN ('view', 'error') GROUP BY 1, 2"


@query("q78_sections", f'WITH s AS ({_SEC}) SELECT category, id, start, stop AS "end", text FROM s WHERE start IS NOT NULL', "ev")
def _(spark, sf_dir):
    return R.pair_sections(A.section_events(spark, sf_dir)).select("category", "id", "start", "end", "text")


@query("q141_section_ranges", f'WITH s AS ({_SEC}) SELECT category, id, start, coalesce(stop, last_time) AS "end" FROM s, lastt WHERE start IS NOT NULL', "ev", "lastt")
def _(spark, sf_dir):
    return R.section_ranges(R.pair_sections(A.section_events(spark, sf_dir)), A.last_time(spark, sf_dir))


@query("q148_plot_configuration", "SELECT event_type AS plot, CASE WHEN event_type = 'purchase' THEN 'Memory' ELSE 'Number' END AS format, count(*) AS points FROM ev GROUP BY 1, 2", "ev")
def _(spark, sf_dir):
    pts = A.plot_points(spark, sf_dir)
    config = pts.select("plot").distinct().withColumn("format", F.when(F.col("plot") == "purchase", "Memory").otherwise("Number"))
    return pts.join(config, "plot").groupBy("plot", "format").agg(F.count(F.lit(1)).alias("points"))


