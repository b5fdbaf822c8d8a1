"""Queries on distributions, groups and the comparison of traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findzone as Z
from ..plans.nesting import with_self_time
from ..plans.stats import fitted, histogram, summarised
from ..operators.zones import named, running
from ..sources import adapters as A
from .base import CTES, query
from .zones import SINCE, UNTIL, zones

BINS = 32
_P = (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99), ("p99_9", 0.999))


def ranks(x="dur"):
    return ", ".join(f"list_sort(list({x}))[CAST(least(count(*) - 1, floor({p}::DOUBLE * count(*))) AS BIGINT) + 1] AS {n}" for n, p in _P)


def dist(x="dur"):
    t, n = f"CAST(sum({x}) AS DOUBLE)", "count(*)"
    sq = f"CAST(sum(CAST({x} AS HUGEINT) * {x}) AS DOUBLE)"
    return f"{n} AS count, CAST(sum({x}) AS BIGINT) AS total, {t} / {n} AS mean, CASE WHEN {n} > 1 THEN sqrt(greatest(({sq} - 2.0::DOUBLE * {t} * ({t} / {n}) + ({t} / {n}) * ({t} / {n}) * {n}) / ({n} - 1), 0.0)) ELSE 0.0 END AS sigma, {ranks(x)}"


CTES["hist"] = (("z",), f"""he AS (SELECT name, min(dur) AS tmin, max(dur) AS tmax FROM z WHERE dur > 0 GROUP BY name),
hb AS (SELECT name, tmin, i, tmin + (i + 1) * (tmax - tmin) // {BINS} AS hi, CASE WHEN i = 0 THEN tmin ELSE tmin + i * (tmax - tmin) // {BINS} END AS lo FROM he, (SELECT unnest(range({BINS})) AS i)),
hist AS (SELECT z.name, hb.i AS bin, lo, hi, count(*) AS count, CAST(sum(dur) AS BIGINT) AS time FROM z JOIN hb ON z.name = hb.name AND (dur >= lo OR i = 0) AND (dur < hi OR i = {BINS - 1}) WHERE dur > 0 GROUP BY ALL)""")
CTES["z2"] = ((), """e2 AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS cap, event_id, epoch_us(ts) * 1000 AS t, user_id AS thread, event_type, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')),
e21 AS (SELECT *, sum(d) OVER (PARTITION BY cap, thread ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e2),
e22 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY cap, thread ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)) AS dep FROM e21),
e23 AS (SELECT *, CASE WHEN d = 1 THEN dep ELSE coalesce(lag(dep) OVER (PARTITION BY cap, thread ORDER BY t, event_id), 0) END AS lvl FROM e22),
e24 AS (SELECT *, lead(d) OVER w AS nd, lead(t) OVER w AS nt FROM e23 WHERE lvl > 0 WINDOW w AS (PARTITION BY cap, thread, lvl ORDER BY t, event_id)),
z2 AS (SELECT cap, event_id AS zone_id, event_type AS name, t AS start, CASE WHEN nd = -1 THEN nt - t END AS dur FROM e24 WHERE d = 1)""")


def plain_histogram(spark, sf_dir):
    return histogram(zones(spark, sf_dir).where("dur > 0"), ["name"], "dur", BINS)


@query("q42_sorted_durations", "SELECT zone_id, dur AS value FROM z WHERE dur > 0 ORDER BY dur, zone_id", "z")
def _(spark, sf_dir):
    return Z.sorted_durations(zones(spark, sf_dir))


@query("q42_sorted_self", "SELECT zone_id, self_time AS value FROM zs WHERE self_time > 0 ORDER BY self_time, zone_id", "zs")
def _(spark, sf_dir):
    return Z.sorted_durations(zones(spark, sf_dir), "self_time")


@query("q43_percentiles", f"SELECT name, {dist()} FROM z WHERE dur > 0 GROUP BY name", "z")
def _(spark, sf_dir):
    return fitted(Z.distribution(zones(spark, sf_dir), ["name"]), "total")


@query("q44_mode", "SELECT name, (arg_max(lo, (count, -bin)) + arg_max(hi, (count, -bin))) // 2 AS mode FROM hist GROUP BY name", "hist")
def _(spark, sf_dir):
    return Z.mode(plain_histogram(spark, sf_dir), ["name"])


@query("q45_histogram", "SELECT name, bin, lo, hi, count, time FROM hist", "hist")
def _(spark, sf_dir):
    return plain_histogram(spark, sf_dir)


@query(
    "q46_histogram_log",
    f"""WITH e AS (SELECT name, min(dur) AS tmin, max(dur) AS tmax FROM z WHERE dur > 0 GROUP BY name),
b AS (SELECT name, tmin, i, CAST(trunc(pow(10.0::DOUBLE, log10(CAST(tmin AS DOUBLE)) + (i + 1) * ((log10(CAST(tmax AS DOUBLE)) - log10(CAST(tmin AS DOUBLE))) / {BINS}))) AS BIGINT) AS hi FROM e, (SELECT unnest(range({BINS})) AS i)),
c AS (SELECT name, i, hi, CASE WHEN i = 0 THEN tmin ELSE lag(hi) OVER (PARTITION BY name ORDER BY i) END AS lo FROM b)
SELECT z.name, i AS bin, count(*) AS count, CAST(sum(dur) AS BIGINT) AS time FROM z JOIN c ON z.name = c.name AND (dur >= lo OR i = 0) AND (dur < hi OR i = {BINS - 1}) WHERE dur > 0 GROUP BY ALL""",
    "z",
)
def _(spark, sf_dir):
    return histogram(zones(spark, sf_dir).where("dur > 0"), ["name"], "dur", BINS, log=True).select("name", "bin", "count", "time")


@query(
    "q48_summarised_histogram",
    """WITH e AS (SELECT name, min(dur) AS tmin, max(dur) AS tmax FROM z WHERE dur > 0 GROUP BY name), g AS (SELECT name, tmin, tmax, i, tmin + i * (tmax - tmin) // 500 AS lo, tmin + (i + 1) * (tmax - tmin) // 500 AS hi FROM e, (SELECT unnest(range(500)) AS i)),
f AS (SELECT z.name, i * 32 // 500 AS bin, count(*) AS count, CAST(sum(dur) AS BIGINT) AS time FROM z JOIN g ON z.name = g.name AND (dur >= lo OR i = 0) AND (dur < hi OR i = 499) WHERE dur > 0 GROUP BY 1, 2)
SELECT e.name, CAST(b AS INTEGER) AS bin, CAST(trunc(tmin + b / 32.0::DOUBLE * (tmax - tmin)) AS BIGINT) AS start, CAST(trunc(tmin + (b + 1) / 32.0::DOUBLE * (tmax - tmin)) AS BIGINT) AS "end", coalesce(count, 0) AS count, coalesce(time, 0) AS time
FROM e CROSS JOIN (SELECT unnest(range(32)) AS b) LEFT JOIN f ON f.name = e.name AND f.bin = b""",
    "z",
)
def _(spark, sf_dir):
    return summarised(zones(spark, sf_dir).where("dur > 0"), ["name"], "dur", 500)


@query("q47_histogram_trimmed", "WITH e AS (SELECT name, min(bin) AS low, max(bin) AS high FROM hist WHERE count >= 20 GROUP BY name) SELECT hist.* FROM hist JOIN e ON hist.name = e.name AND bin BETWEEN low AND high", "hist")
def _(spark, sf_dir):
    return Z.trimmed(plain_histogram(spark, sf_dir), ["name"], 20)


_KEYS = {"thread": "CAST(thread AS VARCHAR)", "text": "text", "name": "name", "callstack": "CAST(callstack AS VARCHAR)", "parent": "CAST(coalesce(parent_id, 0) AS VARCHAR)", "none": "''"}
for _by, _key in _KEYS.items():

    @query(f"q49_group_by_{_by}", f"SELECT {_key} AS key, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total, CAST(sum(dur) AS DOUBLE) / count(*) AS mean, min(start) AS first, list_sort(list(dur))[CAST(least(count(*) - 1, count(*) // 2) AS BIGINT) + 1] AS median FROM z WHERE dur > 0 GROUP BY 1", "z")
    def _(spark, sf_dir, by=_by):
        return fitted(Z.grouped(zones(spark, sf_dir), by), "total")


@query("q50_groups_sorted", "SELECT CAST(thread AS VARCHAR) AS key, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total FROM z WHERE dur > 0 GROUP BY 1 ORDER BY count(*) DESC, min(start)", "z")
def _(spark, sf_dir):
    return Z.sort_groups(fitted(Z.grouped(zones(spark, sf_dir), "thread"), "total"), "count").select("key", "count", "total")


@query("q52_zone_list_sorted", "SELECT zone_id, name, dur FROM z WHERE dur > 0 ORDER BY name, dur DESC, zone_id", "z")
def _(spark, sf_dir):
    return zones(spark, sf_dir).where("dur > 0").orderBy("name", F.desc("dur"), "zone_id").select("zone_id", "name", "dur")


@query("q42_running_distribution", f"WITH r AS (SELECT z.zone_id, z.name, CAST(sum(least(z.stop, cs.stop) - greatest(z.start, cs.start)) AS BIGINT) AS x FROM z JOIN cs ON z.thread = cs.thread AND cs.start < z.stop AND z.start < cs.stop WHERE z.dur > 0 AND cs.stop > cs.start GROUP BY 1, 2) SELECT name, {dist('x')} FROM r WHERE x > 0 GROUP BY name", "z", "cs")
def _(spark, sf_dir):
    z = zones(spark, sf_dir)
    run = running(z, A.context_switches(spark, sf_dir)).select("zone_id", F.col("running").alias("x"))
    return fitted(Z.distribution(z.select("zone_id", "name").join(run, "zone_id"), ["name"], "x"), "total")


@query("q53_sampled_symbols", "SELECT frames[1] AS symbol, count(*) AS count FROM st WHERE EXISTS (SELECT 1 FROM z WHERE z.thread = st.thread AND z.start <= st.time AND st.time < z.stop AND z.name = 'click') GROUP BY 1", "st", "z")
def _(spark, sf_dir):
    s = A.stacks(spark, sf_dir)
    return Z.sampled_symbols(zones(spark, sf_dir).where("name = 'click'"), s, s)


@query("q139_text_filtered", "SELECT zone_id, text FROM z WHERE text LIKE '%5%' AND dur > 0", "z")
def _(spark, sf_dir):
    from ..functions.predicates import text_filter

    return zones(spark, sf_dir).where("dur > 0").where(text_filter(F.col("text"), "5")).select("zone_id", "text")


# comparison


def two(spark, sf_dir):
    return named(with_self_time(A.zones(spark, sf_dir, split=True)), A.source_locations(spark))


@query("q54_match_zones", "WITH a AS (SELECT DISTINCT name FROM z2 WHERE cap = 'A'), b AS (SELECT DISTINCT name FROM z2 WHERE cap = 'B' AND name <> 'view') SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS in_this, b.name IS NOT NULL AS in_other FROM a FULL JOIN b ON a.name = b.name", "z2")
def _(spark, sf_dir):
    z = two(spark, sf_dir)
    return Z.match_zones(z.where("capture_id = 'A'"), z.where("capture_id = 'B' and name <> 'view'"), ["name"])


@query("q55_match_frame_sets", "SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS cap, count(*) AS frames FROM events WHERE event_type = 'signup' GROUP BY 1")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir, split=True).where("event_type = 'signup'").withColumn("frame_set", F.lit("Frame"))
    shared = e.groupBy("frame_set").agg(F.countDistinct("capture_id").alias("n")).where("n = 2")
    return e.join(shared, "frame_set", "left_semi").groupBy(F.col("capture_id").alias("cap")).agg(F.count(F.lit(1)).alias("frames"))


_cols = [c for c in ("count", "total", "mean", "sigma", "p50", "p75", "p90", "p99", "p99_9")]
_side = f"s AS (SELECT cap, name, {dist()} FROM z2 WHERE dur > 0 GROUP BY cap, name)"


@query("q56_side_by_side", f"WITH {_side} SELECT a.name, {', '.join(f'a.{c} AS this_{c}, b.{c} AS other_{c}' for c in _cols)}, a.mean / b.mean AS factor, a.mean - b.mean AS difference, CASE WHEN a.mean / b.mean < 1 THEN 'less' ELSE 'more' END AS verdict FROM s a JOIN s b ON a.name = b.name AND a.cap = 'A' AND b.cap = 'B'", "z2")
def _(spark, sf_dir):
    return fitted(Z.side_by_side(two(spark, sf_dir), "A", "B"), "this_total", "other_total")


@query("q57_speed_up", f"WITH {_side} SELECT a.name, a.mean / b.mean AS factor, CASE WHEN a.mean / b.mean < 1 THEN 'less' ELSE 'more' END AS verdict FROM s a JOIN s b ON a.name = b.name AND a.cap = 'A' AND b.cap = 'B'", "z2")
def _(spark, sf_dir):
    return Z.side_by_side(two(spark, sf_dir), "A", "B").select("name", "factor", "verdict")


_common = f"""WITH e AS (SELECT name, min(dur) AS tmin, max(dur) AS tmax FROM z2 WHERE dur > 0 GROUP BY name),
b AS (SELECT name, i, tmin + (i + 1) * (tmax - tmin) // {BINS} AS hi, CASE WHEN i = 0 THEN tmin ELSE tmin + i * (tmax - tmin) // {BINS} END AS lo FROM e, (SELECT unnest(range({BINS})) AS i)),
c AS (SELECT z2.name, i AS bin, lo, count(*) FILTER (cap = 'A') AS a, count(*) FILTER (cap = 'B') AS b FROM z2 JOIN b ON z2.name = b.name AND (dur >= lo OR i = 0) AND (dur < hi OR i = {BINS - 1}) WHERE dur > 0 GROUP BY ALL)"""


@query("q58_common_histogram", _common + " SELECT name, bin, lo, a, b FROM c", "z2")
def _(spark, sf_dir):
    return Z.common_histogram(two(spark, sf_dir), BINS)


@query("q58_common_histogram_normalised", _common + " SELECT name, bin, lo, CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY name) AS a, CAST(b AS DOUBLE) / sum(b) OVER (PARTITION BY name) AS b FROM c", "z2")
def _(spark, sf_dir):
    return Z.common_histogram(two(spark, sf_dir), BINS, normalised=True)


@query("q59_source_files", "SELECT p_brand AS file, CASE WHEN count(*) FILTER (p_partkey % 2 = 1) = 0 THEN 'only this' WHEN count(*) FILTER (p_partkey % 2 = 0) = 0 THEN 'only other' ELSE 'changed' END AS status FROM part GROUP BY p_brand")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    side = lambda odd: part.where(F.col("p_partkey") % 2 == odd).groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("content"))
    return Z.source_diff(side(0), side(1)).select("file", "status")


@query("q60_compare_range", f"SELECT cap, name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total FROM z2 WHERE dur > 0 AND start >= {SINCE} AND start < {UNTIL} GROUP BY cap, name", "z2")
def _(spark, sf_dir):
    z = two(spark, sf_dir).where(f"dur > 0 and start >= {SINCE} and start < {UNTIL}")
    return z.groupBy(F.col("capture_id").alias("cap"), "name").agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("total"))
