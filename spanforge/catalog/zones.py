"""Queries on zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import zones as Z
from ..plans.nesting import nest_blocks, with_effective_end, with_self_time
from ..plans.stats import fitted
from ..sources import adapters as A
from .base import CTES, query

CTES["anc"] = (("z",), "anc AS (SELECT c.zone_id, a.zone_id AS ancestor_id, c.depth - a.depth AS distance, a.name AS aname, a.stop AS astop, a.start AS astart FROM z c JOIN z a ON a.thread = c.thread AND a.depth < c.depth AND (a.start, a.zone_id) < (c.start, c.zone_id) AND (a.stop IS NULL OR (a.stop, a.stop_seq) > (c.start, c.zone_id)))")
POOLED = "CAST(min(dur) AS BIGINT) AS min, CAST(max(dur) AS BIGINT) AS max, CAST(sum(dur) AS BIGINT) AS total, CAST(sum(CAST(dur AS HUGEINT) * dur) AS DOUBLE) AS sum_sq, count(dur) AS count, CAST(sum(dur) AS DOUBLE) / count(dur) AS avg"
DAY = 86_400_000_000_000
SINCE = 1_704_067_200_000_000_000 + DAY
UNTIL = SINCE + 5 * DAY


def zones(spark, sf_dir, split=False):
    """Zones with name, file, line, dur and self_time."""
    return Z.named(with_self_time(A.zones(spark, sf_dir, split)), A.source_locations(spark))


@query("q22_nesting", "SELECT zone_id, thread, name, start, stop AS \"end\", depth, parent_id, reentrant FROM zr", "zr")
def _(spark, sf_dir):
    return zones(spark, sf_dir).select("zone_id", "thread", "name", "start", "end", "depth", "parent_id", "reentrant")


@query("q22_nesting_blocks", "SELECT zone_id, start, stop AS \"end\", depth, parent_id, reentrant FROM zr", "zr")
def _(spark, sf_dir):
    return nest_blocks(A.trace_events(spark, sf_dir), DAY).select("zone_id", "start", "end", "depth", "parent_id", "reentrant")


@query("q23_effective_end", "SELECT z.zone_id, coalesce(stop, m) AS end_eff FROM z JOIN (SELECT thread, max(greatest(start, coalesce(stop, start))) AS m FROM z GROUP BY thread) USING (thread)", "z")
def _(spark, sf_dir):
    return with_effective_end(A.zones(spark, sf_dir)).select("zone_id", "end_eff")


@query("q23c_self_time", "SELECT zone_id, dur, self_time FROM zs WHERE dur IS NOT NULL", "zs")
def _(spark, sf_dir):
    return zones(spark, sf_dir).where("dur is not null").select("zone_id", "dur", "self_time")


@query(
    "q23d_self_time_clamped",
    f"""WITH c AS (SELECT zone_id, parent_id, greatest(least(stop, {UNTIL}) - greatest(start, {SINCE}), 0) AS inside FROM z WHERE dur IS NOT NULL),
b AS (SELECT parent_id, sum(inside) AS below FROM c GROUP BY parent_id)
SELECT c.zone_id, inside, CAST(inside - coalesce(below, 0) AS BIGINT) AS self_inside FROM c LEFT JOIN b ON b.parent_id = c.zone_id WHERE inside > 0""",
    "z",
)
def _(spark, sf_dir):
    return Z.self_time_in(with_self_time(A.zones(spark, sf_dir)), SINCE, UNTIL)


@query("q23e_reentrancy", "SELECT name, count(*) FILTER (reentrant) AS nested, count(*) AS zones FROM zr GROUP BY name", "zr")
def _(spark, sf_dir):
    return zones(spark, sf_dir).groupBy("name").agg(F.count(F.when(F.col("reentrant"), 1)).alias("nested"), F.count(F.lit(1)).alias("zones"))


_RUN = """SELECT z.zone_id, CAST(sum(least(z.stop, cs.stop) - greatest(z.start, cs.start)) AS BIGINT) AS running, count(*) AS regions, count(DISTINCT cpu) AS cpus
FROM z JOIN cs ON z.thread = cs.thread AND cs.start < z.stop AND z.start < cs.stop WHERE z.dur > 0 AND cs.stop > cs.start GROUP BY z.zone_id"""


@query("q23f_running_time", _RUN, "z", "cs")
def _(spark, sf_dir):
    return Z.running(with_self_time(A.zones(spark, sf_dir)), A.context_switches(spark, sf_dir))


@query(
    "q23h_zone_at_time",
    """SELECT event_id AS point_id, max(z.depth) AS depth, arg_max(zone_id, z.depth) AS zone_id FROM ev JOIN z ON ev.user_id = z.thread AND z.start <= t AND t < z.stop WHERE event_type = 'signup' GROUP BY event_id""",
    "z",
)
def _(spark, sf_dir):
    pts = A.events(spark, sf_dir).where("event_type = 'signup'").select("capture_id", F.col("user_id").alias("thread"), F.col("time").alias("t"), F.col("event_id").alias("point_id"))
    return Z.zone_at(A.zones(spark, sf_dir), pts)


@query("q23i_parent_chain", "SELECT c.zone_id, concat_ws('/', a.path, c.name) AS path FROM z c LEFT JOIN (SELECT zone_id, string_agg(aname, '/' ORDER BY distance DESC) AS path FROM anc GROUP BY zone_id) a USING (zone_id)", "anc")
def _(spark, sf_dir):
    return Z.parent_chain(zones(spark, sf_dir))


@query(
    "q23j_zone_attachments",
    """WITH a AS (SELECT z.zone_id, ev.t, ev.event_id, ev.props, ev.k FROM z JOIN ev ON ev.user_id = z.thread AND ev.event_type = 'signup' AND z.start <= ev.t AND ev.t < z.stop)
SELECT zone_id, string_agg(props || chr(10) || printf('%d [0x%x]', k, k), chr(10) ORDER BY t, event_id) AS text, arg_max(k % 256 * 65536 + k % 7 * 256 + k % 3, t) AS color FROM a GROUP BY zone_id""",
    "z",
)
def _(spark, sf_dir):
    z = A.zones(spark, sf_dir).where("end > start").select("capture_id", "thread", "start", "end", "zone_id")
    pts = A.events(spark, sf_dir).where("event_type = 'signup'").select("capture_id", F.col("user_id").alias("thread"), F.col("time").alias("t"), "event_id", "props", "k")
    met = Z.covering(pts, z, ["capture_id", "thread"])
    note = lambda text, value, seq: met.select("zone_id", F.col("t").alias("time"), seq.alias("seq"), text.alias("text"), value.alias("value"), (F.col("k") % 3).alias("r"), (F.col("k") % 7).alias("g"), (F.col("k") % 256).alias("b"))
    none = F.lit(None)
    return Z.attached(note(F.col("props"), none.cast("long"), F.col("event_id") * 2).unionByName(note(none.cast("string"), F.col("k"), F.col("event_id") * 2 + 1)))


_STD = "CASE WHEN n > 1 THEN sqrt(greatest((sq - 2.0 * CAST(total AS DOUBLE) * CAST(mean AS DOUBLE) + CAST(mean AS DOUBLE) * CAST(mean AS DOUBLE) * n) / (n - 1), 0.0)) ELSE 0.0 END"


def _csv(x):
    return f"""WITH a AS (SELECT srcloc, CAST(sum({x}) AS BIGINT) AS total, count(*) AS n, CAST(min({x}) AS BIGINT) AS mn, CAST(max({x}) AS BIGINT) AS mx, CAST(sum(CAST({x} AS HUGEINT) * {x}) AS DOUBLE) AS sq, CAST(sum({x}) AS BIGINT) // count(*) AS mean FROM zs WHERE dur > 0 GROUP BY srcloc)
SELECT coalesce(name, function) AS name, file AS src_file, line AS src_line, total AS total_ns, total * 100.0::DOUBLE / last_time AS total_perc, n AS counts, mean AS mean_ns, mn AS min_ns, mx AS max_ns, {_STD} AS std_ns FROM a JOIN loc USING (srcloc), lastt"""


@query("q24_csv_aggregate", _csv("dur"), "zs", "loc", "lastt")
def _(spark, sf_dir):
    return fitted(Z.csv_aggregate(zones(spark, sf_dir), A.last_time(spark, sf_dir)), "total_ns")


@query("q24_csv_aggregate_self", _csv("self_time"), "zs", "loc", "lastt")
def _(spark, sf_dir):
    return fitted(Z.csv_aggregate(zones(spark, sf_dir), A.last_time(spark, sf_dir), own=True), "total_ns")


@query(
    "q25_truncated_mean",
    """WITH l AS (SELECT srcloc, quantile_cont(CAST(dur AS DOUBLE), 0.9) AS lim FROM z WHERE dur > 0 GROUP BY srcloc)
SELECT z.srcloc, name, CAST(round(min(lim)) AS BIGINT) AS percentile_ns, CAST(sum(dur) AS BIGINT) // count(*) AS truncated_mean_ns FROM z JOIN l ON z.srcloc = l.srcloc AND dur <= lim WHERE dur > 0 GROUP BY z.srcloc, name""",
    "z",
)
def _(spark, sf_dir):
    return Z.truncated(zones(spark, sf_dir))


@query("q26_zone_stats", f"SELECT srcloc, {POOLED} FROM z WHERE dur > 0 GROUP BY srcloc", "z")
def _(spark, sf_dir):
    return fitted(Z.statistics(zones(spark, sf_dir), "srcloc"), "total")


@query("q27_all_zone_stats", f"SELECT name, {POOLED} FROM z WHERE dur > 0 GROUP BY name", "z")
def _(spark, sf_dir):
    return fitted(Z.statistics(zones(spark, sf_dir), "name"), "total")


@query("q28_root_zone_stats", f"SELECT name, {POOLED} FROM z WHERE parent_id IS NULL AND dur IS NOT NULL GROUP BY name", "z")
def _(spark, sf_dir):
    return fitted(Z.root_statistics(zones(spark, sf_dir)), "total")


@query("q29_child_zone_stats", f"SELECT name, {POOLED} FROM z WHERE dur IS NOT NULL AND parent_id IN (SELECT zone_id FROM z WHERE name = 'view' AND dur IS NOT NULL) GROUP BY name", "z")
def _(spark, sf_dir):
    return fitted(Z.child_statistics(zones(spark, sf_dir), "view"), "total")


@query(
    "q30_zones_in_frames",
    "SELECT idx, name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total FROM z JOIN fr ON fr.start <= z.start AND z.start < fr.stop WHERE dur IS NOT NULL AND zone_id NOT IN (SELECT zone_id FROM anc WHERE astop IS NULL) GROUP BY idx, name",
    "anc", "fr",
)
def _(spark, sf_dir):
    from ..operators.frames import with_ends

    return Z.zones_in_frames(zones(spark, sf_dir), with_ends(A.frames(spark, sf_dir), A.last_time(spark, sf_dir)))


for _kind, _cols, _sql in (
    ("durations", ["dur"], "dur"),
    ("occurrences", ["start", "end"], 'start, stop AS "end"'),
    ("occurrences_with_thread", ["start", "end", "thread"], 'start, stop AS "end", thread'),
    ("annotations", ["start", "text"], "start, text"),
    ("callstacks", ["start", "callstack"], "start, callstack"),
):

    @query(f"q31_zone_{_kind}", f"SELECT {_sql} FROM z WHERE name = 'click' AND dur IS NOT NULL ORDER BY start, zone_id", "z")
    def _(spark, sf_dir, cols=_cols):
        return Z.listing(zones(spark, sf_dir), "click", cols)


@query("q32_source_locations", "SELECT coalesce(name, function) AS name, srcloc, function, file, line FROM loc", "loc")
def _(spark, sf_dir):
    return Z.locations_by_name(A.source_locations(spark))


for _mode, _total, _where in (("self", "self_time", ""), ("children", "dur", ""), ("nonreentrant", "dur", "AND NOT reentrant")):

    @query(f"q33_statistics_{_mode}", f"SELECT srcloc, coalesce(loc.name, function) AS name, file, line, count(DISTINCT thread) AS threads, count(*) AS count, CAST(sum({_total}) AS BIGINT) AS total FROM zs JOIN loc USING (srcloc) WHERE dur > 0 {_where} GROUP BY ALL", "zs", "loc")
    def _(spark, sf_dir, mode=_mode):
        return fitted(Z.accumulated(zones(spark, sf_dir), mode), "total")


@query("q34_statistics_range", f"SELECT srcloc, coalesce(loc.name, function) AS name, file, line, count(DISTINCT thread) AS threads, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total FROM zs JOIN loc USING (srcloc) WHERE dur > 0 AND start >= {SINCE} AND stop <= {UNTIL} GROUP BY ALL", "zs", "loc")
def _(spark, sf_dir):
    return fitted(Z.accumulated(zones(spark, sf_dir), "children", (SINCE, UNTIL)), "total")


@query("q35_statistics_sorted", "SELECT srcloc, coalesce(loc.name, function) AS name, file, line, count(DISTINCT thread) AS threads, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total FROM zs JOIN loc USING (srcloc) WHERE dur > 0 GROUP BY ALL ORDER BY total / count DESC, srcloc", "zs", "loc")
def _(spark, sf_dir):
    return Z.ordered(fitted(Z.accumulated(zones(spark, sf_dir), "children"), "total"), "mean")


@query("q37_nonreentrant_stats", "SELECT srcloc, count(*) AS count, min(dur) AS min, max(dur) AS max, CAST(sum(dur) AS BIGINT) AS total FROM zr WHERE dur > 0 AND NOT reentrant GROUP BY srcloc", "zr")
def _(spark, sf_dir):
    return Z.nonreentrant(zones(spark, sf_dir))


@query("q38_thread_counts", "SELECT srcloc, thread, count(*) AS count FROM z WHERE dur > 0 GROUP BY srcloc, thread", "z")
def _(spark, sf_dir):
    return Z.thread_counts(zones(spark, sf_dir))


for _x, _col in (("inclusive", "dur"), ("exclusive", "self_time")):

    @query(f"q39_child_distribution_{_x}", f"SELECT zs.name, CAST(sum({_col}) AS BIGINT) AS time, count(*) AS count FROM zs JOIN anc USING (zone_id) WHERE aname = 'view' AND astop IS NOT NULL AND dur IS NOT NULL GROUP BY zs.name", "zs", "anc")
    def _(spark, sf_dir, x=_x):
        return fitted(Z.descendants(zones(spark, sf_dir), "view", x == "exclusive"), "time")


@query("q40_children_grouped", "SELECT c.parent_id, c.name, count(*) AS count, CAST(sum(c.dur) AS BIGINT) AS time, CAST(sum(c.dur) AS BIGINT) * 100.0::DOUBLE / min(p.dur) AS share FROM z c JOIN z p ON c.parent_id = p.zone_id WHERE p.dur > 0 AND c.dur IS NOT NULL GROUP BY c.parent_id, c.name", "z")
def _(spark, sf_dir):
    return Z.children(zones(spark, sf_dir))


@query("q41_share_of_mean", "SELECT zone_id, name, dur, CAST(dur AS DOUBLE) / CAST(sum(dur) OVER (PARTITION BY srcloc) AS BIGINT) * count(*) OVER (PARTITION BY srcloc) * 100.0 AS share FROM z WHERE dur > 0", "z")
def _(spark, sf_dir):
    return Z.share_of_mean(zones(spark, sf_dir))


# predicates


@query("q21a_name_contains", "SELECT zone_id FROM z WHERE lower(name) LIKE '%ic%'", "z")
def _(spark, sf_dir):
    return zones(spark, sf_dir).where(P.contains(F.col("name"), "IC")).select("zone_id")


@query("q21b_matching_locations", "SELECT srcloc, function FROM loc WHERE lower(coalesce(name, function)) LIKE '%i%' AND srcloc IN (SELECT srcloc FROM z)", "z", "loc")
def _(spark, sf_dir):
    return P.matching_locations(A.source_locations(spark), A.zones(spark, sf_dir), "I").select("srcloc", "function")


@query("q21c_text_filter", "SELECT event_id AS seq, props AS text FROM ev WHERE event_type = 'signup' AND (props LIKE '%7%' OR props LIKE '%3%') AND props NOT LIKE '%9%'", "ev")
def _(spark, sf_dir):
    return A.messages(spark, sf_dir).where(P.text_filter(F.col("text"), "7, 3, -9")).select("seq", "text")


@query("q21d_message_filter", "SELECT event_id AS seq FROM ev WHERE event_type = 'signup' AND props LIKE '%1%' AND k % 6 IN (3, 4) AND user_id IN (1, 2, 3, 4, 5, 6, 7, 8)", "ev")
def _(spark, sf_dir):
    return A.messages(spark, sf_dir).where(P.message_filter("1", ["User"], ["Warning", "Error"], list(range(1, 9)))).select("seq")


#: Images and paths that meet every rule, and some that nearly do.
_IMAGES = ("img0", "/usr/bin/x", "/lib/a.so", "/lib64/b.so", "<kernel>", "/opt/app/libmine.so", "/usrlocal/x", "<kernel", None)
_PATHS = ("src/a.cpp", "/usr/include/x.h", "/lib/y.h", "[unknown]", "<kernel>", "C:\\Program Files (x86)\\k.h", "c:\\program files\\k.h", "d:\\a01\\_work\\1.cpp", "/home/u/.cargo/z.rs", "/a/../b.cpp", "/a/.", "", "/build/a.cpp", "\\include\\q.h", "/lib64/h.h", "x<kernel>", None)


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(
    "q21g_external_frames",
    f"""WITH f AS (SELECT event_id AS seq, {_sql_list(_IMAGES)}[event_id % {len(_IMAGES)} + 1] AS image, {_sql_list(_PATHS)}[event_id // 7 % {len(_PATHS)} + 1] AS file FROM ev)
SELECT seq, coalesce(image, '') LIKE '/usr/%' OR coalesce(image, '') LIKE '/lib/%' OR coalesce(image, '') LIKE '/lib64/%' OR coalesce(image = '<kernel>', false)
  OR coalesce(left(file, 5) IN ('/usr/', '/lib/') OR file IN ('[unknown]', '<kernel>') OR left(file, 16) = 'C:\\Program Files' OR left(file, 13) = 'd:\\a01\\_work\\'
    OR len(list_filter(range(1, len(file)), lambda i: substr(file, i, 2) = '/.' AND substr(file, i + 2, 1) <> '.')) > 0, false) AS external FROM f""",
    "ev",
)
def _(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))
    e = A.events(spark, sf_dir)
    image, file = pick(_IMAGES, F.col("event_id")), pick(_PATHS, F.call_function("div", F.col("event_id"), F.lit(7)))
    return e.select(F.col("event_id").alias("seq"), P.is_external(image, file).alias("external"))


@query("q21e_zone_names", "SELECT CASE WHEN callstack = 3 THEN 'named ' || thread % 5 ELSE name END AS zone_name, name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total FROM z WHERE dur > 0 GROUP BY 1, 2", "z")
def _(spark, sf_dir):
    given = F.when(F.col("callstack") == 3, F.concat(F.lit("named "), F.col("thread") % 5))
    z = Z.named(with_self_time(A.zones(spark, sf_dir).withColumn("name_override", given)), A.source_locations(spark))
    return fitted(Z.statistics(z, "zone_name", "name").select("zone_name", "name", "count", "total"), "total")


@query("q21f_kernel_frames", "SELECT DISTINCT f AS sym_addr, f - 1000 < 0 AS kernel FROM (SELECT unnest(frames) AS f FROM st)", "st")
def _(spark, sf_dir):
    return A.symbols(spark, sf_dir).select("sym_addr", P.is_kernel(F.col("sym_addr") - 1000).alias("kernel"))


for _rule, _cond in ((P.RangeRule.CONTAINED, f"start >= {SINCE} AND stop <= {UNTIL}"), (P.RangeRule.START_HALF_OPEN, f"start >= {SINCE} AND start < {UNTIL}"), (P.RangeRule.CLAMPED, f"stop > {SINCE} AND start < {UNTIL}"), (P.RangeRule.CLOSED, f"start >= {SINCE} AND start <= {UNTIL}")):

    @query(f"q21h_range_{_rule.value}", f"SELECT zone_id, CAST(greatest(least(stop, {UNTIL}) - greatest(start, {SINCE}), 0) AS BIGINT) AS inside FROM z WHERE dur IS NOT NULL AND {_cond}", "z")
    def _(spark, sf_dir, rule=_rule):
        s, e = F.col("start"), F.col("end")
        return zones(spark, sf_dir).where("dur is not null").where(P.in_range(rule, s, e, SINCE, UNTIL)).select("zone_id", P.clipped(s, e, SINCE, UNTIL).alias("inside"))


@query("q21i_path_substitution", "SELECT srcloc, regexp_replace(regexp_replace(file, '^src/', '/build/', 'g'), '\\.cpp$', '.cc', 'g') AS file FROM loc", "loc")
def _(spark, sf_dir):
    return A.source_locations(spark).select("srcloc", P.substituted(F.col("file"), [("^src/", "/build/"), (r"\.cpp$", ".cc")]).alias("file"))


@query("q21j_duration_band", "SELECT zone_id, dur FROM z WHERE dur BETWEEN 1000000000 AND 3600000000000", "z")
def _(spark, sf_dir):
    return zones(spark, sf_dir).where(F.col("dur").between(1_000_000_000, 3_600_000_000_000)).select("zone_id", "dur")


@query("q21k_thread_names", "SELECT c_custkey AS thread, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '???' END AS display FROM customer")
def _(spark, sf_dir):
    t = A.threads(spark, sf_dir)
    own = F.when(F.col("thread") % 3 == 0, F.col("name")).when(F.col("thread") % 3 == 1, F.col("thread").cast("string"))
    return t.select("thread", P.thread_name(own, F.when(F.col("thread") % 3 == 1, F.col("program")), F.col("thread")).alias("display"))


@query("q23b_flat_span_stats", "SELECT l_returnflag AS name, count(*) AS count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, min(CAST(l_quantity AS BIGINT)) AS min, max(CAST(l_quantity AS BIGINT)) AS max FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("total"), F.min("dur").alias("min"), F.max("dur").alias("max"))
