"""Queries on samples, symbols, counters, flame graphs, GPU zones and whole traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import gpu as G
from ..operators import sampling as S
from ..operators import trace as T
from ..operators.zones import running
from ..plans.stats import fitted, total
from ..sources import adapters as A
from .base import CTES, query
from .zones import POOLED, SINCE, UNTIL, zones

PERIOD = 1_000_000_000


@query("q104_callstacks", "SELECT DISTINCT array_to_string(frames, '/') AS frames FROM st", "st")
def _(spark, sf_dir):
    return S.intern(A.stacks(spark, sf_dir)).select(F.array_join(F.transform("frames", lambda x: x.cast("string")), "/").alias("frames"))


@query("q105_plain_samples", "SELECT seq FROM st WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.thread = st.thread AND cs.start = st.time + st.frames[1] % 3)", "st", "cs")
def _(spark, sf_dir):
    # every event is both a switch and a sample; two of three samples come a little later
    samples = A.stacks(spark, sf_dir).withColumn("time", F.col("time") + F.col("frames")[0] % 3)
    return S.without_switch_samples(samples, A.context_switches(spark, sf_dir)).select("seq")


CTES["sy"] = (("st",), "sy AS (SELECT symbol, count(*) AS incl, count(*) FILTER (first) AS excl FROM (SELECT seq, symbol, bool_or(n = 1) AS first FROM (SELECT seq, unnest(frames) AS symbol, unnest(range(1, 4)) AS n FROM st) GROUP BY seq, symbol) GROUP BY symbol)")


@query("q106_symbol_counts", "SELECT * FROM sy", "sy")
def _(spark, sf_dir):
    return S.symbol_counts(A.stacks(spark, sf_dir))


@query("q107_entry_stacks", "SELECT frames[1] AS symbol, array_to_string(frames[2:], '/') AS parents, count(*) AS count FROM st GROUP BY 1, 2", "st")
def _(spark, sf_dir):
    return S.entry_stacks(A.stacks(spark, sf_dir)).select("symbol", F.array_join(F.transform("parents", lambda x: x.cast("string")), "/").alias("parents"), "count")


_SYM = "'sym' || symbol AS name, 'src/f' || symbol % 7 || '.cpp' AS file, CAST(symbol % 100 AS INTEGER) AS line, 'img' || symbol // 1000 AS image"


@query("q108_symbol_stats", f"SELECT symbol, incl, excl, {_SYM} FROM sy", "sy")
def _(spark, sf_dir):
    return S.symbol_stats(A.stacks(spark, sf_dir), A.symbols(spark, sf_dir))


@query("q109_samples_of_symbol", "SELECT time, thread FROM st WHERE frames[1] = 7", "st")
def _(spark, sf_dir):
    return S.samples_of(A.stacks(spark, sf_dir), 7)


@query("q110_sampling_merged", "SELECT symbol // 10 AS base, CAST(sum(incl) AS BIGINT) AS incl, CAST(sum(excl) AS BIGINT) AS excl FROM sy WHERE symbol // 1000 < 2 GROUP BY 1", "sy")
def _(spark, sf_dir):
    stats = S.symbol_stats(A.stacks(spark, sf_dir), A.symbols(spark, sf_dir)).where("image <> 'img2'")
    return S.merged(stats, F.call_function("div", F.col("symbol"), F.lit(10)))


@query("q111_address_to_symbol", "SELECT DISTINCT k AS t, 'fn' || k // 16 AS name FROM ev", "ev")
def _(spark, sf_dir):
    symbols = spark.range(64).select(F.lit(A.CAPTURE).alias("capture_id"), (F.col("id") * 16).alias("sym_addr"), F.lit(16).alias("size"), F.concat(F.lit("fn"), F.col("id")).alias("name"))
    return S.symbol_at(A.events(spark, sf_dir).select("capture_id", F.col("k").alias("t")).distinct(), symbols).select("t", "name")


@query("q112_top_symbols", f"SELECT symbol, excl, {_SYM} FROM sy WHERE regexp_matches('sym' || symbol, 'sym[0-9]5$') ORDER BY excl DESC, symbol LIMIT 5", "sy")
def _(spark, sf_dir):
    return S.top_symbols(S.symbol_stats(A.stacks(spark, sf_dir), A.symbols(spark, sf_dir)), "sym[0-9]5$", 5).drop("incl")


@query("q113_symbol_parents", "WITH p AS (SELECT array_to_string(frames[2:], '/') AS parents, count(*) AS count FROM st WHERE frames[1] = 42 GROUP BY 1) SELECT parents, count, count * 100.0::DOUBLE / CAST(sum(count) OVER () AS BIGINT) AS share FROM p ORDER BY count DESC, parents LIMIT 10", "st")
def _(spark, sf_dir):
    return S.parents_of(A.stacks(spark, sf_dir), 42, 10)


for _dir, _expr in (("bottom_up", "list_reverse(frames)"), ("top_down", "frames")):

    @query(f"q114_sample_tree_{_dir}", f"WITH p AS (SELECT {_expr} AS f, unnest([1, 2, 3]) AS n FROM st) SELECT array_to_string(f[1:n], '/') AS path, count(*) AS count FROM p GROUP BY 1", "st")
    def _(spark, sf_dir, up=_dir == "bottom_up"):
        from ..operators.memory import call_tree

        s = A.stacks(spark, sf_dir).withColumn("callstack", F.xxhash64("frames"))
        weights = s.groupBy("callstack").agg(F.count(F.lit(1)).alias("count"))
        return call_tree(weights, s.select("callstack", "frames").dropDuplicates(["callstack"]), up, ["count"])


def frames_dim(spark, sf_dir):
    """Two frames to an address: an inlined one and the function around it."""
    s = A.symbols(spark, sf_dir)
    f = s.select(F.col("sym_addr").alias("frame_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("inline_idx"), "name", "file", "line", "sym_addr")
    return f.withColumn("name", F.when(F.col("inline_idx") == 0, F.concat(F.lit("in_"), "name")).otherwise(F.col("name")))


@query("q115_callstack_frames", "WITH d AS (SELECT DISTINCT frames FROM st), f AS (SELECT array_to_string(frames, '/') AS stack, unnest(frames) AS a, unnest(range(3)) AS pos FROM d), i AS (SELECT unnest([0, 1]) AS inline_idx) SELECT stack, CAST(pos AS INTEGER) AS pos, inline_idx, CASE inline_idx WHEN 0 THEN 'in_' ELSE '' END || 'sym' || a AS name FROM f, i", "st")
def _(spark, sf_dir):
    stacks = A.stacks(spark, sf_dir).select("frames").distinct().withColumn("callstack", F.array_join(F.transform("frames", lambda x: x.cast("string")), "/"))
    return S.flattened(stacks, frames_dim(spark, sf_dir)).select(F.col("callstack").alias("stack"), "pos", "inline_idx", "name")


@query("q143_callstack_text", "WITH d AS (SELECT DISTINCT frames FROM st), f AS (SELECT array_to_string(frames, '/') AS stack, unnest(frames) AS a, unnest(range(3)) AS pos FROM d) SELECT stack, string_agg('inline. in_sym' || a || ' (src/f' || a % 7 || '.cpp:' || a % 100 || ')' || chr(10) || pos || '. sym' || a || ' (src/f' || a % 7 || '.cpp:' || a % 100 || ')', chr(10) ORDER BY pos) AS text FROM f GROUP BY stack", "st")
def _(spark, sf_dir):
    stacks = A.stacks(spark, sf_dir).select("frames").distinct().withColumn("callstack", F.array_join(F.transform("frames", lambda x: x.cast("string")), "/"))
    return S.stack_text(stacks, frames_dim(spark, sf_dir)).select(F.col("callstack").alias("stack"), "text")


@query("q116_callees", "WITH p AS (SELECT frames[2] AS caller, frames[1] AS callee FROM st UNION ALL SELECT frames[3], frames[2] FROM st) SELECT caller, callee, count(*) AS count FROM p GROUP BY 1, 2", "st")
def _(spark, sf_dir):
    return S.callees(A.stacks(spark, sf_dir))


@query("q117_line_counts", "SELECT 'src/f' || frames[1] % 7 || '.cpp' AS file, CAST(frames[1] % 100 AS INTEGER) AS line, count(*) AS count FROM st GROUP BY 1, 2", "st")
def _(spark, sf_dir):
    return S.line_counts(A.stacks(spark, sf_dir), A.symbols(spark, sf_dir))


@query(
    "q118_ghost_zones",
    f"""WITH s AS (SELECT *, list_reverse(frames) AS p, lag(list_reverse(frames)) OVER w AS b, lead(time) OVER w AS nx FROM st WINDOW w AS (PARTITION BY thread ORDER BY time, seq)),
l AS (SELECT thread, time, seq, nx, n, p[1:n] AS pre, CASE WHEN b IS NULL OR b[1:n] <> p[1:n] THEN 1 ELSE 0 END AS fresh FROM (SELECT *, unnest([1, 2, 3]) AS n FROM s)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY thread, n ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT thread, n AS depth, min(time) AS start, arg_max(least(time + {PERIOD}, coalesce(nx, 9223372036854775807)), (time, seq)) AS "end", min(pre[n]) AS symbol FROM r GROUP BY thread, n, run""",
    "st",
)
def _(spark, sf_dir):
    return S.ghost_zones(A.stacks(spark, sf_dir), PERIOD)


_KINDS = ("cycles", "retired", "cache_ref", "cache_miss", "branch_ret", "branch_miss")
CTES["hw"] = (("ev",), "hw AS (SELECT k AS ip, " + ", ".join(f"count(*) FILTER (event_id % 6 = {i}) AS {n}" for i, n in enumerate(_KINDS)) + " FROM ev GROUP BY k)")
_RATE = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} END"


@query("q119_hardware_counters", f"SELECT *, {_RATE.format('retired', 'cycles')} AS ipc, {_RATE.format('cache_miss', 'cache_ref')} AS cache_miss_rate, {_RATE.format('branch_miss', 'branch_ret')} AS branch_miss_rate, sqrt(cache_miss * cache_ref) AS cache_cost, sqrt(branch_miss * branch_ret) AS branch_cost FROM hw", "hw")
def _(spark, sf_dir):
    return S.counters(A.hw_samples(spark, sf_dir))


@query("q120_hw_summary", f"WITH s AS (SELECT ip // 10 * 10 AS symbol, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _KINDS)} FROM hw GROUP BY 1) SELECT symbol, {_RATE.format('retired', 'cycles')} AS ipc, {_RATE.format('cache_miss', 'cache_ref')} AS cache_miss_rate, {_RATE.format('branch_miss', 'branch_ret')} AS branch_miss_rate FROM s", "hw")
def _(spark, sf_dir):
    by_symbol = A.hw_samples(spark, sf_dir).withColumn("ip", F.call_function("div", F.col("ip"), F.lit(10)) * 10)
    return S.counters(by_symbol).select(F.col("ip").alias("symbol"), "ipc", "cache_miss_rate", "branch_miss_rate")


CTES["zpath"] = (("anc",), "zpath AS (SELECT z.zone_id, z.dur, z.start, z.stop, z.thread, concat_ws('/', a.path, z.name) AS path FROM z LEFT JOIN (SELECT zone_id, string_agg(aname, '/' ORDER BY distance DESC) AS path FROM anc GROUP BY zone_id) a USING (zone_id))")


@query("q121_flame_zones", "SELECT path, CAST(sum(dur) AS BIGINT) AS time, count(*) AS count FROM zpath WHERE dur IS NOT NULL GROUP BY path", "zpath")
def _(spark, sf_dir):
    return fitted(S.flame_of_zones(zones(spark, sf_dir)), "time")


@query("q121_flame_zones_range", f"WITH c AS (SELECT path, greatest(least(stop, {UNTIL}) - greatest(start, {SINCE}), 0) AS t FROM zpath WHERE dur IS NOT NULL) SELECT path, CAST(sum(t) AS BIGINT) AS time, count(*) AS count FROM c WHERE t > 0 GROUP BY path", "zpath")
def _(spark, sf_dir):
    return fitted(S.flame_of_zones(zones(spark, sf_dir), SINCE, UNTIL), "time")


@query("q122_flame_running", "WITH r AS (SELECT p.zone_id, path, CAST(sum(least(p.stop, cs.stop) - greatest(p.start, cs.start)) AS BIGINT) AS t FROM zpath p JOIN cs ON p.thread = cs.thread AND cs.start < p.stop AND p.start < cs.stop WHERE p.dur > 0 AND cs.stop > cs.start GROUP BY 1, 2) SELECT path, CAST(sum(t) AS BIGINT) AS time, count(*) AS count FROM r GROUP BY path", "zpath", "cs")
def _(spark, sf_dir):
    z = zones(spark, sf_dir)
    return fitted(S.flame_of_zones(z, running=running(z, A.context_switches(spark, sf_dir))), "time")


@query("q123_flame_samples", f"WITH p AS (SELECT list_filter(list_reverse(frames), lambda x: x <> 0) AS f FROM st), q AS (SELECT f, unnest(range(1, len(f) + 1)) AS n FROM p) SELECT array_to_string(f[1:n], '/') AS path, count(*) * {PERIOD} AS time FROM q GROUP BY 1", "st")
def _(spark, sf_dir):
    return S.flame_of_samples(A.stacks(spark, sf_dir), PERIOD)


@query("q124_flame_sorted", "SELECT path, CAST(sum(dur) AS BIGINT) AS time FROM zpath WHERE dur IS NOT NULL GROUP BY path ORDER BY time DESC, path", "zpath")
def _(spark, sf_dir):
    return fitted(S.flame_of_zones(zones(spark, sf_dir)).select("path", "time"), "time").orderBy(F.desc("time"), "path")


@query("q125_zone_callstack", "SELECT z.zone_id, arg_min(array_to_string(st.frames, '/'), (st.time, st.seq)) AS frames FROM z JOIN st ON z.thread = st.thread AND z.start <= st.time AND st.time < z.stop GROUP BY z.zone_id", "z", "st")
def _(spark, sf_dir):
    from ..plans.intervals import covering

    spans = zones(spark, sf_dir).where("end > start").select("capture_id", "thread", "start", "end", "zone_id")
    met = covering(A.stacks(spark, sf_dir).withColumnRenamed("time", "t"), spans, ["capture_id", "thread"])
    return met.groupBy("zone_id").agg(F.array_join(F.transform(F.min_by("frames", F.struct("t", "seq")), lambda x: x.cast("string")), "/").alias("frames"))


# GPU


def gpu(spark, sf_dir):
    return A.gpu_zones(spark, sf_dir).join(A.source_locations(spark).select("srcloc", F.coalesce("name", "function").alias("name")), "srcloc")


@query("q126_gpu_timestamps", "WITH r AS (SELECT event_id AS seq, user_id % 4 AS ctx, (t // 1000000) % 4294967296 AS raw FROM ev), f AS (SELECT *, CASE WHEN raw < lag(raw) OVER (PARTITION BY ctx ORDER BY seq) THEN 1 ELSE 0 END AS fell FROM r) SELECT seq, CAST(raw + sum(fell) OVER (PARTITION BY ctx ORDER BY seq ROWS UNBOUNDED PRECEDING) * 4294967296 AS BIGINT) AS ticks FROM f", "ev")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    raw = F.call_function("div", F.col("time"), F.lit(1_000_000)) % (1 << 32)
    return G.unwrapped(e.select("capture_id", F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("ctx"), raw.alias("raw")), 32).select("seq", "ticks")


@query("q126_gpu_calibrated", "WITH s AS (SELECT event_id AS seq, user_id % 4 AS ctx, k AS ticks FROM ev), c AS (SELECT event_id AS seq, user_id % 4 AS ctx, k AS at_ticks, t AS at_ns FROM ev WHERE event_type = 'signup') SELECT s.seq, coalesce(c.at_ns + CAST(round((s.ticks - c.at_ticks) * 2.5::DOUBLE * 1.25::DOUBLE) AS BIGINT), CAST(round(s.ticks * 2.5::DOUBLE) AS BIGINT) + 1000) AS time FROM s ASOF LEFT JOIN c ON s.ctx = c.ctx AND s.seq >= c.seq", "ev")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir).withColumn("ctx", F.col("user_id") % 4)
    stamps = e.select("capture_id", "ctx", F.col("event_id").alias("seq"), F.col("k").alias("ticks"))
    contexts = spark.range(4).select(F.lit(A.CAPTURE).alias("capture_id"), F.col("id").alias("ctx"), F.lit(2.5).alias("period"), F.lit(1000).cast("long").alias("time_diff"))
    cal = e.where("event_type = 'signup'").select("capture_id", "ctx", F.col("event_id").alias("seq"), F.col("k").alias("at_ticks"), F.col("time").alias("at_ns"), F.lit(1.25).alias("factor"))
    return G.to_ns(stamps, contexts, cal).select("seq", "time")


@query("q127_gpu_pairing", "WITH r AS (SELECT event_id AS seq, user_id % 4 AS ctx, k AS query_id, t, row_number() OVER w AS n, lead(t) OVER w AS e FROM ev WINDOW w AS (PARTITION BY user_id % 4, k ORDER BY event_id)) SELECT ctx, query_id, (n + 1) // 2 AS use, t AS gpu_start, e AS gpu_end FROM r WHERE n % 2 = 1", "ev")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    stamps = e.select("capture_id", (F.col("user_id") % 4).alias("ctx"), F.col("k").alias("query_id"), F.col("event_id").alias("seq"), "time")
    return G.pair_queries(stamps).select("ctx", "query_id", "use", "gpu_start", "gpu_end")


@query("q128_gpu_zone_stats", f"WITH g AS (SELECT name, gpu_end - gpu_start AS dur FROM gz) SELECT name, {POOLED} FROM g WHERE dur > 0 GROUP BY name", "gz")
def _(spark, sf_dir):
    return fitted(G.statistics(gpu(spark, sf_dir)), "total")


@query("q128_gpu_child_stats", f"WITH g AS (SELECT *, gpu_end - gpu_start AS dur FROM gz) SELECT name, {POOLED} FROM g WHERE dur IS NOT NULL AND parent_id IN (SELECT gpu_zone_id FROM g WHERE name = 'view' AND dur IS NOT NULL) GROUP BY name", "gz")
def _(spark, sf_dir):
    return fitted(G.child_statistics(gpu(spark, sf_dir), "view"), "total")


@query("q128_gpu_occurrences", 'SELECT gpu_start AS start, gpu_end AS "end", gpu_end - gpu_start AS dur FROM gz WHERE name = \'click\' AND gpu_end IS NOT NULL ORDER BY gpu_start, gpu_zone_id', "gz")
def _(spark, sf_dir):
    return G.listing(gpu(spark, sf_dir), "click")


@query("q128_gpu_contexts", "SELECT ctx, count(*) AS zones, count(DISTINCT thread) AS threads, min(gpu_start) AS first FROM gz GROUP BY ctx", "gz")
def _(spark, sf_dir):
    return G.contexts(gpu(spark, sf_dir))


@query("q36_gpu_statistics_view", "SELECT srcloc, name, count(*) AS count, CAST(sum(gpu_end - gpu_start) AS BIGINT) AS total FROM gz WHERE gpu_end > gpu_start GROUP BY srcloc, name", "gz")
def _(spark, sf_dir):
    rows = gpu(spark, sf_dir).where("gpu_end > gpu_start").groupBy("srcloc", "name")
    return fitted(rows.agg(F.count(F.lit(1)).alias("count"), total(F.col("gpu_end") - F.col("gpu_start")).alias("total")), "total")


@query("q40_gpu_children_grouped", "SELECT c.parent_id, c.name, count(*) AS count, CAST(sum(c.gpu_end - c.gpu_start) AS BIGINT) AS time FROM gz c JOIN gz p ON c.parent_id = p.gpu_zone_id WHERE p.gpu_end > p.gpu_start AND c.gpu_end IS NOT NULL GROUP BY 1, 2", "gz")
def _(spark, sf_dir):
    g = gpu(spark, sf_dir)
    parents = g.where("gpu_end > gpu_start").select("capture_id", F.col("gpu_zone_id").alias("parent_id"))
    rows = g.where("gpu_end is not null").join(parents, ["capture_id", "parent_id"], "left_semi")
    return rows.groupBy("parent_id", "name").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("gpu_end") - F.col("gpu_start")).alias("time"))


@query("q129_gpu_drift", "WITH b AS (SELECT *, min(gpu_start) OVER (PARTITION BY ctx) AS g0 FROM gz) SELECT gpu_zone_id, gpu_start + (gpu_start - g0) // 1000000000 * 3 AS start, gpu_end + (gpu_end - g0) // 1000000000 * 3 AS \"end\" FROM b", "gz")
def _(spark, sf_dir):
    return G.drift_corrected(gpu(spark, sf_dir), 3)


# whole traces


@query("q130_trace_counts", "SELECT 'zones' AS \"table\", count(*) AS rows FROM z UNION ALL SELECT 'messages', count(*) FROM ev WHERE event_type = 'signup' UNION ALL SELECT 'plot_points', count(*) FROM ev UNION ALL SELECT 'mem_events', count(*) FROM me UNION ALL SELECT 'lock_events', count(*) FROM lk UNION ALL SELECT 'context_switches', count(*) FROM cs", "z", "me", "lk", "cs")
def _(spark, sf_dir):
    from .resources import mem

    tables = {"zones": A.zones(spark, sf_dir), "messages": A.messages(spark, sf_dir), "plot_points": A.plot_points(spark, sf_dir), "mem_events": mem(spark, sf_dir), "lock_events": A.lock_events(spark, sf_dir), "context_switches": A.context_switches(spark, sf_dir)}
    return T.counts(tables)


@query("q131_capture_metadata", "SELECT min(t) AS first_time, max(t) AS last_time, max(t) - min(t) AS span, strftime(make_timestamp(min(t) // 1000), '%Y-%m-%d %H:%M:%S') AS started FROM ev", "ev")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return e.select("first_time", "last_time", (F.col("last_time") - F.col("first_time")).alias("span"), F.date_format(F.timestamp_micros(F.call_function("div", F.col("first_time"), F.lit(1000))), "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("q132_threads", "SELECT thread, count(*) AS count, coalesce(thread % 5 = 0 AND c_custkey IS NOT NULL, false) AS is_fiber, coalesce(c_name, '???') AS name FROM z LEFT JOIN customer ON c_custkey = thread GROUP BY thread, c_custkey, c_name", "z")
def _(spark, sf_dir):
    return T.threads(A.zones(spark, sf_dir), A.threads(spark, sf_dir))


@query("q140_thread_order", "SELECT c_custkey AS thread, c_nationkey AS group_hint, min(event_id) AS seq FROM customer JOIN ev ON user_id = c_custkey GROUP BY 1, 2 ORDER BY group_hint, seq", "ev")
def _(spark, sf_dir):
    first = A.events(spark, sf_dir).groupBy(F.col("user_id").alias("thread")).agg(F.min("event_id").alias("seq"))
    return T.thread_order(A.threads(spark, sf_dir), first)


CTES["lod"] = (("z",), "lod0 AS (SELECT thread, depth, zone_id AS id, start, stop AS e FROM z WHERE dur IS NOT NULL), lod1 AS (SELECT *, e - start < 600000000000 AS small, start - lag(e) OVER w AS gap, lag(e - start) OVER w AS pd FROM lod0 WINDOW w AS (PARTITION BY thread, depth ORDER BY start, id)), lod2 AS (SELECT *, sum(CASE WHEN small AND coalesce(pd < 600000000000, false) AND gap < 600000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY thread, depth ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS island FROM lod1)")


@query("q133_timeline_lod", 'SELECT thread, depth, min(start) AS start, max(e) AS "end", count(*) AS items FROM lod2 GROUP BY thread, depth, island', "lod")
def _(spark, sf_dir):
    spans = A.zones(spark, sf_dir).where("end is not null").select("thread", "depth", F.col("zone_id").alias("id"), "start", "end")
    return T.folded(spans, ["thread", "depth"], 600_000_000_000).select("thread", "depth", "start", "end", "items")


@query("q134_format", "SELECT srcloc, CASE WHEN line IS NULL OR line = 0 THEN file ELSE file || ':' || line END AS location FROM loc", "loc")
def _(spark, sf_dir):
    return A.source_locations(spark).select("srcloc", P.format_location(F.col("file"), F.col("line")).alias("location"))


_NS = "(event_id % 1000 * 1237 + 5) * CAST(10 ** (event_id % 10) AS BIGINT) * CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END"


def _thousandths(v):
    """SQL: up to two decimals of a number of thousandths."""
    return f"CASE WHEN {v} % 1000 >= 995 THEN CAST({v} // 1000 + 1 AS VARCHAR) WHEN {v} % 1000 <= 5 THEN CAST({v} // 1000 AS VARCHAR) ELSE rtrim(printf('%d.%02d', {v} // 1000, ({v} % 1000 + 5) // 10), '0') END"


_CLOCK = "printf('%02d:%02d', a // 60000000000 % 60, a // 1000000000 % 60)"


@query(
    "q134_time",
    f"""WITH t AS (SELECT event_id AS seq, {_NS} AS ns, abs({_NS}) AS a FROM ev), m AS (SELECT *, a // 1000000 % 60000 AS ms FROM t)
SELECT seq, CASE WHEN ns < 0 THEN '-' ELSE '' END || CASE WHEN a < 1000 THEN a || ' ns' WHEN a < 1000000 THEN {_thousandths('a')} || ' μs' WHEN a < 1000000000 THEN {_thousandths('(a // 1000)')} || ' ms'
  WHEN a < 60000000000 THEN {_thousandths('(a // 1000000)')} || ' s'
  WHEN a < 3600000000000 THEN a // 60000000000 || ':' || CASE WHEN ms % 1000 >= 950 THEN printf('%02d', ms // 1000 + 1) WHEN ms % 1000 > 50 THEN printf('%02d.%d', ms // 1000, (ms % 1000 + 50) // 100) ELSE printf('%02d', ms // 1000) END
  WHEN a < 86400000000000 THEN a // 3600000000000 || ':' || {_CLOCK} ELSE a // 86400000000000 || 'd' || printf('%02d', a // 3600000000000 % 24) || ':' || {_CLOCK} END AS shown FROM m""",
    "ev",
)
def _(spark, sf_dir):
    return _numbers(spark, sf_dir).select("seq", P.format_time(F.col("ns")).alias("shown"))


def _numbers(spark, sf_dir):
    i = F.col("event_id")
    ns = (i % 1000 * 1237 + 5) * F.pow(F.lit(10.0), i % 10).cast("long") * F.when(i % 7 == 0, -1).otherwise(1)
    return A.events(spark, sf_dir).select(i.alias("seq"), ns.alias("ns"))


def _unit(power):
    return f"regexp_replace(printf('%.2f', CAST(n AS DOUBLE) / {1 << 10 * power}), '[.]?0+$', '') || ' {' KMGT'[power]}B'"


_SIZE = f"CASE WHEN abs(n) < 10000 THEN n || ' bytes' WHEN abs(n) < {10_000 << 10} THEN {_unit(1)} WHEN abs(n) < {10_000 << 20} THEN {_unit(2)} WHEN abs(n) < {10_000 << 30} THEN {_unit(3)} ELSE {_unit(4)} END"


@query("q134_bytes", f"WITH t AS (SELECT event_id AS seq, {_NS} AS n FROM ev) SELECT seq, {_SIZE} AS shown, format('{{:,}}', n) AS counted FROM t", "ev")
def _(spark, sf_dir):
    return _numbers(spark, sf_dir).select("seq", P.format_bytes(F.col("ns")).alias("shown"), P.format_count(F.col("ns")).alias("counted"))


@query("q142_crash", "SELECT user_id AS thread, t AS time, props AS message, CASE WHEN k % 2 = 0 THEN CAST(k % 10 AS INTEGER) ELSE 0 END AS callstack FROM ev WHERE event_type = 'error' ORDER BY t DESC, event_id DESC LIMIT 1", "ev")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir).where("event_type = 'error'")
    reports = e.select("capture_id", F.col("event_id").alias("seq"), "time", F.col("user_id").alias("thread"), F.col("props").alias("message"), F.when(F.col("k") % 2 == 0, (F.col("k") % 10).cast("int")).alias("callstack"))
    return T.crash(reports).drop("capture_id")


@query("q135_short_names", "SELECT p_partkey, 'f' || p_size AS short FROM part")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    long = F.concat(F.lit("std::vector<std::pair<int, T<long>>> ns::Cls<A<B>>::f"), F.col("p_size"), F.lit("(int, std::function<void(int)>) const"))
    return part.select("p_partkey", P.short_name(long).alias("short"))


@query("q137_annotations", "SELECT props AS text, t AS start, t + k AS \"end\" FROM ev WHERE event_type = 'signup'", "ev")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir).where("event_type = 'signup'")
    packed = e.select(F.to_json(F.struct(F.col("props").alias("text"), F.col("time").alias("min"), (F.col("time") + F.col("k")).alias("max"))).alias("json"))
    return T.annotations_from_json(packed).select("text", "start", "end")


@query("q138_source_search", "WITH f AS (SELECT p_brand AS file, unnest(list_sort(list(p_name))) AS text, unnest(range(1, count(*) + 1)) AS line FROM part GROUP BY p_brand) SELECT file, line, text FROM f WHERE regexp_matches(text, '1[0-9]*')")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    files = part.groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("content"))
    return T.search(files, "1[0-9]*")


@query("q92_merge_threads", "WITH d AS (SELECT c_mktsegment AS process, CAST(c_nationkey + 100 AS BIGINT) AS pid, c_custkey AS thread, 'worker' || c_custkey % 40 AS name FROM customer) SELECT thread, (pid << 32) | (thread & 4294967295) AS merged_thread, CASE WHEN count(*) OVER (PARTITION BY process, name) > 1 THEN process || '[' || pid || ']/' || name ELSE process || '/' || name END AS display FROM d")
def _(spark, sf_dir):
    t = A.threads(spark, sf_dir)
    dims = t.select(F.col("program").alias("process"), "pid", "thread", F.concat(F.lit("worker"), F.col("thread") % 40).alias("name"))
    return T.merge_threads(dims).select("thread", "merged_thread", "display")


@query("q92_merge_traces", "SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS capture_id, count(*) AS points, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir, split=True)
    one, two = ({"plot_points": e.where(F.col("capture_id") == c).select("capture_id", "event_id", "value")} for c in "AB")
    return T.merge([one, two])["plot_points"].groupBy("capture_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total"))


@query("q93_default_pid", "SELECT c_custkey AS thread, CASE WHEN c_nationkey = 0 THEN 4294836225 ELSE CAST(c_nationkey AS BIGINT) END AS pid FROM customer")
def _(spark, sf_dir):
    return A.threads(spark, sf_dir).select("thread", T.default_pid(F.col("group_hint").cast("long"), 1).alias("pid"))


