"""Queries on memory, locks and scheduling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cpu as C
from ..operators import locks as L
from ..operators import memory as M
from ..sources import adapters as A
from .base import CTES, query
from .zones import DAY, SINCE, UNTIL, zones


def mem(spark, sf_dir):
    return M.pair(A.mem_ops(spark, sf_dir))


@query("q79_alloc_pairing", "SELECT pool, ptr, size, time_alloc, time_free, thread_alloc, thread_free FROM me", "me")
def _(spark, sf_dir):
    return mem(spark, sf_dir).select("pool", "ptr", "size", "time_alloc", "time_free", "thread_alloc", "thread_free")


@query("q79_anomalies", "WITH o AS (SELECT *, lag(seq % 3 > 0) OVER (PARTITION BY pool, ptr ORDER BY time, seq) AS b FROM mo) SELECT seq, CASE WHEN seq % 3 > 0 THEN 'allocated twice' ELSE 'unknown free' END AS anomaly FROM o WHERE (seq % 3 > 0 AND b) OR (seq % 3 = 0 AND ptr <> 0 AND (b IS NULL OR NOT b))", "mo")
def _(spark, sf_dir):
    ops = A.mem_ops(spark, sf_dir).withColumn("kind", F.when(F.col("seq") % 3 > 0, "alloc").otherwise("free"))
    return M.anomalies(ops).select("seq", "anomaly")


@query("q80_discard", "WITH d AS (SELECT 'pool' || CAST(user_id % 4 AS VARCHAR) AS pool, t FROM ev WHERE event_type = 'signup') SELECT alloc_id, least(time_free, (SELECT min(t) FROM d WHERE d.pool = me.pool AND d.t >= time_alloc)) AS time_free FROM me", "me")
def _(spark, sf_dir):
    d = A.events(spark, sf_dir).where("event_type = 'signup'").select("capture_id", F.concat(F.lit("pool"), F.col("user_id") % 4).alias("pool"), "time")
    return M.discard(mem(spark, sf_dir), d).select("alloc_id", "time_free")


@query("q81_memory_pools", "SELECT pool, min(ptr) AS low, max(ptr + size) AS high, CAST(coalesce(sum(size) FILTER (time_free IS NULL), 0) AS BIGINT) AS usage, count(*) AS alloc_count, count(*) FILTER (time_free IS NULL) AS active_count FROM me GROUP BY pool", "me")
def _(spark, sf_dir):
    return M.pools(mem(spark, sf_dir))


@query("q82_memory_usage", "WITH e AS (SELECT pool, time_alloc AS time, 1 AS side, alloc_id AS seq, size AS d FROM me UNION ALL SELECT pool, time_free, 0, alloc_id, -size FROM me WHERE time_free IS NOT NULL) SELECT pool, time, side, seq, CAST(sum(d) OVER (PARTITION BY pool ORDER BY time, side, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS usage FROM e", "me")
def _(spark, sf_dir):
    return M.usage(mem(spark, sf_dir))


@query("q83_memory_events", "SELECT alloc_id, pool, ptr, size FROM me ORDER BY alloc_id", "me")
def _(spark, sf_dir):
    return M.listing(mem(spark, sf_dir)).select("alloc_id", "pool", "ptr", "size")


@query("q84_active_allocations", f"SELECT alloc_id, size FROM me WHERE time_alloc >= {SINCE} AND time_alloc < {UNTIL} AND (time_free IS NULL OR time_free >= {UNTIL})", "me")
def _(spark, sf_dir):
    return M.active_in(mem(spark, sf_dir), SINCE, UNTIL).select("alloc_id", "size")


@query("q85_alloc_at_address", "SELECT alloc_id, ptr, size FROM me WHERE ptr <= 8050 AND ptr + size > 8050", "me")
def _(spark, sf_dir):
    return M.at_address(mem(spark, sf_dir), 8050).select("alloc_id", "ptr", "size")


@query("q86_zone_memory", "WITH e AS (SELECT thread_alloc AS thread, time_alloc AS t, size AS d FROM me UNION ALL SELECT thread_free, time_free, -size FROM me WHERE time_free IS NOT NULL) SELECT zone_id, count(*) FILTER (d > 0) AS allocs, count(*) FILTER (d < 0) AS frees, CAST(sum(d) AS BIGINT) AS change FROM e JOIN z ON e.thread = z.thread AND z.start <= t AND t < z.stop GROUP BY zone_id", "me", "z")
def _(spark, sf_dir):
    return M.per_zone(mem(spark, sf_dir), zones(spark, sf_dir))


_NOW = SINCE + 40 * DAY


@query("q87_memory_map", f"WITH e AS (SELECT pool, coalesce(time_free, time_alloc) AS w, alloc_id, CASE WHEN time_free IS NULL THEN greatest(1, 127 - (({_NOW} - time_alloc) >> 24)) ELSE -greatest(1, 127 - (({_NOW} - time_free) >> 24)) END AS v, unnest(range(ptr // 4096, (ptr + size - 1) // 4096 + 1)) AS chunk FROM me) SELECT pool, chunk, CAST(arg_max(v, (w, alloc_id)) AS INTEGER) AS value FROM e GROUP BY pool, chunk", "me")
def _(spark, sf_dir):
    return M.page_map(mem(spark, sf_dir), 4096, _NOW)


@query("q88_alloc_zones", "SELECT alloc_id, arg_max(zone_id, depth) AS zone_id FROM me JOIN z ON me.thread_alloc = z.thread AND z.start <= time_alloc AND time_alloc < z.stop GROUP BY alloc_id", "me", "z")
def _(spark, sf_dir):
    return M.zone_of_alloc(mem(spark, sf_dir), zones(spark, sf_dir))


for _which, _cond in (("full", "true"), ("active", "time_free IS NULL"), ("inactive", "time_free IS NOT NULL")):

    @query(f"q89_callstack_memory_{_which}", f"SELECT cs_alloc AS callstack, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM me WHERE cs_alloc <> 0 AND {_cond} GROUP BY cs_alloc", "me")
    def _(spark, sf_dir, which=_which):
        return M.by_callstack(mem(spark, sf_dir), which)


CTES["mw"] = (("me",), "mw AS (SELECT cs_alloc AS callstack, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes, [CAST(cs_alloc AS BIGINT), CAST(100 + cs_alloc % 3 AS BIGINT), CAST(200 AS BIGINT)] AS frames FROM me WHERE cs_alloc <> 0 GROUP BY cs_alloc)")
for _dir, _expr in (("bottom_up", "list_reverse(frames)"), ("top_down", "frames")):

    @query(f"q90_allocation_tree_{_dir}", f"WITH p AS (SELECT {_expr} AS f, count, bytes, unnest([1, 2, 3]) AS n FROM mw) SELECT array_to_string(f[1:n], '/') AS path, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1", "mw")
    def _(spark, sf_dir, up=_dir == "bottom_up"):
        weights = M.by_callstack(mem(spark, sf_dir))
        stacks = weights.select("callstack", F.array(F.col("callstack").cast("long"), (F.lit(100) + F.col("callstack") % 3).cast("long"), F.lit(200).cast("long")).alias("frames"))
        return M.call_tree(weights, stacks, up, ["count", "bytes"])


# locks

_LS = "ls AS (SELECT *, sum(CASE type WHEN 'Wait' THEN 1 WHEN 'Obtain' THEN -1 ELSE 0 END) OVER w AS waiting, sum(CASE type WHEN 'Obtain' THEN 1 WHEN 'Release' THEN -1 ELSE 0 END) OVER w AS holding, lead(time) OVER (PARTITION BY lock_id ORDER BY time, seq) AS until FROM lk WINDOW w AS (PARTITION BY lock_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING))"
CTES["ls"] = (("lk",), _LS)


@query("q91a_lock_states", "SELECT seq, CAST(waiting AS BIGINT) AS waiting, CAST(holding AS BIGINT) AS holding, holding <> 0 AND waiting <> 0 AS contended FROM ls", "ls")
def _(spark, sf_dir):
    return L.states(A.lock_events(spark, sf_dir)).select("seq", "waiting", "holding", "contended")


def shared_events(spark, sf_dir):
    """Threads with even numbers take the lock shared."""
    e = A.lock_events(spark, sf_dir)
    return e.withColumn("type", F.when(F.col("thread") % 2 == 0, F.concat("type", F.lit("Shared"))).otherwise(F.col("type")))


@query(
    "q91b_shared_lock_states",
    """WITH e AS (SELECT *, thread % 2 = 0 AS sh FROM lk), s AS (SELECT seq, sum(CASE WHEN sh THEN 0 WHEN type = 'Wait' THEN 1 WHEN type = 'Obtain' THEN -1 ELSE 0 END) OVER w AS w1, sum(CASE WHEN sh THEN 0 WHEN type = 'Obtain' THEN 1 WHEN type = 'Release' THEN -1 ELSE 0 END) OVER w AS h1,
sum(CASE WHEN NOT sh THEN 0 WHEN type = 'Wait' THEN 1 WHEN type = 'Obtain' THEN -1 ELSE 0 END) OVER w AS w2, sum(CASE WHEN NOT sh THEN 0 WHEN type = 'Obtain' THEN 1 WHEN type = 'Release' THEN -1 ELSE 0 END) OVER w AS h2 FROM e WINDOW w AS (PARTITION BY lock_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CAST(w1 AS BIGINT) AS waiting, CAST(h1 AS BIGINT) AS holding, CAST(w2 AS BIGINT) AS waiting_shared, CAST(h2 AS BIGINT) AS sharing, (h1 <> 0 AND w1 + w2 <> 0) OR (h2 <> 0 AND w1 <> 0) AS contended FROM s""",
    "lk",
)
def _(spark, sf_dir):
    return L.states(shared_events(spark, sf_dir)).select("seq", "waiting", "holding", "waiting_shared", "sharing", "contended")


_SUM = "SELECT lock_id, bool_or(holding <> 0 AND waiting <> 0) AS contended, count(DISTINCT thread) AS threads, count(*) AS events, min(time) AS announce, max(time) AS terminate FROM ls GROUP BY lock_id"


@query("q91c_locks", _SUM, "ls")
def _(spark, sf_dir):
    return L.summary(A.lock_events(spark, sf_dir))


@query("q91d_lock_wait_stats", "WITH p AS (SELECT lock_id, type, time, lag(type) OVER w AS pt, lag(time) OVER w AS pq FROM lk WHERE type IN ('Wait', 'Obtain') WINDOW w AS (PARTITION BY lock_id, thread ORDER BY time, seq)) SELECT lock_id, CAST(sum(time - pq) AS BIGINT) AS total, CAST(sum(time - pq) AS DOUBLE) / count(*) AS avg, count(*) AS count, 'lock ' || lock_id AS name, (SELECT string_agg(thread, ',' ORDER BY f, q) FROM (SELECT lock_id AS l, thread, arg_min(time, (time, seq)) AS f, arg_min(seq, (time, seq)) AS q FROM lk GROUP BY lock_id, thread) WHERE l = lock_id) AS threads FROM p WHERE type = 'Obtain' AND pt = 'Wait' AND lock_id IN (SELECT lock_id FROM ls WHERE holding <> 0 AND waiting <> 0) GROUP BY lock_id", "ls")
def _(spark, sf_dir):
    locks = spark.range(8).select(F.lit(A.CAPTURE).alias("capture_id"), F.col("id").cast("int").alias("lock_id"), F.concat(F.lit("lock "), "id").alias("name"))
    stats = L.wait_stats(A.lock_events(spark, sf_dir), locks)
    return stats.withColumn("threads", F.array_join(F.transform("threads", lambda x: x.cast("string")), ","))


@query("q91e_lock_info", "SELECT lock_id, CAST(coalesce(sum(until - time) FILTER (holding <> 0), 0) AS BIGINT) AS hold_time, CAST(coalesce(sum(until - time) FILTER (waiting <> 0), 0) AS BIGINT) AS wait_time, CAST(max(waiting) AS BIGINT) AS max_waiters, max(time) - min(time) AS lifetime FROM ls GROUP BY lock_id", "ls")
def _(spark, sf_dir):
    return L.info(A.lock_events(spark, sf_dir))


@query("q91f_thread_lock_states", "WITH p AS (SELECT *, lead(time) OVER (PARTITION BY lock_id, thread ORDER BY time, seq) AS u FROM lk) SELECT lock_id, thread, seq, CASE type WHEN 'Wait' THEN 'wait' ELSE 'has' END AS state, time AS start, u AS \"end\" FROM p WHERE type <> 'Release' AND u > time", "lk")
def _(spark, sf_dir):
    return L.thread_states(A.lock_events(spark, sf_dir)).select("lock_id", "thread", "seq", "state", "start", "end")


@query("q91g_contended_locks", f"SELECT * FROM ({_SUM}) WHERE contended AND threads >= 2", "ls")
def _(spark, sf_dir):
    return L.contended_only(A.lock_events(spark, sf_dir))


# scheduling


@query("q94_switch_intervals", 'SELECT cpu, seq, start, stop AS "end", thread FROM cs WHERE thread <> 0', "cs")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    switches = e.select("capture_id", (F.col("event_id") % 8).cast("int").alias("cpu"), F.col("event_id").alias("seq"), "time", F.col("user_id").alias("new_thread"), F.lit(0).alias("reason"), F.lit(0).alias("state"))
    return C.intervals(switches)[0].select("cpu", "seq", "start", "end", "thread")


@query("q94_wakeups", "SELECT cs.seq, w.t AS wakeup, CAST(w.k % 8 AS INTEGER) AS wakeup_cpu FROM cs ASOF LEFT JOIN (SELECT user_id, t, k FROM ev WHERE event_type = 'signup') w ON cs.thread = w.user_id AND cs.start >= w.t WHERE cs.thread <> 0", "cs")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    switches = e.select("capture_id", (F.col("event_id") % 8).cast("int").alias("cpu"), F.col("event_id").alias("seq"), "time", F.col("user_id").alias("new_thread"), F.lit(0).alias("reason"), F.lit(0).alias("state"))
    wakeups = e.where("event_type = 'signup'").select("capture_id", F.col("user_id").alias("thread"), "time", (F.col("k") % 8).cast("int").alias("cpu"))
    return C.intervals(switches, wakeups)[1].select("seq", "wakeup", "wakeup_cpu")


@query("q95_thread_switches", 'SELECT start, stop AS "end", cpu, reason, state FROM cs WHERE thread = 3 AND stop IS NOT NULL ORDER BY start, seq', "cs")
def _(spark, sf_dir):
    return C.thread_switches(A.context_switches(spark, sf_dir), 3).select("start", "end", "cpu", "reason", "state")


_TD = "td AS (SELECT thread, CAST(coalesce(sum(stop - start), 0) AS BIGINT) AS running_time, count(*) AS regions, count(*) FILTER (cpu <> b) AS migrations FROM (SELECT *, lag(cpu) OVER (PARTITION BY thread ORDER BY start, seq) AS b FROM cs) GROUP BY thread)"
CTES["td"] = (("cs",), _TD)


@query("q96_cpu_thread_data", "SELECT * FROM td", "td")
def _(spark, sf_dir):
    return C.thread_data(A.context_switches(spark, sf_dir))


@query("q97_process_rollup", "WITH p AS (SELECT coalesce(c_nationkey + 100, 0) AS pid, CAST(sum(running_time) AS BIGINT) AS running_time, CAST(sum(regions) AS BIGINT) AS regions, CAST(sum(migrations) AS BIGINT) AS migrations FROM td LEFT JOIN customer ON c_custkey = thread GROUP BY 1) SELECT CAST(pid AS BIGINT) AS pid, running_time, regions, migrations, running_time * 100.0::DOUBLE / CAST(sum(running_time) OVER () AS BIGINT) AS running_time_share, regions * 100.0::DOUBLE / CAST(sum(regions) OVER () AS BIGINT) AS regions_share, migrations * 100.0::DOUBLE / CAST(sum(migrations) OVER () AS BIGINT) AS migrations_share FROM p", "td")
def _(spark, sf_dir):
    return C.process_rollup(C.thread_data(A.context_switches(spark, sf_dir)), A.threads(spark, sf_dir).select("thread", "pid"))


CTES["cu"] = (("cs",), "cu0 AS (SELECT start AS t, thread % 2 = 0 AS o, 1 AS d FROM cs WHERE stop IS NOT NULL UNION ALL SELECT stop, thread % 2 = 0, -1 FROM cs WHERE stop IS NOT NULL), cu1 AS (SELECT t, sum(d) FILTER (o) AS od, sum(d) FILTER (NOT o) AS xd FROM cu0 GROUP BY t), cu AS (SELECT t AS time, CAST(sum(coalesce(od, 0)) OVER (ORDER BY t) AS BIGINT) AS own, CAST(sum(coalesce(xd, 0)) OVER (ORDER BY t) AS BIGINT) AS other, od, xd FROM cu1)")


@query("q98_cpu_usage", "SELECT time, own, other FROM cu WHERE coalesce(od, 0) <> 0 OR coalesce(xd, 0) <> 0", "cu")
def _(spark, sf_dir):
    return C.usage(A.context_switches(spark, sf_dir), F.col("thread") % 2 == 0).select("time", "own", "other")


@query("q99_cpu_usage_resampled", f"WITH p AS (SELECT {SINCE} + i * {DAY // 4} AS time FROM (SELECT unnest(range(40)) AS i)) SELECT p.time, cu.own, cu.other FROM p ASOF LEFT JOIN cu ON p.time >= cu.time", "cu")
def _(spark, sf_dir):
    times = spark.range(40).select(F.lit(A.CAPTURE).alias("capture_id"), (F.lit(SINCE) + F.col("id") * (DAY // 4)).alias("time"))
    return C.usage_at(C.usage(A.context_switches(spark, sf_dir), F.col("thread") % 2 == 0), times).select("time", "own", "other")


@query("q100_thread_migrations", "WITH p AS (SELECT cpu, lead(cpu) OVER (PARTITION BY thread ORDER BY start, seq) AS n FROM cs) SELECT cpu AS from_cpu, n AS to_cpu, count(*) AS moves FROM p WHERE n <> cpu GROUP BY 1, 2", "cs")
def _(spark, sf_dir):
    return C.migrations(A.context_switches(spark, sf_dir))


@query("q101_wait_stacks", f"SELECT CAST(k % 10 AS INTEGER) AS callstack, count(*) AS count FROM ev WHERE t >= {SINCE} AND t < {UNTIL} AND user_id IN (1, 2, 3, 4, 5) GROUP BY 1", "ev")
def _(spark, sf_dir):
    s = A.events(spark, sf_dir).select(F.col("user_id").alias("thread"), "time", (F.col("k") % 10).cast("int").alias("callstack"))
    return C.wait_stacks(s, SINCE, UNTIL, [1, 2, 3, 4, 5])


@query("q102_state_names", "SELECT seq, CASE state WHEN 0 THEN 'Initialized' WHEN 1 THEN 'Ready' WHEN 2 THEN 'Running' WHEN 3 THEN 'Standby' WHEN 4 THEN 'Terminated' WHEN 5 THEN 'Waiting' WHEN 6 THEN 'Transition' WHEN 7 THEN 'DeferredReady' ELSE 'Unknown' END AS state_name FROM cs", "cs")
def _(spark, sf_dir):
    return A.context_switches(spark, sf_dir).select("seq", C.state_name(F.col("state")).alias("state_name"))


@query("q103_fibers", 'WITH f AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS u FROM ev WHERE event_type IN (\'view\', \'error\')) SELECT CAST(4294967296 + k % 5 AS BIGINT) AS thread, user_id AS carrier, event_id AS seq, t AS start, u AS "end", 99 AS reason FROM f WHERE event_type = \'view\'', "ev")
def _(spark, sf_dir):
    return C.fibers(A.fiber_events(spark, sf_dir)).select("thread", "carrier", "seq", "start", "end", "reason")


@query("q144_first_pid", "SELECT user_id AS tid, arg_min(k, event_id) AS pid FROM ev GROUP BY user_id", "ev")
def _(spark, sf_dir):
    return C.first_pid(A.events(spark, sf_dir).select(F.col("user_id").alias("tid"), F.col("k").alias("pid"), F.col("event_id").alias("seq")))


@query("q145_cpu_topology", "SELECT cpu // 4 AS package, cpu // 2 AS core, count(*) AS runs FROM cs GROUP BY 1, 2", "cs")
def _(spark, sf_dir):
    topology = spark.range(8).select(F.col("id").cast("int").alias("cpu"), F.floor(F.col("id") / 4).cast("int").alias("package"), F.floor(F.col("id") / 2).cast("int").alias("core"))
    return A.context_switches(spark, sf_dir).join(topology, "cpu").groupBy("package", "core").agg(F.count(F.lit(1)).alias("runs"))
