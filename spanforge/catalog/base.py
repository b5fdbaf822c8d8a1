"""Registry of queries: a Spark query and, where SQL can express it, the same in DuckDB SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_EV = "ev AS (SELECT event_id, epoch_us(ts) * 1000 AS t, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
#: Common table expressions, each with those it needs.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), _EV),
    "be": (("ev",), """be AS (SELECT event_id, t, user_id AS thread, event_type, props, k, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS d FROM ev WHERE event_type IN ('view', 'click', 'purchase', 'error')),
be1 AS (SELECT *, sum(d) OVER (PARTITION BY thread ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM be),
be2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY thread ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)) AS dep FROM be1),
be3 AS (SELECT *, CASE WHEN d = 1 THEN dep ELSE coalesce(lag(dep) OVER (PARTITION BY thread ORDER BY t, event_id), 0) END AS lvl FROM be2),
be4 AS (SELECT * FROM be3 WHERE lvl > 0),
be5 AS (SELECT *, lead(d) OVER (PARTITION BY thread, lvl ORDER BY t, event_id) AS nd, lead(t) OVER (PARTITION BY thread, lvl ORDER BY t, event_id) AS nt, lead(event_id) OVER (PARTITION BY thread, lvl ORDER BY t, event_id) AS ne FROM be4)"""),
    "z": (("be",), """zb AS (SELECT event_id AS zone_id, thread, event_type AS kind, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS srcloc, t AS start, CASE WHEN nd = -1 THEN nt END AS stop, CASE WHEN nd = -1 THEN ne END AS stop_seq, CAST(lvl - 1 AS INTEGER) AS depth, props AS text, CAST(k % 10 AS INTEGER) AS callstack FROM be5 WHERE d = 1),
zp AS (SELECT c.zone_id, max(p.zone_id) FILTER (p.zone_id IS NOT NULL) AS parent_id FROM zb c LEFT JOIN zb p ON p.thread = c.thread AND p.depth = c.depth - 1 AND (p.start, p.zone_id) < (c.start, c.zone_id) AND (p.stop IS NULL OR (p.stop, p.stop_seq) > (c.start, c.zone_id)) GROUP BY c.zone_id),
z AS (SELECT zb.*, parent_id, stop - start AS dur, CASE srcloc WHEN 1 THEN 'click' ELSE 'view' END AS name FROM zb JOIN zp USING (zone_id))"""),
    "zr": (("z",), """ze AS (SELECT thread, srcloc, zone_id, start AS t, zone_id AS q, 1 AS d FROM z UNION ALL SELECT thread, srcloc, zone_id, stop, stop_seq, -1 FROM z WHERE stop IS NOT NULL),
zf AS (SELECT zone_id, d, sum(d) OVER (PARTITION BY thread, srcloc ORDER BY t, q ROWS UNBOUNDED PRECEDING) AS n FROM ze),
zr AS (SELECT z.*, n > 1 AS reentrant FROM z JOIN zf ON z.zone_id = zf.zone_id AND d = 1)"""),
    "zs": (("zr",), """zc AS (SELECT parent_id, sum(greatest(dur, 0)) AS below FROM z WHERE dur IS NOT NULL AND parent_id IS NOT NULL GROUP BY parent_id),
zs AS (SELECT zr.*, CAST(dur - coalesce(below, 0) AS BIGINT) AS self_time FROM zr LEFT JOIN zc ON zr.zone_id = zc.parent_id)"""),
    "lastt": (("ev",), "lastt AS (SELECT max(t) AS last_time FROM ev)"),
    "loc": ((), "loc AS (SELECT * FROM (VALUES (1, NULL, 'click', 'src/click.cpp', 10), (2, 'view', 'render_view', 'src/view.cpp', 20), (3, 'idle', 'idle', 'src/idle.cpp', 30)) AS v(srcloc, name, function, file, line))"),
    "fr": (("ev",), """fr0 AS (SELECT CAST(row_number() OVER (ORDER BY t, event_id) - 1 AS BIGINT) AS idx, t AS start FROM ev WHERE event_type = 'signup'),
fr AS (SELECT idx, start, coalesce(lead(start) OVER (ORDER BY idx), (SELECT max(t) FROM ev)) AS stop FROM fr0)"""),
    "mo": (("ev",), """mo0 AS (SELECT *, 'pool' || CAST(user_id % 4 AS VARCHAR) AS pool, user_id * 1000 + k AS ptr FROM ev),
mo AS (SELECT pool, ptr, event_id AS seq, t AS time, row_number() OVER (PARTITION BY pool, ptr ORDER BY t, event_id) % 2 = 1 AS alloc, CAST(floor(value * 100) AS BIGINT) + 1 AS size, user_id AS thread, CAST(k % 10 AS INTEGER) AS callstack FROM mo0)"""),
    "me": (("mo",), """me AS (SELECT pool, ptr, size, seq AS alloc_id, time AS time_alloc, thread AS thread_alloc, callstack AS cs_alloc, time_free, thread_free FROM
(SELECT *, lead(time) OVER w AS time_free, lead(thread) OVER w AS thread_free FROM mo WINDOW w AS (PARTITION BY pool, ptr ORDER BY time, seq)) WHERE alloc)"""),
    "lk": (("ev",), """lk AS (SELECT CAST(k % 8 AS INTEGER) AS lock_id, event_id AS seq, t AS time, user_id AS thread,
['Wait', 'Obtain', 'Release'][CAST((row_number() OVER (PARTITION BY k % 8, user_id ORDER BY t, event_id) - 1) % 3 + 1 AS INTEGER)] AS type FROM ev)"""),
    "cs": (("ev",), """cs AS (SELECT CAST(event_id % 8 AS INTEGER) AS cpu, event_id AS seq, t AS start, lead(t) OVER (PARTITION BY event_id % 8 ORDER BY t, event_id) AS stop, user_id AS thread, CAST(event_id % 40 AS INTEGER) AS reason, CAST(event_id % 12 AS INTEGER) AS state FROM ev)"""),
    "st": (("ev",), "st AS (SELECT user_id AS thread, event_id AS seq, t AS time, [k, 1000 + k // 10, 2000 + CAST(length(event_type) AS BIGINT)] AS frames FROM ev)"),
    "gz": (("z",), "gz AS (SELECT zone_id AS gpu_zone_id, CAST(thread % 4 AS INTEGER) AS ctx, thread, srcloc, name, start AS cpu_start, stop AS cpu_end, start + 500 + zone_id % 1000 * 10 AS gpu_start, stop + 700 + zone_id % 1000 * 10 AS gpu_end, depth, parent_id FROM z)"),
}


def sql(body: str, *needs: str) -> str:
    """``body`` with the common table expressions that it needs, in order."""
    done: list[str] = []

    def need(name: str) -> None:
        if name not in done:
            for x in CTES[name][0]:
                need(x)
            done.append(name)

    for n in needs:
        need(n)
    body = body.strip()
    heads = [CTES[n][1] for n in done]
    if body.upper().startswith("WITH "):
        heads, body = [*heads, body[5:]], ""
        return "WITH " + ",\n".join(heads)
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def query(name: str, oracle: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``oracle`` is its SQL after the expressions it needs."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, *needs)
        return f

    return register
