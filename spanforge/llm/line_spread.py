"""Line dedup by distinct-site spread.

Each line's key (128 bits of hash) gets a HyperLogLog sketch of the sites (sources) it occurs on, merged by aggregation.
Lines whose estimate is far from the threshold are decided by it; lines near it get exact distinct counts. Lines that occur
on at least ``min_sites`` sites are boilerplate and leave every document. Up to ``LITERALS`` keys go into the plan and texts
are cleaned where they lie; of more, the positions of boilerplate lines are joined to the texts. Either is linear in lines.

Defined results: a null text is empty (one line, nothing removed); a null source is a site of its own; empty lines are
never boilerplate; lines are compared without change; a text of any length or number of lines is cleaned whole; rows that
repeat or share a doc_id are each cleaned; estimates from min_sites * (1 - NEAR) to min_sites * (1 + NEAR) never decide; an
empty table gives an empty result; columns named like a new column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_side, cut

MIN_SITES = 10
#: 2**8 registers: a relative standard error of 6.5 %; the exact count decides within more than four of those.
LG_K, NEAR = 8, 0.3
#: Keys that a plan may hold, as two sets of numbers (80 kB); of more, positions are joined.
LITERALS = 5_000


def line_key(line: Column | str) -> list[Column]:
    """Two hashes with different seeds name a line."""
    return [F.xxhash64(line), F.xxhash64(line, F.lit(1))]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, site, position and key of every line that isn't empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"), F.coalesce("source", F.lit("\0")).alias("site"))
    cut_up = rows.select("doc_id", "digest", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))  # the digest is made once a text
    a, b = line_key("line")
    return cut_up.where("line <> ''").select("doc_id", "digest", "site", "at", a.alias("key"), b.alias("key2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (``key``, ``key2``) of the lines that occur on at least ``min_sites`` sites."""
    own = ["key", "key2"]
    lines = _lines(docs).select(*own, "site")
    spread = lines.groupBy(*own).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    wide = cut(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "line-spread")
    near = bounded_side(wide.where(F.col("sites") <= min_sites * (1 + NEAR)).select(*own))
    exact = lines.join(near, own, "left_semi").groupBy(*own).agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return wide.where(F.col("sites") > min_sites * (1 + NEAR)).select(*own).unionByName(exact.select(*own))


def _cleaned(docs: DataFrame, found: DataFrame, literals: int) -> DataFrame:
    """``docs`` with _sf_lines (all lines of the text) and _sf_kept (those that stay)."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("_sf_lines", F.split(text, "\n"))
    few = found.limit(literals + 1).collect()  # at most so many pairs of numbers
    if len(few) <= literals:
        if not few:
            return split.withColumn("_sf_kept", F.col("_sf_lines"))
        sets = [",".join(f"{r[i]}L" if r[i] > -(1 << 63) else "-9223372036854775807L - 1L" for r in few) for i in (0, 1)]
        barred = f"(xxhash64(x) in ({sets[0]}) and xxhash64(x, 1) in ({sets[1]}) and x <> '')"
        return split.withColumn("_sf_kept", F.expr(f"filter(_sf_lines, x -> not {barred})"))
    hits = _lines(docs).join(bounded_side(found), ["key", "key2"], "left_semi").groupBy(F.col("doc_id").alias("_sf_id"), F.col("digest").alias("_sf_digest")).agg(F.collect_set("at").alias("_sf_gone"))
    joined = split.withColumn("_sf_own", F.xxhash64(text)).join(hits, F.col("doc_id").eqNullSafe(F.col("_sf_id")) & (F.col("_sf_own") == F.col("_sf_digest")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_sf_lines") - 1), F.coalesce("_sf_gone", F.array().cast("array<int>")))
    return joined.withColumn("_sf_kept", F.transform(stay, lambda i: F.get("_sf_lines", i))).drop("_sf_id", "_sf_own", "_sf_digest", "_sf_gone")


def clean(docs: DataFrame, min_sites: int = MIN_SITES, literals: int = LITERALS) -> DataFrame:
    """``docs`` with ``text`` without boilerplate lines, ``n_lines`` and ``n_removed``."""
    found = cut(boilerplate(docs, min_sites), "line-boilerplate")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return _cleaned(docs, found, literals).select(
        *others,
        F.array_join("_sf_kept", "\n").alias("text"),
        F.size("_sf_lines").cast("long").alias("n_lines"),
        (F.size("_sf_lines") - F.size("_sf_kept")).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and digest of the cleaned text of every row."""
    return clean(docs.select("doc_id", "source", "text"), min_sites).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def oracle(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
j AS (SELECT r, doc_id, k, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256
FROM j GROUP BY r, doc_id"""
