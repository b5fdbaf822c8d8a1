"""Mixing sources to target weights.

Words are summed per source; targets follow the weights, capped at ``max_rate`` times the source (water filling); each
document is taken floor(rate) times and once more with the probability of the fraction, drawn from a hash of the seed
and doc_id, so that reruns agree.

Defined results: a null text has size 0; a null source is a source, sorted last; a null doc_id draws as the string
'null'; rows with the same doc_id draw alike; without any words all targets are 0; an empty table gives an empty result;
columns of ``docs`` named like a new column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"
#: Sources up to this many are broadcast, if their names together stay under the bytes; more are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 8 << 20


def _ranked(sources: DataFrame) -> DataFrame:
    """Position of each source by code point, null last, without one task for all: ranks within ranges plus offsets."""
    parts = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    last = F.col("source").isNull()
    dealt = sources.repartitionByRange(int(parts), last, F.col("source")).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt, "mix-sources")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # a row per partition
    starts, total = {}, 0
    for part, count in sizes:
        starts[part] = total
        total += count
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("part")] if starts else F.lit(0)
    at = F.row_number().over(Window.partitionBy("part").orderBy(last, "source"))
    return dealt.withColumn("rank", (start + at - 1).cast("long")).drop("part")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, rank, weight, target of every source."""
    sized = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(sized)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked.withColumn("weight", weight.cast("long")), "mix-weights")
    cap = F.col("source_size") * max_rate
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rest, share, capped = total, 0, -1
    # each round caps what would pass its cap at the present share; the share of the others only grows
    while True:
        over = F.lit(False) if capped < 0 else cap < F.col("weight") * F.lit(float(rest)) / F.lit(float(share))
        row = table.agg(
            F.sum(F.when(over, cap)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("share"), F.count(F.when(over, 1)).alias("n")
        ).first()
        rest, share = total - (row["taken"] or 0), row["share"] or 1
        if row["n"] == capped:
            break
        capped = row["n"]
    free = F.col("weight") * F.lit(float(rest)) / F.lit(float(share))
    return table.withColumn("target", F.when(cap < free, cap.cast("double")).otherwise(free))


def _taken(docs: DataFrame, weights: tuple[int, ...], max_rate: int, seed: str) -> DataFrame:
    """``docs`` with _sf_size, _sf_source_size, _sf_target and _sf_copies. Texts are neither shuffled nor copied where the
    sources fit a broadcast of checked size."""
    sized = docs.withColumn("_sf_size", word_count(F.col("text")))
    table = targets(sized.select("source", F.col("_sf_size").alias("size")), weights, max_rate)
    few = table.limit(BROADCAST_SOURCES + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    side = table.select(F.col("source").alias("_sf_source"), F.col("source_size").alias("_sf_source_size"), F.col("target").alias("_sf_target"))
    if few[0] <= BROADCAST_SOURCES and few[1] <= BROADCAST_BYTES:
        side = F.broadcast(side)
    rate = F.when(F.col("_sf_source_size") > 0, F.col("_sf_target") / F.col("_sf_source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10)
    whole = F.floor(rate)
    extra = F.when(draw.cast("double") / float(1 << 52) < rate - whole, 1).otherwise(0)
    return sized.join(side, F.col("source").eqNullSafe(F.col("_sf_source"))).withColumn("_sf_copies", (whole + extra).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken."""
    new = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in (*new, "taken")]
    rows = _taken(docs, weights, max_rate, seed)
    return rows.select(*kept, *[F.col(f"_sf_{c}").alias(c) for c in new], (F.col("_sf_size") * F.col("_sf_copies")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    copies = F.explode(F.sequence(F.lit(1), F.col("_sf_copies"))).alias("_sf_copy")
    return _taken(docs, weights, max_rate, seed).where("_sf_copies > 0").select(*docs.columns, copies).drop("_sf_copy")


def oracle(seed: str = SEED) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size::DOUBLE / weight, source_size) AS k FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
  CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM o),
f AS (SELECT rest, share FROM c WHERE 3 * source_size >= weight * rest / share ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size < weight * f.rest / f.share THEN CAST(3 * source_size AS DOUBLE) ELSE weight * f.rest / f.share END AS target FROM s, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
