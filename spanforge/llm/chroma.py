"""Media columns: chroma audio fingerprints.

A recording (8-bit mono samples) is cut into overlapping frames; a frame's spectrum is folded onto the twelve pitch
classes. Filters over an integral image of the pitch-class frames compare areas of pitch and time; each gives two bits,
Gray-coded, and sixteen filters pack one integer per position. Recordings are aligned by the histogram of offsets between
equal pairs of neighbouring integers; the best offset is rated by its bit errors.

Frames are short, so that a change in a recording spoils few codes: those of the nine hops around it.

Two recordings match where MIN_VOTES places of equal pairs of codes vote for one offset and at most MAX_ERROR of the bits
differ there, whichever of the voted offsets that is. Queries are held against all recordings that share enough pairs of codes,
so that the search loses no match. Equal recordings are one class and aren't expanded into pairs; each match between a query
class and another class is rated. The result is a row per recording with its component (what matches with queries lead to),
the number of its matches and the best one.

Defined results: a recording that is shorter than a filter's window is followed by silence, so that it has a code for each
HOP samples begun; null and empty recordings have no codes and no match, and a recording with one code (of at most HOP
samples) has no pair of codes and so no match beyond its class; recordings with equal fingerprints (those without codes too)
form a class, named by its smallest id (null only where all its ids are null), whatever ids repeat; queries are the classes
that have an id divisible by ``every``; of several matches of a class the one with the fewest bit errors,
then the most votes, then the smallest name is shown; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_side, cut, cut_to, drop_tables, is_broadcast, short_batches, trimmed
from .components import components

#: Samples a second, of a frame, and between the starts of frames.
RATE, FRAME, HOP = 2000, 64, 32
LOWEST, HIGHEST = 55.0, 1000.0
WIDTH = 8  # frames that a filter sees
EVERY = 20
MIN_VOTES = 2
MAX_ERROR = 0.35
#: Codes of queries are broadcast up to so many bytes.
QUERY_BYTES = 32 << 20


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters: kinds in turn over shifted areas."""
    return [(k % 5, (5 * k) % (12 - 4 - 2 * (k % 3)), 4 + 2 * (k % 3), WIDTH if k % 2 else WIDTH // 2) for k in range(16)]


FILTERS = _filters()
#: Quantisation of a filter's log ratio into four steps, Gray-coded.
STEPS = np.array([-0.08, 0.0, 0.08])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    """Spectrum bins to pitch classes, as a matrix."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12))
    for k, f in enumerate(hertz):
        if LOWEST <= f <= HIGHEST:
            out[k, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


_FOLD, _WINDOW = _fold(), np.hanning(FRAME)


def pitch_frames(samples: bytes) -> np.ndarray:
    """Pitch-class frames of 8-bit samples, each of unit length or zero."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    if len(x) < FRAME:
        return np.zeros((0, 12))
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    parts = []
    for k in range(0, len(views), 4096):  # bounds memory for long recordings
        power = np.abs(np.fft.rfft(views[k : k + 4096] * _WINDOW, axis=1)) ** 2
        parts.append(power @ _FOLD)
    frames = np.concatenate(parts)
    norm = np.linalg.norm(frames, axis=1, keepdims=True)
    return np.divide(frames, norm, out=np.zeros_like(frames), where=norm > 1e-9)


def padded(samples: bytes) -> bytes:
    """``samples``, followed by silence if they are fewer than a window of WIDTH frames: one code for each HOP begun."""
    window = FRAME + (WIDTH - 1) * HOP
    if not samples or len(samples) >= window:
        return samples
    return samples.ljust((len(samples) - 1) // HOP * HOP + window, b"\x80")


def filtered(frames: np.ndarray) -> np.ndarray:
    """Log ratios of the sixteen filters (columns) at each position of a window of WIDTH frames."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros((0, len(FILTERS)))
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]

    values = np.empty((n, len(FILTERS)))
    for k, (kind, low, high, width) in enumerate(FILTERS):
        p0, p1, pm, tm = low, low + high, low + high // 2, width // 2
        whole = area(0, width, p0, p1)
        if kind == 0:  # lower against upper pitch classes
            first = area(0, width, p0, pm)
        elif kind == 1:  # earlier against later
            first = area(0, tm, p0, p1)
        elif kind == 2:  # opposite corners
            first = area(0, tm, p0, pm) + area(tm, width, pm, p1)
        elif kind == 3:  # middle pitch classes against the outer ones
            first = area(0, width, p0 + high // 4, p1 - high // 4)
        else:  # middle of the time against its ends
            first = area(width // 4, width - width // 4, p0, p1)
        values[:, k] = np.log1p(first) - np.log1p(whole - first)
    return values


def packed(steps: np.ndarray) -> np.ndarray:
    """Rows of sixteen steps as 32-bit integers, Gray-coded."""
    codes = np.zeros(len(steps), np.uint32)
    for k in range(steps.shape[1]):
        codes = codes << np.uint32(2) | GRAY[steps[:, k]]
    return codes.astype(np.int64)


def fingerprint(frames: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """One packed 32-bit integer per position of a window of WIDTH frames; long recordings are filtered in blocks."""
    parts = [packed(np.searchsorted(STEPS, filtered(frames[k : k + block + WIDTH - 1]))) for k in range(0, max(1, len(frames) - WIDTH + 1), block)]
    return np.concatenate(parts)


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of bits that differ where ``b`` is laid over ``a`` so that b[i + offset] meets a[i]; 1 without an overlap."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    if start >= end:
        return 1.0
    return float(np.bitwise_count(a[start:end] ^ b[start + offset : end + offset]).sum()) / (32 * (end - start))


_CODES = pa.list_(pa.int32())
PRINTS = "uid long, id long, n_frames long, codes array<int>, digest binary"


def fingerprints(media: DataFrame, key: str, samples: str) -> DataFrame:
    """uid, id, n_frames, codes (as 32 bits with a sign) and digest of the recording in column ``samples`` of every row; uid
    names a row once this is written."""
    short_batches(media.sparkSession)

    @trimmed
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                frames = [pitch_frames(padded(x or b"")) for x in part.column(2).to_pylist()]
                codes = [fingerprint(x).astype(np.uint32) for x in frames]
                digests = [hashlib.sha256(x.astype("<u4").tobytes()).digest() for x in codes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in frames], pa.int64()), pa.array([x.view(np.int32) for x in codes], _CODES), pa.array(digests, pa.binary())], ["uid", "id", "n_frames", "codes", "digest"])

    return media.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.col(samples).cast("binary").alias("samples")).mapInArrow(run, PRINTS)


def pair_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring codes, each as one number, in no order of sound (one number for one pair), and which of
    them have several places; a run of equal pairs is one place."""
    key = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:].astype(np.uint64)
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):  # odd factors and shifts: can be undone
        key = (key ^ key >> np.uint64(shift)) * np.uint64(factor)
    keys, places = np.unique(key.view(np.int64), return_counts=True)
    return keys, places > 1


def _posts(prints: DataFrame) -> DataFrame:
    """key, uid, again: the keys of every row; ``again`` where a key has several places."""

    @trimmed
    def run(batches):
        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy().view(np.uint32), np.cumsum(np.asarray(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64))
            found = [pair_keys(x) for x in np.split(flat, ends[:-1])] if len(ends) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in found])), pa.array(np.repeat(batch.column(0).to_numpy(), [len(k) for k, _ in found])), pa.array(np.concatenate([x for _, x in found]))], ["key", "uid", "again"])

    return prints.where("size(codes) > 1").select("uid", "codes").mapInArrow(run, "key long, uid long, again boolean")


def _tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Votes for each offset of ``b`` against ``a`` (codes as int64), and the first offset: equal pairs of neighbouring codes, each
    at all its places in the recording (a run, as of a held note or silence, is one place)."""
    sides = []
    for c in (a, b):
        keys = c[:-1] << 32 | c[1:]
        places = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        order = places[np.argsort(keys[places], kind="stable")]
        sides.append((keys[order], order))
    (x, i), (y, j) = sides
    first, last = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    low = 1 - len(a)
    tally = np.zeros(max(1, len(a) + len(b) - 1), np.int64)
    for k in np.flatnonzero(last > first):  # one place of a at a time bounds memory
        tally[j[first[k] : last[k]] - i[k] - low] += 1
    return tally, low


def offset_votes(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best offset of ``b`` against ``a`` and its votes; of equals the smallest offset. No common pair: 0 votes."""
    tally, low = _tally(a, b)
    best = int(tally.argmax())
    return (best + low, int(tally[best])) if tally[best] else (0, 0)


def matched(a: np.ndarray, b: np.ndarray, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> tuple[int, int, float] | None:
    """Offset, votes and bit errors where ``b`` matches ``a``: of all offsets with enough votes and few enough errors the one with
    the most votes, then the smallest. What is voted for most may be a passage that both repeat, out of place."""
    tally, low = _tally(a, b)
    places = np.flatnonzero(tally >= min_votes)
    for at in places[np.argsort(-tally[places], kind="stable")]:
        if (error := bit_errors(a, b, int(at) + low)) <= max_error:
            return int(at) + low, int(tally[at]), error
    return None


MATCHES = "query long, match long, query_id long, match_id long, offset int, votes long, bit_error_rate double"


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """Lists of codes as arrays of int64."""
    ends = np.cumsum(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64))
    return np.split(lists.flatten().to_numpy().view(np.uint32).astype(np.int64), ends[:-1]) if len(ends) else []


def aligned(pairs: DataFrame, prints: DataFrame, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> DataFrame:
    """Of ``pairs`` (query, match: uids; query_id, match_id) those that match, with offset, votes and bit_error_rate."""
    spark = prints.sparkSession
    pairs, pairs_path = cut_to(pairs, "chroma-pairs")
    wanted = {x: bounded_side(cut(pairs.select(x).distinct(), "chroma-ends")) for x in ("query", "match")}
    sides = {x: prints.select(F.col("uid").alias(x), F.col("codes").alias(f"codes_{x}")).join(ends, x, "left_semi") for x, ends in wanted.items()}
    queries, codes_path = cut_to(sides["query"], "chroma-codes")
    laid = pairs.join(sides["match"], "match").join(bounded_side(queries, most_bytes=QUERY_BYTES), "query").select("query", "match", "query_id", "match_id", "codes_query", "codes_match")

    @trimmed
    def rate(batches):
        for batch in batches:
            rows = []
            for *names, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), *(_arrays(batch.column(i)) for i in (4, 5)), strict=True):
                if match := matched(a, b, min_votes, max_error):
                    rows.append((*names, *match))
            if rows:
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    found = cut(laid.mapInArrow(rate, MATCHES), "chroma-found")
    drop_tables(spark, pairs_path, codes_path)
    return found


def _rooted(links: DataFrame) -> DataFrame:
    """uid, root of the classes that ``links`` (query, match) connect."""
    named = [F.xxhash64(x).alias(y) for x, y in (("query", "a"), ("match", "b"))]  # one hash for one number
    ends = links.select(F.col("query").alias("uid")).union(links.select("match")).distinct()
    return ends.join(components(links.select(*named)), F.xxhash64("uid") == F.col("node")).select("uid", "root")


def classes_of(prints: DataFrame, every: int = EVERY) -> DataFrame:
    """uid, class (the smallest uid with the same fingerprint), class_id and whether the class is a query, of each row."""
    own = prints.select("uid", "id", "digest")
    named = own.groupBy("digest").agg(F.min("uid").alias("class"), F.min("id").alias("class_id"), F.coalesce(F.max(F.col("id") % every == 0), F.lit(False)).alias("asked"))
    # a class may hold a third of all rows: its row is broadcast while the table is small, and split by adaptive execution beyond
    return cut(own.join(bounded_side(cut(named, "chroma-classes")), "digest").select("uid", "class", "class_id", "asked"), "chroma-rows")


def _in_runs(held: DataFrame) -> DataFrame:
    """``held`` (key, class, class_id, asked, again, n) with the keys before and after each of a class, longest lists first: near copies
    have the same keys there one after the other."""
    order = Window.partitionBy("class").orderBy(F.desc("n"), "key")
    return held.select("key", "class", "class_id", "asked", "again", F.lag("key").over(order).alias("before"), F.lead("key").over(order).alias("after"))


def _enough(held: DataFrame, min_votes: int) -> DataFrame:
    """Pairs (query, match) of classes where so many places can vote: as many common keys, or one with several places in
    both. A pair of queries stands once.

    Keys that both have one after the other are one row, that of their first; where there is a second one, the pair is
    enough of a candidate for ``aligned``, which counts its votes.
    """
    a, b = held.where("asked").alias("a"), held.alias("b")
    once = ~F.col("b.asked") | (F.col("a.class") < F.col("b.class"))
    first = ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") != F.col("b.class")) & once & first)
    several = (F.col("a.again") & F.col("b.again")) | F.coalesce(F.col("a.after") == F.col("b.after"), F.lit(False))
    pairs = met.select(*[F.col(f"{x}.class{y}").alias(f"{z}{y}") for y in ("", "_id") for x, z in (("a", "query"), ("b", "match"))], F.when(several, min_votes).otherwise(1).alias("worth"))
    enough = pairs.groupBy("query", "match").agg(F.sum("worth").alias("worth"), *[F.max(x).alias(x) for x in ("query_id", "match_id")])
    return enough.where(F.col("worth") >= min_votes).drop("worth")


def search(prints: DataFrame, rows: DataFrame, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> tuple[DataFrame, DataFrame]:
    """All matches between queries and other classes (two queries: once), and uid, root of the classes that matches connect;
    classes by their smallest uid. ``prints`` is a written table of ``fingerprints``, ``rows`` are its ``classes_of``."""
    spark = prints.sparkSession
    asked = _posts(prints.join(bounded_side(rows.where("asked and uid = class").select("uid")), "uid", "left_semi")).select("key").distinct()
    copies, single = bounded_side(rows.where("uid <> class").select("uid")), prints
    if is_broadcast(copies):  # copies of a fingerprint have its keys; where they are too many to name, they are found by class
        single = prints.join(copies, "uid", "left_anti")
    # only keys that a query has can bring a candidate: one shuffle of all keys, and what is left is small
    met = _posts(single).join(asked, "key", "left_semi").join(rows.select("uid", "class", "class_id", "asked"), "uid")
    met = met.groupBy("key", "class").agg(F.max("class_id").alias("class_id"), F.max("asked").alias("asked"), F.max("again").alias("again"))
    met, met_path = cut_to(met, "chroma-posts")
    lists = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("any")).where("n > 1 and any").select("key", "n")
    held, held_path = cut_to(_in_runs(met.join(bounded_side(cut(lists, "chroma-lists")), "key")), "chroma-held")
    found = aligned(_enough(held, min_votes), prints, min_votes, max_error)
    drop_tables(spark, met_path, held_path)
    return found, cut(_rooted(found), "chroma-roots")


def report(media: DataFrame, key: str = "doc_id", samples: str = "text", every: int = EVERY) -> DataFrame:
    """One row per row of ``media``: its fingerprint, its class, its component (the smallest id that matches with queries lead
    to, its own included), the number of other classes that its class matches, a query on either side (n_links), and the best of
    these matches, if any: match_id, match_offset, votes and bit_error_rate. The bytes of ``samples`` are the recording."""
    prints = cut(fingerprints(media, key, samples), "chroma-prints")
    rows = classes_of(prints, every)
    found, roots = search(prints, rows)
    names = rows.where("uid = class").select("class", "class_id")
    rooted = names.join(roots.withColumnRenamed("uid", "class"), "class")
    tops = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labels = rooted.join(bounded_side(cut(tops, "chroma-tops")), "root").select("class", "component_id")
    turned = found.select(F.col("match").alias("class"), F.col("query_id").alias("match_id"), (-F.col("offset")).alias("offset"), "votes", "bit_error_rate")
    both = found.select(F.col("query").alias("class"), "match_id", "offset", "votes", "bit_error_rate").unionByName(turned)
    best = both.groupBy("class").agg(F.min(F.struct("bit_error_rate", (-F.col("votes")).alias("fewer"), "match_id", "offset")).alias("b"), F.count(F.lit(1)).alias("n_links"))
    linked = labels.join(best, "class", "left").select("class", "component_id", F.col("b.match_id").alias("match_id"), F.col("b.offset").alias("match_offset"), (-F.col("b.fewer")).alias("votes"), F.round("b.bit_error_rate", 6).alias("bit_error_rate"), "n_links")
    sized = prints.select("uid", F.col("id").alias("doc_id"), "n_frames", F.size("codes").cast("long").alias("n_codes"), F.lower(F.hex("digest")).alias("codes_sha256"))
    joined = sized.join(rows.select("uid", "class", "class_id"), "uid").join(bounded_side(cut(linked, "chroma-linked")), "class", "left")
    return joined.select("doc_id", "n_frames", "n_codes", "codes_sha256", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "match_id", "match_offset", "votes", "bit_error_rate", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
