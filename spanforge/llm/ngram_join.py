"""N-gram Jaccard join: size-aware, heavy and light.

A document's set holds the hashes of its distinct five-word shingles. Equal sets form classes; only classes are joined.

* Small sets (largest size up to a boundary) enumerate their subsets of the fixed size that two sets of their sizes must
  share; a common subset is a link. The boundary is the one with the least cost: subsets to write against list entries to
  write and scan, from the counts of set sizes and the mean length of a list.
* Larger sets are found by scanning inverted lists of prefixes. Shingles that occur in many prefixes go to the end of the
  order (any order common to all sets is right), which moves shared passages out of the prefixes. Lists that stay long are
  those of large groups of near copies: their members are compared with a few pivots, and then only pairs between members
  that are not yet connected.
* Candidates pass an exact bound (parity bitmaps: the bits that differ can't outnumber the shingles that differ) before
  the sets themselves are intersected.

Sets are named by 64 bits of their digest, shingles are 64-bit hashes.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer than five words make one shingle
of the whole sequence; rows with equal sets are linked whatever their ids; a component's id is the smallest doc_id in it
(null only where all its ids are null); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_side, cut, cut_to, drop_tables, located, locator, short_batches, trimmed, without_rows
from .components import components

WORDS = 5
#: A list longer than this is long: its shingle moves to the end of the order.
LONG = 64
#: Rounds in which shingles are moved; what stays long after them is compared by pivots.
ROUNDS = 3
#: At most so many shingles are moved, the most frequent first (8 MB to each task). Others that are as frequent stay where
#: they are: their lists, once longer than SCANNED, are compared by pivots as well.
MOVED = 1 << 20
#: Sets up to this size are considered for the enumeration of subsets.
MOST_SMALL = 12
PIVOTS = 8
#: Lists of more entries are compared by pivots too, whatever was moved.
SCANNED = 4 * LONG
#: Sets that a task remembers to have written.
SEEN = 100_000
#: Members of a list that are compared in one group.
BLOCK = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SHIFT = np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted int64 hashes of a text's distinct shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    h = np.array([_hashes[w] for w in words], np.uint64)
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(_MIX):
        out = (out ^ h[k : k + n]) * m
        out ^= out >> _SHIFT
    return np.unique(out.view(np.int64))


def overlap(n, m):
    """Shingles that sets of ``n`` and ``m`` must share: 100 * both >= 80 * (n + m - both)."""
    return -(-4 * (n + m) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of about two bits per shingle, as 64-bit words; their number is a power of two."""
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    counts = np.bincount(tokens & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the number of shingles that only one of two sets has, from their bitmaps."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):  # the parity of a residue is that of all residues that fold onto it
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def _among(tokens: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``tokens`` are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(some, tokens)
    at[at == len(some)] = 0
    return some[at] == tokens


def ordered_prefix(tokens: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set where ``moved`` shingles come last, and which of it are moved ones."""
    late = _among(tokens, moved)
    p = prefix_length(len(tokens))
    return np.concatenate([tokens[~late], tokens[late]])[:p], np.sort(late)[:p]


def subset_rows(n: int) -> int:
    """How many subsets a set of ``n`` writes."""
    return sum(comb(n, overlap(n, m)) for m in range(-(-4 * n // 5), 5 * n // 4 + 1) if overlap(n, m) <= min(n, m))


def boundary(sizes: dict[int, int], scanned: float) -> int:
    """Largest size of small sets, for counts of the sizes up to 5/4 of MOST_SMALL and a mean of entries scanned a row."""

    def cost(x: int) -> float:
        lists = sum(k * prefix_length(n) * (1 + scanned) for n, k in sizes.items() if 5 * n >= 4 * (x + 1))
        return lists + sum(k * subset_rows(n) for n, k in sizes.items() if n <= x)

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), x))


_LISTS = pa.list_(pa.int64())


@trimmed
def _digest_sets(batches):
    """Of each row its set's size and digest; the prefix, bitmap and small set where the digest is new to the task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            n, h1, h2, prefix, bits, small = [], [], [], [], [], []
            for text in part.column(3).to_pylist():
                s = shingle_set(text)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                key = (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)
                new = len(s) > 0 and key not in seen
                if len(seen) >= SEEN:
                    seen.clear()  # a set that is written twice is dropped later
                seen.add(key)
                n.append(len(s))
                h1.append(key[0])
                h2.append(key[1])
                prefix.append(s[: prefix_length(len(s))] if new else None)
                bits.append(bitmap(s) if new else None)
                small.append(s if new and len(s) <= MOST_SMALL else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefix, _LISTS), pa.array(bits, _LISTS), pa.array(small, _LISTS)],
                ["doc_id", "file", "row", "n", "sid", "more", "prefix", "bits", "small"],
            )


@trimmed
def _full_sets(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            sids = [(xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, _LISTS)], ["sid", "tokens"])


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, tokens of the sets whose rows ``wanted`` (a written table) has as file and row, from the texts."""
    rows = bounded_side(wanted.select(*locator("file", "row")))
    at = docs.select(*locator("_metadata.file_path", "_metadata.row_index"), F.col("text").cast("string").alias("text"))
    return at.join(rows, ["_sf_file", "_sf_more", "_sf_row"], "left_semi").select("_sf_row", "text").mapInArrow(_full_sets, "sid long, tokens array<long>")


def _scan_lists(most: int):
    """A scan of inverted lists, as rows (token, sid, n, pos) in the order of tokens, a token at a time: pairs of sets that
    share an entry and can still share enough after it (a, b), and the entries of lists of more than ``most`` (a: token,
    b: sid, n, pos), which are not compared here."""

    def pairs_of(token: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
        found, lag = [np.zeros((0, 2), np.int64)], 1
        while lag < len(token):
            i = np.flatnonzero(token[lag:] == token[:-lag])
            if not len(i):
                break
            j = i + lag
            least = overlap(n[i], n[j])
            fit = (pos[i] <= n[i] - least) & (pos[j] <= n[j] - least) & (least <= np.minimum(n[i], n[j])) & (sid[i] != sid[j])
            i, j = i[fit], j[fit]
            found.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], axis=1))
            lag += 1
        return np.unique(np.concatenate(found), axis=0)

    def packed(pairs: np.ndarray, entries: list[np.ndarray]) -> pa.RecordBatch:
        token, sid, n, pos = entries
        none = pa.nulls(len(pairs), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pairs[:, 0], token])), pa.array(np.concatenate([pairs[:, 1], sid])), *(pa.concat_arrays([none, pa.array(x.astype(np.int32))]) for x in (n, pos))],
            ["a", "b", "n", "pos"],
        )

    def scanned(rows: list[np.ndarray]):
        """Whole lists."""
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        sizes = np.diff(np.r_[starts, len(rows[0])])
        each = np.repeat(sizes, sizes)
        pairs = pairs_of(*(x[(each > 1) & (each <= most)] for x in rows))
        long = [x[each > most] for x in rows]
        if len(pairs) or len(long[0]):
            yield packed(pairs, long)

    @trimmed
    def run(batches):
        held, known = _EMPTY, None  # the last list so far, which may go on; its token where it is known to be long
        for rows in _gathered(batches, 1 << 16):
            if known is not None:
                more = int(np.searchsorted(rows[0], known, "right"))
                yield packed(_EMPTY_PAIRS, [x[:more] for x in rows])
                rows = [x[more:] for x in rows]
                if not len(rows[0]):
                    continue
                known = None
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            first = int(np.searchsorted(rows[0], rows[0][-1]))
            if first:
                yield from scanned([x[:first] for x in rows])
            held = [x[first:] for x in rows]
            if len(held[0]) > most:
                yield packed(_EMPTY_PAIRS, held)
                held, known = _EMPTY, held[0][0]
        if len(held[0]):
            yield from scanned(held)

    return run


_EMPTY, _EMPTY_PAIRS = [np.zeros(0, np.int64)] * 4, np.zeros((0, 2), np.int64)


def _gathered(batches, least: int):
    """Columns of batches as arrays of int64, at least ``least`` rows at a time."""
    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append([c.to_numpy().astype(np.int64) for c in batch.columns])
            n += batch.num_rows
        if n >= least:
            yield [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts, n = [], 0
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _rows_of(lists: pa.ListArray) -> list[np.ndarray]:
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(), ends[:-1]) if len(ends) else []


@trimmed
def _passing(batches):
    """Pairs whose bitmaps differ in no more bits than their shingles may."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        most = n + m - 2 * overlap(n, m)
        keep = [least_difference(x, y) <= k for x, y, k in zip(_rows_of(batch.column(4)), _rows_of(batch.column(5)), most, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["a", "b"])


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    side = {x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"}
    both = pairs.distinct().join(side["a"], "a").join(side["b"], "b").where("4 * greatest(na, nb) <= 5 * least(na, nb)")
    left = cut(both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(_passing, "a long, b long"), "join-passing")
    ends = left.select(F.col("a").alias("sid")).union(left.select("b")).distinct()
    wanted = cut(sets.select("sid", "file", "row").join(ends, "sid", "left_semi"), "join-wanted")
    full, full_path = cut_to(_sets_of(docs, wanted), "join-full")
    first, second = (full.select(F.col("sid").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    met = left.join(first, "a").join(second, "b").select("a", "b", shared.alias("both"), (F.size("ta") + F.size("tb")).cast("long").alias("all"))
    links = cut(met.where("100 * both >= 80 * (all - both)").select("a", "b"), "join-links")
    drop_tables(docs.sparkSession, full_path)
    return links


def _small_links(sets: DataFrame, most: int) -> DataFrame:
    """Links between sets of at most ``most`` shingles, by common subsets of the size that they must share."""

    def enumerate_subsets(batches):
        for batch in batches:
            keys, own, role = [], [], []
            for sid, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(tokens)
                for m in range(-(-4 * n // 5), min(most, 5 * n // 4) + 1):
                    k = overlap(n, m)
                    if k > min(n, m):
                        continue
                    seed = min(n, m) << 8 | max(n, m)
                    for chosen in combinations(tokens, k):
                        keys.append(xxhash.xxh64_intdigest(np.array(chosen, np.int64).tobytes(), seed) - (1 << 63))
                        own.append(sid)
                        role.append((n > m) - (n < m))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64()), pa.array(role, pa.int32())], ["key", "sid", "role"])

    rows, path = cut_to(sets.where(F.col("n") <= most).select("sid", "small").mapInArrow(enumerate_subsets, "key long, sid long, role int"), "join-subsets")
    # every smaller set of a list is linked with every larger one: a star from the first of each side connects them all
    stars = rows.groupBy("key").agg(F.min(F.when(F.col("role") <= 0, F.col("sid"))).alias("low"), F.min(F.when(F.col("role") >= 0, F.col("sid"))).alias("high"), F.count(F.lit(1)).alias("size"))
    met = rows.join(stars.where("size > 1 and low is not null and high is not null"), "key")
    links = met.select(F.col("sid").alias("a"), F.when(F.col("role") > 0, F.col("low")).otherwise(F.col("high")).alias("b")).where("a <> b").distinct()
    out = cut(links, "join-small")
    drop_tables(sets.sparkSession, path)
    return out


def _frequent(tokens: DataFrame, long: int) -> tuple[np.ndarray, float]:
    """The tokens that occur more than ``long`` times, sorted, and the mean of entries scanned a row."""
    counts, path = cut_to(tokens.groupBy("token").count().where("count > 1"), "join-counts")
    top = counts.where(F.col("count") > long).orderBy(F.desc("count"), "token").limit(MOVED).select("token").toPandas()["token"].to_numpy(np.int64)
    total = counts.agg(F.sum(F.least(F.col("count"), F.lit(long)) * F.col("count")), F.sum("count")).first()
    drop_tables(tokens.sparkSession, path)
    return np.sort(top), float(total[0] or 0) / float(total[1] or 1)


def _moved_shingles(sets: DataFrame, docs: DataFrame, long: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None, list[str], float]:
    """Shingles that go to the end of the order; those whose lists stay long all the same; the full sets that have one of
    either in their prefix, and where these are written; mean entries scanned a row."""
    spark, empty = docs.sparkSession, np.zeros(0, np.int64)
    moved, scanned = _frequent(sets.select(F.explode("prefix").alias("token")), long)
    if not len(moved):
        return moved, empty, None, [], scanned
    full, path = cut_to(_sets_of(docs, cut(_touched(spark, sets, moved), "join-touched")), "join-moved")
    for k in range(ROUNDS):
        # only shingles that moving others has brought into a prefix can have made a list longer
        still, _ = _frequent(_moved_prefixes(spark, full, moved, empty, "fresh").select("token"), long)
        if not len(still) or k == ROUNDS - 1 or len(moved) >= MOVED:
            break
        moved = np.union1d(moved, still)
    # one order for all: every set that has one of these shingles in its prefix is ordered anew
    late = cut(_touched(spark, sets, np.union1d(moved, still)).join(bounded_side(full.select("sid")), "sid", "left_anti"), "join-touched")
    more, more_path = cut_to(_sets_of(docs, late), "join-moved")
    return moved, still, full.unionByName(more), [path, more_path], scanned


def _touched(spark: SparkSession, sets: DataFrame, moved: np.ndarray) -> DataFrame:
    """sid, file, row of the sets that have one of ``moved`` in their prefix."""
    shared = spark.sparkContext.broadcast(moved)

    def run(batches):
        for batch in batches:
            lists, m = batch.column(3), shared.value
            flat, ends = lists.flatten().to_numpy(), np.asarray(lists.value_lengths().to_numpy(), np.int64)
            hits = np.bincount(np.repeat(np.arange(len(ends)), ends)[_among(flat, m)], minlength=len(ends)) > 0
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(hits)) for i in range(3)], ["sid", "file", "row"])

    return sets.select("sid", "file", "row", "prefix").mapInArrow(trimmed(run), "sid long, file string, row long")


def _moved_prefixes(spark: SparkSession, full: DataFrame, moved: np.ndarray, still: np.ndarray, which: str) -> DataFrame:
    """token, sid, n, pos: the prefixes of ``full`` sets in the order with ``moved`` shingles last. Of these the entries of
    ``long`` lists (of ``moved`` and ``still`` shingles), of ``plain`` ones, or those that are ``fresh`` in the prefix."""
    shared = spark.sparkContext.broadcast((moved, still))

    def entries(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prefix, late = ordered_prefix(tokens, shared.value[0])
        if which == "fresh":
            wanted = ~late & (prefix > tokens[len(prefix) - 1])
        else:
            wanted = (late | _among(prefix, shared.value[1])) == (which == "long")
        at = np.flatnonzero(wanted)
        return prefix[at], at

    def run(batches):
        for batch in batches:
            sets = _rows_of(batch.column(1))
            found = [entries(x) for x in sets]
            if not found:
                continue
            counts = [len(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([x for x, _ in found])),
                    pa.array(np.repeat(batch.column(0).to_numpy(), counts)),
                    pa.array(np.repeat([len(x) for x in sets], counts).astype(np.int32)),
                    pa.array(np.concatenate([at for _, at in found]).astype(np.int32)),
                ],
                ["token", "sid", "n", "pos"],
            )

    return full.select("sid", "tokens").mapInArrow(trimmed(run), "token long, sid long, n int, pos int")


def _fits(a: str, b: str) -> str:
    """SQL: two entries of a list can belong to a link."""
    least = f"ceil(4 * ({a}.n + {b}.n) / 9)"
    return f"{a}.pos <= {a}.n - {least} and {b}.pos <= {b}.n - {least} and {least} <= least({a}.n, {b}.n)"


def _pivot_pairs(entries: DataFrame) -> DataFrame:
    """Members of long lists against a few pivots of the list: as many pairs as members, times PIVOTS."""
    picks = [F.min(F.struct(F.xxhash64("sid", F.lit(k)), "sid"))["sid"] for k in range(PIVOTS)]
    pivots = entries.groupBy("token").agg(F.array_distinct(F.array(*picks)).alias("pivots"))
    pairs = entries.join(pivots, "token").select("sid", F.explode("pivots").alias("pivot")).where("sid <> pivot")
    return pairs.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _open_pairs(entries: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs in long lists that are not yet connected: members outside the list's largest component against the others,
    as far as their sizes and bitmaps let them be links. Lists are cut by size of the set (a step of 1.25, the most that
    linked sets differ by) and into groups of about BLOCK members, so that no task gets a whole list."""
    members = entries.select("sid").distinct()
    bits = cut(sets.select("sid", "bits").join(members, "sid", "left_semi"), "join-bits")
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25)) + 1e-9).cast("int")
    rooted = entries.join(bits, "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("token", "sid", "n", "pos", "bits", F.coalesce("root", "sid").alias("root"), step.alias("step"))
    rooted = cut(rooted, "join-rooted")
    sizes = rooted.groupBy("token", "root").count()
    largest = sizes.groupBy("token").agg(F.max(F.struct("count", "root"))["root"].alias("largest"))
    groups = cut(rooted.groupBy("token", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups")), "join-groups")
    alone = rooted.join(largest, "token").where("root <> largest").drop("largest", "step").withColumn("step", F.explode(F.array(*[step + k for k in (-1, 0, 1)])))
    alone = alone.join(groups, ["token", "step"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups").alias("x")
    others = rooted.join(groups, ["token", "step"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("groups")).cast("int")).drop("groups").alias("y")
    differ = "aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)"
    bound = f"(size(x.bits) <> size(y.bits) or {differ} <= x.n + y.n - 2 * ceil(4 * (x.n + y.n) / 9))"
    pairs = alone.join(others, F.expr(f"x.token = y.token and x.step = y.step and x.part = y.part and x.root <> y.root and {_fits('x', 'y')} and {bound}"))
    return pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def join_classes(docs: DataFrame, long: int = LONG, scan: int = SCANNED) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, file, row, n, sid, more) and the roots (node, root) of the sets that have links."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("text").cast("string"))
    base = cut(rows.mapInArrow(_digest_sets, "doc_id long, file string, row long, n int, sid long, more long, prefix array<long>, bits array<long>, small array<long>"), "join-base")
    new = base.where("prefix is not null")
    first = new.groupBy("sid", "more").agg(F.min(F.struct("file", "row")).alias("keep"), F.count(F.lit(1)).alias("k")).where("k > 1")
    extra = new.select("sid", "more", "file", "row").join(first, ["sid", "more"]).where("struct(file, row) <> keep").select("file", "row")
    sets = new.join(bounded_side(cut(extra, "join-extra")), ["file", "row"], "left_anti")

    moved, still, full, paths, scanned = _moved_shingles(sets, docs, long)
    few = {r["n"]: r["count"] for r in sets.where(F.col("n") <= 5 * MOST_SMALL // 4).groupBy("n").count().collect()}
    small = boundary(few, scanned)
    links = _small_links(sets, small)

    listed = F.col("n") * 5 >= 4 * (small + 1)
    plain = sets.where(listed).select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    lists, long_entries = plain.select("token", "sid", "n", "pos"), None
    if full is not None:
        others = sets.where(listed).join(bounded_side(full.select("sid")), "sid", "left_anti").select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
        lists = others.select("token", "sid", "n", "pos").unionByName(_moved_prefixes(spark, full, moved, still, "plain").where(listed))
        long_entries = _moved_prefixes(spark, full, moved, still, "long").where(listed)
    dealt = lists.repartition("token").sortWithinPartitions("token", "sid")
    scanned = cut(dealt.mapInArrow(_scan_lists(scan), "a long, b long, n int, pos int").distinct(), "join-pairs")
    pairs = scanned.where("n is null").select("a", "b")
    entries = scanned.where("n is not null").select(F.col("a").alias("token"), F.col("b").alias("sid"), "n", "pos")
    entries = cut(entries if long_entries is None else entries.unionByName(long_entries), "join-long")
    drop_tables(spark, *paths)
    if not entries.limit(1).count():
        links = links.unionByName(_verified(docs, sets, pairs))
        return base, components(links)
    links = links.unionByName(_verified(docs, sets, pairs.unionByName(_pivot_pairs(entries))))
    roots = components(links)
    more = _verified(docs, sets, _open_pairs(entries, roots, sets))
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    return base, roots


def _grouped(docs: DataFrame, long: int, scan: int) -> DataFrame:
    base, roots = join_classes(docs, long, scan)
    own = F.struct("doc_id", "file", "row")
    classes = base.where("n > 0").groupBy("sid", "more").agg(F.min("doc_id").alias("low"), F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("keep"), F.min(own).alias("other"))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "join-classes")
    tops = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.coalesce(F.min("keep"), F.min("other")).alias("keep"))
    # two sets with the same 64 bits stay classes of their own, but share a root
    labelled = rooted.select("sid", "more", "root").join(tops, "root").select("sid", "more", "component_id", "keep")
    joined = base.select("doc_id", "file", "row", "n", "sid", "more").where("n > 0").join(labelled, ["sid", "more"])
    linked = joined.select("doc_id", "file", "row", "n", "component_id", own.eqNullSafe(F.col("keep")).alias("kept"))
    alone = base.where("n = 0").select("doc_id", "file", "row", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def report(docs: DataFrame, long: int = LONG, scan: int = SCANNED) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _grouped(located(docs), long, scan).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, long: int = LONG, scan: int = SCANNED) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id."""
    docs = located(docs)
    return without_rows(docs, _grouped(docs, long, scan).where("not kept"))


def oracle() -> str:
    """All pairs by shared shingle, then the closure of their links; for tables without large groups."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r, r AS t FROM n UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.t),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""
