"""Deduplication, mixing, lines, joins, quality and fingerprints against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import of_duck, of_spark
from pyspark.sql import functions as F

from spanforge.llm import chroma, components, exact_dedup, line_spread, mixture, ngram_join, quality, queries


@pytest.mark.parametrize("name", ["op2_mixture", "op9_exact_dedup", "op10_line_spread"])
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_duck(duck, queries.ORACLES[name])


# exact dedup


def test_largest_id_stays(docs_of):
    docs = docs_of([(1, "a"), (5, "a"), (3, "a"), (2, None), (9, ""), (4, "b"), (None, "a"), (None, "c")])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(docs).collect()}
    assert got == {(1, 5, 4, False), (5, 5, 4, True), (3, 5, 4, False), (None, 5, 4, False), (2, 9, 2, False), (9, 9, 2, True), (4, 4, 1, True), (None, None, 1, True)}


def test_hot_groups_are_split(docs_of, monkeypatch):
    """Groups whose states go to the rows give the same as others."""
    rows = [(i, "hot" if i % 3 else f"t{i % 5}") for i in range(60)] + [(None, "hot"), (3, None), (4, "")]
    as_rows = lambda: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(docs_of(rows)).collect()), key=str)
    plain = as_rows()
    monkeypatch.setattr(exact_dedup, "HOT_GROUP", 3)
    assert as_rows() == plain and {g for _, _, g, _ in plain} >= {41, 4, 2}


def test_rows_with_one_id_leave_one(docs_of):
    docs = docs_of([(1, "a")] * 4 + [(1, "b")])
    assert sorted(r.text for r in exact_dedup.deduplicate(docs).collect()) == ["a", "b"]
    assert exact_dedup.deduplicate(docs).columns == docs.columns


def test_bytes_decide_where_digests_clash(docs_of):
    docs = docs_of([(1, "ax"), (2, "ay"), (3, "ax"), (4, "b")])
    weak = exact_dedup.classify(docs, lambda t: F.substring(t, 1, 1).cast("binary")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in weak} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}


def test_dedup_of_tables_that_are_no_files_and_empty(spark, docs_of):
    assert exact_dedup.report(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).where("kept").count() == 1
    assert exact_dedup.report(docs_of([])).count() == 0


def derived(docs):
    """Frames whose rows are not those of one file: (name, frame)."""
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    yield "exploded", twice
    yield "joined", docs.join(docs.sparkSession.range(2).withColumnRenamed("id", "k"))
    yield "united", docs.unionByName(docs)
    yield "read twice", docs.sparkSession.read.parquet(docs.inputFiles()[0], docs.inputFiles()[0])
    yield "limited", docs.orderBy("doc_id").limit(5)
    yield "filtered", docs.where("doc_id > 2").withColumn("more", F.lit(1))


def test_copies_in_derived_frames_are_dropped(docs_of):
    docs = docs_of([(i, "one two three four five six " + "abc"[i % 3] * 3) for i in range(12)] + [(40, "one two three four five six ccc seven")], 1)
    for name, df in derived(docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(r.text for r in exact_dedup.deduplicate(df).collect()) == sorted({t for _, t in rows}), name
        kept = ngram_join.one_of_each(df)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)}), name
        assert kept.columns == df.columns


def test_state_meets_later_batches_and_calls(docs_of, spark, tmp_path):
    store = f"{tmp_path}/store"
    first = docs_of([(i, f"t{i % 7}") for i in range(40)], 6)
    second = docs_of([(i, f"t{i % 9}") for i in range(100, 120)], 3)

    def expected(rows):
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        return sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows)

    as_rows = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    old = [(r.doc_id, r.text) for r in first.collect()]
    both = old + [(r.doc_id, r.text) for r in second.collect()]
    assert as_rows(exact_dedup.classify(first, store=store, batch_bytes=1)) == expected(old)
    assert len(list((tmp_path / "store" / "states").glob("batch=*"))) >= 3  # several batches
    assert as_rows(exact_dedup.classify(second, store=store, batch_bytes=1)) == expected(both)
    assert as_rows(exact_dedup.classify(second, store=store)) == expected(both)  # files that it has met count once
    with pytest.raises(ValueError, match="write the documents"):
        exact_dedup.classify(first.withColumn("text", F.lower("text")), store=store)


def test_a_call_that_was_broken_off_is_taken_up(docs_of, tmp_path, monkeypatch):
    docs, store = docs_of([(i, f"t{i % 4}") for i in range(12)]), f"{tmp_path}/store"
    stream = exact_dedup._stream

    def broken(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(exact_dedup, "_stream", broken)
    with pytest.raises(RuntimeError):
        exact_dedup.classify(docs, store=store)
    monkeypatch.setattr(exact_dedup, "_stream", stream)
    assert {(r.keep_id, r.group_size) for r in exact_dedup.classify(docs, store=store).collect()} == {(8, 3), (9, 3), (10, 3), (11, 3)}


def test_bytes_are_checked_against_earlier_calls(docs_of, tmp_path):
    weak = lambda t: F.substring(t, 1, 1).cast("binary")
    store = f"{tmp_path}/store"
    exact_dedup.classify(docs_of([(1, "ax"), (2, "b")]), weak, store=store)
    got = exact_dedup.classify(docs_of([(3, "ay"), (4, "ax"), (5, "b")]), weak, store=store).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 4, 2), (4, 4, 2), (3, 3, 1), (2, 5, 2), (5, 5, 2)}


def test_stream_leaves_the_session_as_it_was(docs_of, spark):
    before = {k: spark.conf.get(k, None) for k in exact_dedup.STATE_STORE}
    exact_dedup.report(docs_of([(1, "a"), (2, "a")])).count()
    assert {k: spark.conf.get(k, None) for k in exact_dedup.STATE_STORE} == before


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from spanforge.llm.common import bounded_side

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "hint" in df._jdf.queryExecution().logical().toString().lower()
    small = spark.range(10).withColumn("path", F.repeat(F.lit("x"), 100))
    assert hinted(bounded_side(small)) and not hinted(bounded_side(small, 9)) and not hinted(bounded_side(small, 10, 1000))


def test_dedup_plan_has_no_python(docs_of):
    plan = exact_dedup.report(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# mixing


def test_mix_targets(docs_of):
    docs = docs_of([(i, "w " * 10, "a") for i in range(10)] + [(100, "w " * 10, "b"), (101, None, "c"), (102, "w", None)])
    rows = mixture.mix(docs).collect()
    target = {r.source: r.target for r in rows}
    assert target["b"] == 30 and target["c"] == 0 and target[None] == 3 and abs(sum(target.values()) - 111) < 1e-6
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixture.mix(docs).collect()}
    assert mixture.emit(docs).count() == sum(r.copies for r in rows)
    assert mixture.emit(docs).columns == docs.columns


def test_mix_comes_near_its_targets(docs_of):
    rnd = random.Random(0)
    docs = docs_of([(i, "w " * rnd.randint(1, 40), f"s{i % 5}") for i in range(3000)])
    for r in mixture.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.1 * r.target


def test_mix_comes_near_its_targets_on_the_given_table(spark, sf_dir):
    """Documents of many sizes: within what the draws allow, six standard deviations of a source's Bernoulli copies."""
    sf = sf_dir.replace("sf0.001", "sf0.1")
    rows = mixture.mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")).drop("text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    whole = sum(r.target for r in {r.source: r for r in rows}.values())
    for own in by.values():
        rate = own[0].target / own[0].source_size if own[0].source_size else 0
        part = rate - int(rate)
        spread = (part * (1 - part) * sum(r["size"] ** 2 for r in own)) ** 0.5
        assert abs(sum(r.taken for r in own) - own[0].target) <= 6 * spread + 1e-6 * own[0].target
    assert abs(sum(r.taken for r in rows) - whole) < 0.02 * whole


def test_mix_with_repeated_ids(docs_of):
    """Rows with one doc_id draw alike; each is a row of the mix."""
    docs = docs_of([(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "e", "x"), (2, "f " * 40, "y"), (None, "g", None), (None, "g", None)])
    rows = mixture.mix(docs).collect()
    assert len(rows) == 6 and len({r.copies for r in rows if r.doc_id == 1}) == 1 and len({r.copies for r in rows if r.doc_id is None}) == 1


def test_mix_of_nothing(docs_of):
    assert mixture.mix(docs_of([])).count() == 0
    assert [r.taken for r in mixture.mix(docs_of([(1, None, None)])).collect()] == [0]


# lines


def test_boilerplate_needs_distinct_sites(docs_of):
    rows = [(i, f"own {i}\nfooter\n\n\n", f"s{i % 12}") for i in range(24)] + [(50 + i, "often\nx", "s1") for i in range(30)] + [(90, None, "s1"), (91, "footer", None)]
    got = {r.doc_id: r for r in line_spread.clean(docs_of(rows), 10).collect()}
    assert (got[3].text, got[3].n_removed, got[3].n_lines) == ("own 3\n\n\n", 1, 5)
    assert got[50].n_removed == 0 and got[90].text == "" and got[91].text == "" and got[91].n_removed == 1
    assert line_spread.clean(docs_of([])).count() == 0


@pytest.mark.parametrize("literals", [line_spread.LITERALS, 0])
def test_lines_equal_brute_force(docs_of, literals):
    rnd = random.Random(8)
    lines = [f"line {k}" for k in range(30)] + ["", "x" * 50_000, "é ▁", "\r"]
    spreads = [rnd.randint(1, 40) for _ in lines]
    rows = [(rnd.randint(0, 150), "\n".join(x for x, n in rnd.choices(list(zip(lines, spreads)), k=rnd.randint(0, 12)) if s < n), f"s{s}") for s in range(40) for _ in range(5)]
    rows += rows[:9] + [(3, None, "s1"), (None, "line 1\nline 2", None)]
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x, set()).add(s)
    expected = []
    for i, t, _ in rows:
        kept = [x for x in (t or "").split("\n") if x == "" or len(sites[x]) < 10]
        n = len((t or "").split("\n"))
        expected.append((i, n, n - len(kept), "\n".join(kept)))
    docs = docs_of(rows).withColumn("n_lines", F.lit("x")).withColumn("n_removed", F.lit("x")).withColumn("key2", F.lit("x")).withColumn("at", F.lit("x"))
    out = line_spread.clean(docs, 10, literals)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()), key=str) == sorted(expected, key=str)
    assert any(0 < len(s) - 10 < 3 for s in sites.values()) and any(len(s) > 14 for s in sites.values())


@pytest.mark.parametrize("literals", [line_spread.LITERALS, 0])
def test_texts_of_many_lines(docs_of, literals):
    import time

    rows = [(k, "\n".join(f"x{i % 50}" if i % 2 else f"own {k} {i}" for i in range(200_000)), f"s{k}") for k in range(11)]
    docs, start = docs_of(rows), time.monotonic()
    got = line_spread.clean(docs, 10, literals).agg(F.sum("n_lines"), F.sum("n_removed")).first()
    assert tuple(got) == (2_200_000, 1_100_000) and time.monotonic() - start < 60


# n-gram join


def brute_components(rows):
    sets = [ngram_join.shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[root(i)]) if len(sets[i]) else rows[i][0]) for i in range(len(rows)))


def near_copies(seed):
    """Groups of edited copies, texts that share a long passage, short texts with few differences, copies and blanks."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 400))
    texts = ["", "  \n", "one", "One", "one two", "a b c d e", "A B c d e f"]
    passage = [word() for _ in range(60)]
    for size in (6, 8, 9, 12, 15, 40, 120):
        base = [word() for _ in range(size)]
        for _ in range(18):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 25))):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.4:
                copy = copy[rnd.randint(0, 1) :] + [word()] * rnd.randint(0, 1)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rnd.randint(5, 60))]) for _ in range(30)]
    return list(enumerate(texts + texts[:10]))


@pytest.mark.parametrize("seed, long", [(1, 64), (2, 4), (3, 2)])
def test_components_equal_brute_force(docs_of, seed, long):
    rows = near_copies(seed)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(docs_of(rows), long).collect())
    assert got == brute_components(rows)


def word_shingles(text):
    """The set of a text as words, without the operator's hashes."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_hashed_sets_equal_words(docs_of):
    texts = [t for _, t in near_copies(7)] + [None, "é ü\x0bß\x0cx \x85 y\u00a0z A É", "a\x1cb c d e f", "x " * 30_000]
    assert [len(ngram_join.shingle_set(t)) for t in texts] == [len(word_shingles(t)) for t in texts]
    for a, b in zip(texts, texts[1:]):
        assert len(np.intersect1d(ngram_join.shingle_set(a), ngram_join.shingle_set(b))) == len(word_shingles(a) & word_shingles(b))


def test_join_query_equals_sql(spark, duck, sf_dir):
    assert of_spark(queries.op3_ngram_join(spark, sf_dir)) == of_duck(duck, queries.ORACLES["op3_ngram_join"])


@pytest.mark.parametrize("most, step", [(3, 7), (2, 1000), (50, 13)])
def test_scan_of_lists_in_batches(most, step, monkeypatch):
    import pyarrow as pa

    gathered = ngram_join._gathered
    monkeypatch.setattr(ngram_join, "_gathered", lambda batches, least: gathered(batches, step))

    rnd = random.Random(most)
    rows = sorted((rnd.choice([1, 2, 3, 5, 8, 9]) if rnd.random() < 0.5 else rnd.randint(10, 60), rnd.randint(-99, 99), 10, rnd.randint(0, 4)) for _ in range(150))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[k : k + step]), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["token", "sid", "n", "pos"]) for k in range(0, len(rows), step)]
    got = [r for b in ngram_join._scan_lists(most)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    lists = {}
    for r in rows:
        lists.setdefault(r[0], []).append(r)
    pairs = {(min(x[1], y[1]), max(x[1], y[1])) for v in lists.values() if len(v) <= most for i, x in enumerate(v) for y in v[:i] if x[1] != y[1] and x[3] <= 1 and y[3] <= 1}
    assert {r[:2] for r in got if r[2] is None} == pairs
    assert sorted(r for r in got if r[2] is not None) == sorted(r for v in lists.values() if len(v) > most for r in v)


def test_long_lists_that_were_not_moved(docs_of, monkeypatch):
    """Beyond MOVED shingles the result is the same."""
    monkeypatch.setattr(ngram_join, "MOVED", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = near_copies(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(docs_of(rows), 4, 6).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("most", [0, 7, 12])
def test_small_sets_give_the_same_at_any_boundary(docs_of, monkeypatch, most):
    rows = near_copies(4)
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes, scanned: most)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(docs_of(rows)).collect()) == brute_components(rows)


def test_join_of_nulls_and_repeated_ids(docs_of):
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None)])
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.report(docs).collect()) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (7, 0, 7)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 7]
    assert ngram_join.report(docs_of([])).count() == 0


def test_bitmaps_bound_differences():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rnd.integers(-(1 << 62), 1 << 62, rnd.integers(1, 300)))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.8], rnd.integers(-(1 << 62), 1 << 62, 30)]))
        assert ngram_join.least_difference(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(np.setxor1d(a, b))


def test_boundary_follows_cost():
    assert ngram_join.boundary({}, 1.0) == 0
    few, many = ngram_join.boundary({n: 100 for n in range(1, 16)}, 0.5), ngram_join.boundary({n: 100 for n in range(1, 16)}, 60.0)
    assert few < many


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1 and got[0] != got[100]


# quality


def test_quality_holds_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    rows = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    table = {(r.quality, r.predicted): r["count"] for r in rows.groupBy("quality", "predicted").count().collect()}
    assert table.get((1, 1), 0) >= 0.97 * (table.get((1, 1), 0) + table.get((1, 0), 0))
    assert table.get((0, 0), 0) >= 0.8 * (table.get((0, 0), 0) + table.get((0, 1), 0))


def test_quality_edges(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, None), (2, ""), (2, "x " * 50_000), (None, "a\n\nb")])
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    odd = spark.createDataFrame([(1, 7, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], none.schema)
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, odd).collect())
    assert quality.scored(docs, quality.AdditiveModel()).columns[-2:] == ["score", "predicted"]
    assert quality.classify(docs_of([]), none).count() == 0


def plain_features(text):
    """The features by their words, one at a time."""
    import math

    words, n = text.split(), len(text.split())
    if not n:
        return [0.0] * len(quality.FEATURES)
    data = [b for b in text.encode() if b not in b" \t\n\v\f\r"]
    small, big, digit = (sum(lo <= b <= hi for b in data) for lo, hi in ((97, 122), (65, 90), (48, 57)))
    symbol = sum(32 < b < 127 for b in data) - small - big - digit
    odd = [w for w in words if not w[-1].isalnum() and (w[-1] not in ".,;:?!" or w[-2:-1] == w[-1])]
    stops = [w for w in words if w[-1] in ".?!" and w[-2:-1] != w[-1]]
    lines = [x for x in text.split("\n") if x]
    pairs = [(a, b) for a, b in zip(words, words[1:])]
    return [
        math.log(1 + n), len(text) / n, (len(data) - digit - symbol) / max(1, len(data)), big / max(1, small + big), digit / max(1, len(data)), symbol / max(1, len(data)), len(odd) / n, len(set(words)) / n,
        max(words.count(w) for w in set(words)) / n, 1 - len(set(pairs)) / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)), sum(len(w) <= 3 for w in words) / n, len(stops) / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
    ]


def test_scores_equal_additions_one_by_one(spark, sf_dir):
    """Features of whole texts, bins, tables and their sum, recomputed for each row."""
    import math

    from spanforge.llm.common import documents

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(-1, "A!! b?? U.S. 12 ÄÖ x\n\nx\n é…"), (-2, " \n"), (-3, None), (-4, "…"), (-5, "wow " * 3000)], "doc_id long, text string")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").unionByName(odd).collect()]
    model = quality.train(docs, labels)
    got = {(r.doc_id, r.text or ""): (r.score, r.predicted) for r in quality.scored(docs.select("doc_id", "text").unionByName(odd), model).collect()}
    for i, text in rows:
        x = plain_features(text)
        assert np.allclose(x, quality.features(text), rtol=1e-12, atol=1e-12), i
        x = quality.features(text)  # the last bit decides about a bin
        raw = model.intercept + sum(t[sum(e < v for e in edges)] for edges, t, v in zip(model.edges, model.tables, x))
        raw += sum(t[sum(e < x[a] for e in model.coarse[a])][sum(e < x[b] for e in model.coarse[b])] for (a, b), t in model.pairs.items())
        score, predicted = got[i, text]
        assert abs(score - 1 / (1 + math.exp(-raw))) < 1e-12 and predicted == (score >= 0.3)


def test_trees_take_the_best_split():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        g, h = rnd.normal(size=9), rnd.uniform(0.1, 2, 9)
        gain = {k: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (slice(0, k), slice(k, 9))) for k in range(1, 9) if h[:k].sum() >= 0.5 and h[k:].sum() >= 0.5}
        best = max(gain, key=gain.get)
        expected = np.r_[[g[:best].sum() / (h[:best].sum() + 1)] * best, [g[best:].sum() / (h[best:].sum() + 1)] * (9 - best)]
        if gain[best] <= g.sum() ** 2 / (h.sum() + 1):
            expected = np.full(9, g.sum() / (h.sum() + 1))
        assert np.allclose(quality._shallow_tree(g, h, 1, 0.5), expected)


def test_one_round_of_boosting_is_cyclic():
    """After one round each feature's table is a tree on what the features before have left."""
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 4, (300, 3)).astype(float)
    y = (x[:, 0] + x[:, 2] > rnd.uniform(0, 6, 300)).astype(float)
    model = quality.fit(x, y, rounds=1, n_pairs=0)
    raw = np.full(300, model.intercept)
    for j in range(3):
        p = 1 / (1 + np.exp(-raw))
        bins = np.array([sum(e < v for e in model.edges[j]) for v in x[:, j]])
        g, h = (np.array([v[bins == b].sum() for b in range(len(model.tables[j]))]) for v in (y - p, p * (1 - p)))
        assert np.allclose(model.tables[j], 0.15 * quality._shallow_tree(g, h, 2, 2.0))
        raw += model.tables[j][bins]


def test_pairs_learn_what_single_features_cannot():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality.fit(x, y), quality.fit(x, y, n_pairs=0)
    hits = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert hits(with_pairs) > 0.9 > hits(without)


# fingerprints


def tone(n, seed, noise=2.0):
    rnd = np.random.default_rng(seed)
    return (128 + 60 * np.sin(np.cumsum(np.repeat(rnd.uniform(0.1, 1.2, n // 400 + 1), 400)[:n])) + rnd.normal(0, noise, n)).clip(0, 255).astype(np.uint8).tobytes()


def recordings(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text binary")


def test_filters_equal_direct_sums():
    """Areas of the integral image against sums of frames."""
    frames = chroma.pitch_frames(tone(3000, 3))
    got = chroma.filtered(frames)
    for t in (0, 5, len(got) - 1):
        for k, (kind, low, high, width) in enumerate(chroma.FILTERS):
            part = frames[t : t + width, low : low + high]
            half, quarter = high // 2, high // 4
            if kind == 0:
                first = part[:, :half].sum()
            elif kind == 1:
                first = part[: width // 2].sum()
            elif kind == 2:
                first = part[: width // 2, :half].sum() + part[width // 2 :, half:].sum()
            elif kind == 3:
                first = part[:, quarter : high - quarter].sum()
            else:
                first = part[width // 4 : width - width // 4].sum()
            assert abs(got[t, k] - (np.log1p(first) - np.log1p(part.sum() - first))) < 1e-9


def test_pitch_frames_fold_the_spectrum():
    x = np.frombuffer(tone(400, 9), np.uint8).astype(float) - 128
    frames = chroma.pitch_frames(tone(400, 9))
    for t in (0, 7):
        power = np.abs(np.fft.rfft(x[t * chroma.HOP : t * chroma.HOP + chroma.FRAME] * np.hanning(chroma.FRAME))) ** 2
        folded = np.zeros(12)
        for k, v in enumerate(power):
            hertz = k * chroma.RATE / chroma.FRAME
            if chroma.LOWEST <= hertz <= chroma.HIGHEST:
                folded[round(12 * np.log2(hertz / 440)) % 12] += v
        assert np.allclose(frames[t], folded / np.linalg.norm(folded), atol=1e-4)


def test_codes_pack_gray_steps():
    values = chroma.filtered(chroma.pitch_frames(tone(500, 4)))
    code = int(chroma.fingerprint(chroma.pitch_frames(tone(500, 4)))[3])
    steps = [sum(b < v for b in chroma.STEPS) for v in values[3]]
    assert [[0, 1, 3, 2].index(code >> 2 * (15 - k) & 3) for k in range(16)] == steps
    assert (chroma.fingerprint(chroma.pitch_frames(tone(9000, 4)), 50) == chroma.fingerprint(chroma.pitch_frames(tone(9000, 4)))).all()


def test_fingerprints_align_a_shifted_recording(spark):
    whole = tone(20_000, 1)
    other = np.random.default_rng(2).integers(0, 256, 20_000, np.uint8).tobytes()
    rows = [(0, whole), (1, whole[10 * chroma.HOP :]), (2, other), (3, None), (4, b"short"), (20, whole)]
    got = {r.doc_id: r for r in chroma.report(recordings(spark, rows)).collect()}
    assert (got[0].match_id, got[0].match_offset, got[1].match_id, got[1].match_offset) == (1, -10, 0, 10) and got[0].bit_error_rate < 0.01
    assert got[20].class_id == 0 and got[3].n_codes == 0 and got[4].match_id is None
    assert [got[i].component_id for i in (0, 1, 2, 3, 4, 20)] == [0, 0, 2, 3, 4, 0]


def brute_matches(prints, every):
    """Classes (codes -> ids), and the matches of queries with all others by all places of equal pairs of codes."""
    classes = {}
    for r in prints.collect():
        classes.setdefault(tuple(c & 0xFFFFFFFF for c in r.codes), []).append(r.id)
    places = {a: [(i, k) for i, k in enumerate(zip(a, a[1:])) if i == 0 or (a[i - 1], a[i]) != k] for a in classes}
    found = set()
    for a, ids in classes.items():
        if any(i is not None and i % every == 0 for i in ids):
            for b in classes:
                votes = {}
                for i, k in places[a]:
                    for j, m in places[b]:
                        if k == m:
                            votes[j - i] = votes.get(j - i, 0) + 1
                if a != b and votes:
                    offset = max(votes, key=lambda o: (votes[o], -o))
                    if votes[offset] >= chroma.MIN_VOTES and chroma.bit_errors(np.array(a), np.array(b), offset) <= chroma.MAX_ERROR:
                        found.add((a, b))
    return classes, found


def reached(classes, links):
    """Ids to the smallest id that links lead to."""
    parent = {a: a for a in classes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    low = {}
    for a, ids in classes.items():
        low[root(a)] = min([*ids, low.get(root(a), min(ids))])
    return sorted((i, min(ids), low[root(a)]) for a, ids in classes.items() for i in ids)


@pytest.mark.parametrize("seed", [2, 3])
def test_components_of_recordings_equal_brute_force(docs_of, seed):
    """Passages at many offsets, groups of near copies, a pair of codes again and again."""
    from spanforge.llm.common import cut

    rnd = random.Random(seed)
    noise = lambda n: "".join(chr(rnd.randint(32, 126)) for _ in range(n))
    shared = [noise(rnd.randint(150, 900)) for _ in range(6)]
    texts = [noise(chroma.HOP * rnd.randint(0, 9)) + rnd.choice(shared) + noise(rnd.randint(0, 300)) for _ in range(70)]
    texts += [x[: rnd.randint(200, 600)] + noise(40) + x[-200:] for x in [noise(700)] for _ in range(25)]
    texts += ["ab" * 300, "ab" * 400 + "z", "", "x"]
    docs = docs_of([*enumerate(texts + texts[:9])])
    prints = cut(chroma.fingerprints(docs, "doc_id", "text"), "test")
    classes, links = brute_matches(prints, 7)
    got = sorted((r.doc_id, r.class_id, r.component_id) for r in chroma.report(docs, every=7).collect())
    assert got == reached(classes, links) and len(links) > 30


def test_short_recordings_have_codes_and_classes(spark):
    noise = lambda n, seed: np.random.default_rng(seed).integers(0, 256, n, np.uint8).tobytes()
    window = chroma.FRAME + (chroma.WIDTH - 1) * chroma.HOP
    rows = [(1, noise(100, 1)), (2, noise(100, 1)), (3, noise(100, 2)), (4, b"x"), (5, b"x"), (6, None), (7, b""), (8, noise(window - 1, 3)), (9, noise(window, 3))]
    got = {r.doc_id: r for r in chroma.report(recordings(spark, rows)).collect()}
    assert {i: got[i].n_codes for i in got} == {1: -(-100 // chroma.HOP), 2: -(-100 // chroma.HOP), 3: -(-100 // chroma.HOP), 4: 1, 5: 1, 6: 0, 7: 0, 8: -(-(window - 1) // chroma.HOP), 9: 1}
    assert {i: got[i].class_id for i in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9}
    assert {i: got[i].component_id for i in got} == {i: got[i].class_id for i in got} and got[4].match_id is None


def test_fingerprints_of_odd_tables(spark):
    """Empty tables, repeated and null ids, clashing columns, a very long recording, ties of the best match."""
    assert chroma.report(recordings(spark, [])).count() == 0
    noise = lambda n, seed: np.random.default_rng(seed).integers(0, 256, n, np.uint8).tobytes()
    base = noise(4000, 5)
    rows = [(0, base), (0, base), (0, noise(4000, 6)), (None, base), (None, b"only"), (3, base + noise(800, 7)), (2, base + noise(800, 8)), (60, noise(1_500_000, 9)), (61, noise(1_500_000, 9)[5 * chroma.HOP :])]
    df = recordings(spark, rows).withColumns({c: F.lit("z") for c in ("id", "uid", "codes", "digest", "class")})
    got = chroma.report(df).collect()
    shown = sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.component_id) for r in got if r.class_id is not None)
    assert shown == [(False, 0, 0, 0)] * 3 + [(False, 2, 2, 0), (False, 3, 3, 0), (False, 60, 60, 60), (False, 61, 61, 60), (True, 0, 0, 0)]
    assert [(r.component_id, r.match_id) for r in got if r.class_id is None] == [(None, None)]
    assert sorted((r.match_id or 0) for r in got if r.doc_id == 0) == [0, 2, 2]  # of equal ones the smallest name; the third has none
    long = next(r for r in got if r.doc_id == 60)
    assert (long.match_id, long.match_offset, long.n_codes) == (61, -5, (1_500_000 - chroma.FRAME) // chroma.HOP + 1 - chroma.WIDTH + 1)


def test_all_places_of_a_motif_vote():
    rnd = np.random.default_rng(6)
    a, b, c = (rnd.integers(0, 1 << 32, n) for n in (150, 60, 140))
    whole, part = np.concatenate([a, b, a, c]), np.concatenate([a, c])
    assert chroma.offset_votes(whole, part) == (-210, 289)


def test_a_match_at_a_less_voted_offset():
    """A passage that stands twice in one recording has more votes out of place than the recordings have in place."""
    rnd = np.random.default_rng(7)
    a = rnd.integers(0, 1 << 32, 100)
    b = a.copy()
    b[::2] ^= 1
    b[40:44] = a[40:44]
    b = np.concatenate([a[60:70], b])
    assert chroma.offset_votes(a, b) == (-60, 9) and chroma.bit_errors(a, b, -60) > chroma.MAX_ERROR
    assert chroma.matched(a, b) == (10, 4, 48 / 3200)
    assert chroma.matched(a, b, min_votes=10) is None and chroma.matched(a, rnd.integers(0, 1 << 32, 50)) is None


@pytest.mark.parametrize("seed", [4, 5])
def test_all_matches_of_queries_are_rated(docs_of, seed):
    """Each match with a query counts, also between recordings that others connect; the best of all is shown."""
    rnd = random.Random(seed)
    noise = lambda n: "".join(chr(rnd.randint(32, 126)) for _ in range(n))
    base = [noise(900) for _ in range(3)]
    texts = [x[: (k := rnd.randint(300, 800))] + noise(rnd.choice([0, 7, 32])) + x[k:] + noise(rnd.randint(0, 200)) for x in base for _ in range(22)]
    texts += [x[320:640] + x[:300] + noise(9) + x[300:] for x in base for _ in range(3)] + ["ab" * 300, "", "x"]
    docs = docs_of([*enumerate(texts + texts[:9])])
    classes = {}
    for i, x in enumerate(texts + texts[:9]):
        classes.setdefault(tuple(chroma.fingerprint(chroma.pitch_frames(chroma.padded(x.encode())))), []).append(i)
    codes, ids = [np.array(x, np.int64) for x in classes], list(classes.values())
    asked = [any(i % 7 == 0 for i in x) for x in ids]
    links = {}
    for i, a in enumerate(codes):
        places = {}
        for at in range(len(a) - 1):
            if at == 0 or (a[at - 1], a[at]) != (a[at], a[at + 1]):
                places.setdefault((a[at], a[at + 1]), []).append(at)
        for j, b in enumerate(codes):
            votes = {}
            for at in range(len(b) - 1):
                if at == 0 or (b[at - 1], b[at]) != (b[at], b[at + 1]):
                    for other in places.get((b[at], b[at + 1]), []):
                        votes[at - other] = votes.get(at - other, 0) + 1
            errors = [chroma.bit_errors(a, b, o) for o, n in votes.items() if n >= chroma.MIN_VOTES]
            if i != j and (asked[i] or asked[j]) and errors and min(errors) <= chroma.MAX_ERROR:
                links.setdefault(i, set()).add(j)
    got = {r.doc_id: r for r in chroma.report(docs, every=7).collect()}
    assert {i: got[i].n_links for x in ids for i in x} == {i: len(links.get(k, ())) for k, x in enumerate(ids) for i in x}
    names = {k: {x[0] for x in (ids[j] for j in js)} for k, js in links.items()}
    assert sum(len(x) for x in names.values()) > 300 and all(got[i].match_id in names.get(k, {None}) for k, x in enumerate(ids) for i in x)


def test_edited_copies_are_found(spark):
    """Texts of 150 words of which one is another: four of five at least are found, and nothing else."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    rows = []
    for k in range(60):
        words = [word() for _ in range(150)]
        rows.append((20 * k, " ".join(words).encode()))
        words[rnd.randrange(150)] = word()
        rows.append((20 * k + 1, " ".join(words).encode()))
    found = {(r.component_id, r.doc_id) for r in chroma.report(recordings(spark, rows)).collect() if r.component_id != r.doc_id}
    assert len(found) >= 48 and all(b - a == 1 and a % 20 == 0 for a, b in found)


def test_columns_with_clashing_names_pass_unchanged(docs_of):
    docs = docs_of([(i, f"words {i}", f"s{i % 3}") for i in range(9)])
    for out in (mixture.emit(docs), quality.accepted(docs, quality.AdditiveModel()), exact_dedup.deduplicate(docs), ngram_join.one_of_each(docs)):
        assert out.columns == docs.columns
        assert {(r["size"], r.score, r.copies, r.digest, r.n, r.row) for r in out.collect()} == {("x",) * 6}
