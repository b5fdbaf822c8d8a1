"""The pipeline's stages, each against what it is to keep of its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
import pytest
from test_corpus import brute_components

from spanforge.llm.common import cut, documents


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        out = cut(stage(spark, docs, sf_dir), f"test-{k}")
        if k + 1 < len(C.STAGES):
            assert out.columns == docs.columns, name
            after = [(r.doc_id, r.text, r.source) for r in out.collect()]
            assert set(after) <= set(before)
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            kept = {i for i, _, _ in after}
            good = [i for i, _, _ in before if labels.get(i) == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good)
        elif k == 1:
            largest = {}
            for i, t, _ in before:
                largest[t or ""] = max(i, largest.get(t or "", i))
            assert sorted(i for i, _, _ in after) == sorted(largest.values())
        elif k == 2:
            assert sorted(i for i, _, _ in after) == sorted({c for _, _, c in brute_components([(i, t) for i, t, _ in before])})
        elif k == 3:
            assert max(Counter(i for i, _, _ in after).values()) <= 3
        else:
            assert out.count() == len(before) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs, before = out, after
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding and decoding"]


@pytest.mark.parametrize("rows", [[], [(i, None) for i in range(5)], [(1, "a b c d e f g")] * 3 + [(1, "a b c d e f g h"), (None, "x"), (None, None), (2, "")]], ids=["empty", "nulls", "repeated ids"])
def test_stages_of_odd_tables(spark, docs_of, tmp_path, rows):
    """Empty tables, tables of null texts, and repeated and null ids pass through all stages."""
    docs = docs_of(rows)
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").where("false").write.parquet(f"{tmp_path}/sf/labels.parquet")
    before = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    out = docs
    for k, (name, stage) in enumerate(C.STAGES):
        out = cut(stage(spark, out, f"{tmp_path}/sf"), f"odd-{k}")
        if k + 1 < len(C.STAGES):
            assert out.columns == docs.columns, name
            after = sorted((str(r.doc_id), r.text or "") for r in out.collect())
            assert set(after) <= set(before) and (k or after == before)  # without labels no document is rejected
        if k == 1:
            assert len(after) == len({t for _, t in before})
    assert C.run(spark, f"{tmp_path}/sf").count() == out.count()
