"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in a cycle, are summed into one lookup table per feature; the pairs of features
with the largest remaining gain get two-dimensional tables in the same way. A text is scored by adding the entries of its
bins. The model is fitted on the driver from a bounded sample of labelled rows (``SAMPLE_ROWS``, drawn by hash of doc_id);
features and scores are computed over whole texts where these lie.

Defined results: a null text is scored as the empty text; without usable labels each score is 0.5; labels other than 0 and
1 are passed over; of several labels of a doc_id the smallest counts; rows with the same doc_id are each scored; an empty
table gives an empty result; columns named like a new column are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: The model is fitted on at most so many labelled documents.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "letters", "capitals", "digits", "symbols", "odd_ends", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "short_words", "sentence_ends", "all_caps")
_KIND = np.full(256, 5, np.uint8)  # bytes: 0 white space, 1 small letter, 2 capital, 3 digit, 4 symbol, 5 beyond ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4
_ENDS = frozenset(".,;:?!")


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    kinds = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=6)
    chars = max(1, int(kinds[1:].sum()))
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    odd = short = stops = caps = 0
    for w, k in counts.items():
        last = w[-1]
        if not last.isalnum():
            if last not in _ENDS or (len(w) > 1 and w[-2] == last):
                odd += k
            elif last in ".?!":
                stops += k
        if len(w) <= 3:
            short += k
        if w.isupper() and len(w) > 1:
            caps += k
    return [
        float(np.log1p(n)),
        len(text) / n,
        float(kinds[1] + kinds[2] + kinds[5]) / chars,
        float(kinds[2]) / max(1, int(kinds[1] + kinds[2])),
        float(kinds[3]) / chars,
        float(kinds[4]) / chars,
        odd / n,
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(pairs) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        short / n,
        stops / n,
        caps / n,
    ]


@dataclass
class AdditiveModel:
    """Lookup tables over bins; ``edges`` has the upper bounds of each feature's bins but the last."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (first feature, second feature) -> table over the coarse bins of both
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="left")]
        if self.pairs:
            low = {j: np.searchsorted(self.coarse[j], x[:, j], side="left") for p in self.pairs for j in p}
            for (i, j), t in self.pairs.items():
                out += t[low[i], low[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Newton steps of a tree over the bins of one feature, from the sums of gradients and hessians in each bin."""
    step = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0), -1.0)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1.0):
            step = np.concatenate([_shallow_tree(g[:k], h[:k], depth - 1, least), _shallow_tree(g[k:], h[k:], depth - 1, least)])
    return step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, depth: int = 2, least: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets a shallow tree on what is left; then the pairs."""
    if not len(y):
        return AdditiveModel()
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return model
    model.edges = [_edges(c, bins) for c in x.T]
    model.coarse = [_edges(c, coarse) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, c, side="left") for e, c in zip(model.edges, x.T, strict=True)]
    raw = np.full(len(y), model.intercept)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = left()
            step = rate * _shallow_tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), depth, least)
            table += step
            raw += step[at[j]]
    low = [np.searchsorted(e, c, side="left") for e, c in zip(model.coarse, x.T, strict=True)]
    g, h = left()
    gains = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell, n = low[i] * (len(model.coarse[j]) + 1) + low[j], (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)
            gains[i, j] = float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + 1.0)).sum())
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in chosen}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = left()
            cell = low[i] * table.shape[1] + low[j]
            gs, hs = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
            # a split of the first feature, then one of the second on either side
            rows = _shallow_tree(gs.sum(1), hs.sum(1), 1, least)
            cutat = int(np.argmax(rows != rows[0])) if (rows != rows[0]).any() else table.shape[0]
            step = np.zeros(table.shape)
            for part in (slice(0, cutat), slice(cutat, table.shape[0])):
                if part.start < part.stop:
                    step[part] = rate * _shallow_tree(gs[part].sum(0), hs[part].sum(0), 1, least)
            table += step
            raw += step[low[i], low[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows of ``docs`` that are not held out."""
    short_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("_sf_quality"))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounds the broadcast and what the driver gets
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kept = rows.select(F.col("doc_id").cast("long"), "text", F.col("_sf_quality").cast("int")).mapInArrow(run, "doc_id long, quality int, x array<double>")
    kept = kept.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    if kept.empty:
        return AdditiveModel()
    return fit(np.array(kept["x"].tolist()), kept["quality"].to_numpy(float))


def _score(model: AdditiveModel) -> Column:
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))), index=texts.index)

    return score(F.col("text").cast("string"))


def scored(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    short_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*others, _score(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    short_batches(docs.sparkSession)
    return docs.withColumn("_sf_score", _score(model)).where(F.col("_sf_score") >= threshold).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
