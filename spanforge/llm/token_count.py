"""Token counts without token ids.

A SentencePiece model whose pieces hold white space only at their start never merges across the place where white space
begins, so a text's count is the sum of the counts of its pre-tokens (a run of spaces and what follows it).

1. Distinct pre-tokens with the number of texts that hold them: gathered in each task first, then by aggregation.
2. Each distinct pre-token's pieces are counted, once in all.
3. Per-document pre-token frequencies are joined to that table and summed. The most frequent pre-tokens (at most ``HEAD`` of
   at most ``HEAD_LENGTH`` characters, so of bounded size) go to each task, where texts lie; what other pre-tokens a
   text has is joined by shuffle. No ids are made, and texts are not shuffled.

Defined results: a null text is empty and has no tokens; a text of any length is counted whole; an empty table gives an
empty result; other columns play no part; one row comes out for each row that goes in.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, trimmed

LIMIT = 4096
#: Pre-tokens that every task gets at most, and their longest length: 400,000 of 48 characters take 19 million characters.
HEAD, HEAD_LENGTH = 400_000, 48
#: Pre-tokens that a task gathers before it passes them on.
GATHERED = 600_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_RUNS = re.compile(r" +[^ ]*|[^ ]+")
_MARK = "▁"


def pretokens(text: str) -> list[str]:
    """Pre-tokens in the order of the text, each without the one space that the model puts before it."""
    text = text.replace(_MARK, " ")
    if text == "":
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


class PieceCounter:
    """Counts the pieces of pre-tokens. A model that changes texts before it cuts them, or whose pieces span white space,
    is an error: its pre-tokens can't be counted one by one."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        if any(_MARK in self.model.id_to_piece(i).lstrip(_MARK) for i in range(self.model.get_piece_size())):
            raise ValueError("a piece of this model spans white space; its pre-tokens can't be counted one by one")
        for text in ("a", " a  b ", "ﬁ Ⅷ\t é　 x\n", "Á ＡＢ"):
            if self.model.normalize(text) != (_MARK + text).replace(" ", _MARK):
                raise ValueError("this model normalises texts or puts no space before them; its pre-tokens can't be counted one by one")

    def pieces(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token; an empty one is a lone space mark."""
        return [len(x) if w else 1 for w, x in zip(words, self.model.encode(words, out_type=str, num_threads=1), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        frequencies = [Counter(pretokens(t)) for t in texts]
        words = sorted(set().union(*frequencies))
        known = dict(zip(words, self.pieces(words), strict=True))
        return [sum(n * known[w] for w, n in f.items()) for f in frequencies]


_counters: dict[str, PieceCounter] = {}


def _counter(model: str) -> PieceCounter:
    return _counters.get(model) or _counters.setdefault(model, PieceCounter(model))


def vocabulary(texts: DataFrame) -> DataFrame:
    """token, n: each distinct pre-token of the column ``text`` and the number of texts that hold it."""

    @trimmed
    def gather(batches):
        found: Counter[str] = Counter()
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(set(pretokens(text or "")))
                if len(found) > GATHERED:
                    yield packed()
                    found.clear()
        yield packed()

    return texts.select("text").mapInArrow(gather, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(tokens: DataFrame, model: str) -> DataFrame:
    """token, n, pieces: the pieces of each distinct pre-token."""

    def run(batches):
        counter = _counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter.pieces(batch.column(0).to_pylist()), pa.int64())], ["token", "n", "pieces"])

    return tokens.select("token", "n").mapInArrow(run, "token string, n long, pieces long")


def _head(counted: DataFrame, most: int) -> tuple[dict[str, int], bool]:
    """The pieces of the most frequent pre-tokens, at most ``most``, and whether these are all. Frequencies are taken by
    powers of two, so that nothing is sorted."""
    power = F.floor(F.log2("n"))
    short = counted.where(F.length("token") <= HEAD_LENGTH)
    sizes = {r["p"]: r["count"] for r in short.groupBy(power.alias("p")).count().collect()}  # at most 63 rows
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        if total + sizes[p] > most:
            break
        least, total = p, total + sizes[p]
    head = short.where(power >= least).select("token", "pieces").toPandas()
    return dict(zip(head["token"], head["pieces"].tolist(), strict=True)), total == counted.count()


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``model`` is the path of a model file on every machine."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = cut(piece_counts(cut(vocabulary(texts), "token-vocabulary"), model), "token-pieces")
    known, all_known = _head(counted, head)
    shared = spark.sparkContext.broadcast(known)
    rest = pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())]))

    @trimmed
    def run(batches):
        pieces = shared.value
        for batch in batches:
            sizes, sums, others = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                frequencies = Counter(pretokens(text))
                try:
                    n, other = sum([k * pieces[w] for w, k in frequencies.items()]), []
                except KeyError:
                    n = sum([k * pieces.get(w, 0) for w, k in frequencies.items()])
                    other = [{"token": w, "times": k} for w, k in frequencies.items() if w not in pieces]
                sizes.append(len(text.encode()))
                sums.append(n)
                others.append(other)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(others, rest)], ["uid", "doc_id", "n_bytes", "n_tokens", "rest"])

    numbered = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    rows = numbered.mapInArrow(run, "uid long, doc_id long, n_bytes long, n_tokens long, rest array<struct<token:string,times:long>>")
    if not all_known:
        rows = cut(rows, "token-rows")  # uid stays as it is from here on
        left = rows.select("uid", F.explode("rest").alias("r")).select("uid", "r.token", "r.times")
        sums = left.join(counted.select("token", "pieces"), "token").groupBy("uid").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
        rows = rows.join(sums, "uid", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
