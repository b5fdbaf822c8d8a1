"""BPE encoding and decoding.

A pre-token's symbols form a doubly linked list; a priority queue holds the ranks of the merges of neighbours, and entries
that a merge has made stale are skipped when they come up. Decoding concatenates vocabulary strings. The vocabulary file is
a byte-level BPE as JSON; ids of frequent pre-tokens are remembered, in a dictionary of bounded size.

Defined results: a null text is empty (no ids, empty decoded text); a text of any length is encoded whole; strings of
special tokens inside a text become their ids, as is the library's default; an empty table gives an empty result; columns
named like a new column are replaced; one row comes out for each row that goes in.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Pre-tokens remembered in one Python worker, in each of two generations.
DICTIONARY = 150_000
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 upwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _checked(spec: dict) -> dict:
    """``spec`` if it is a file of the kind that this coder follows; anything else would give other ids without a word."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
    wrong += [] if model.get("type", "BPE") == "BPE" else ["model.type"]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += [] if before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) else ["pre_tokenizer"]
    wrong += [] if (spec.get("decoder") or {}).get("type") == "ByteLevel" else ["decoder"]
    wrong += ["added_tokens"] if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")) else []
    wrong += ["vocab"] if max([*model["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]) >= 1 << 20 else []
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")
    return spec


class BytePairCoder:
    def __init__(self, path: str, size: int = DICTIONARY):
        with open(path, encoding="utf-8") as f:
            spec = _checked(json.load(f))
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        #: left id << 20 | right id -> rank << 20 | merged id; numbers make quicker keys than pairs
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()
        for content, i in self.special.items():
            self.strings[i] = content.encode()
        self.named = {str(i): x for i, x in enumerate(self.strings)}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.size, self.young, self.old = size, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. Queue entries are rank << 32 | position."""
        ids = [self.of_byte[b] for b in piece]
        n, rule = len(ids), self.merges.get
        queue = [r >> 20 << 32 | i for i in range(n - 1) if (r := rule(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j, left = after[i], ids[i]
            if left < 0 or j >= n:
                continue
            r = rule(left << 20 | ids[j])
            if r is None or r >> 20 != entry >> 32:
                continue  # stale: one of the two has been merged meanwhile
            merged = ids[i] = r & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rule(merged << 20 | ids[k])) is not None:
                    heappush(queue, r >> 20 << 32 | i)
            h = before[i]
            if h >= 0 and (r := rule(ids[h] << 20 | merged)) is not None:
                heappush(queue, r >> 20 << 32 | h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.merge(piece.encode())))
        if len(piece) <= 64:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by commas: one short string to remember for each pre-token."""
        out: list[str] = []
        for part in self.cut(text) if self.cut else [text]:
            if part in self.special:
                out.append(str(self.special[part]))
            else:
                known, piece = self.young.get, self._piece
                out += [known(p) or piece(p) for p in self.split(part)]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)
        return list(map(int, ids.split(","))) if ids else []

    def decode_text(self, ids: list[str]) -> str:
        """Text of ids in decimal."""
        return b"".join(map(self.named.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    return _coders.get(path) or _coders.setdefault(path, BytePairCoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, an array of token ids of ``text``."""
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "ids"]

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        return texts.map(lambda t: coder(path).encode(t or ""))

    return docs.select(*kept, ids_of(F.col("text").cast("string")).alias("ids"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; null ids give an empty text."""
    kept = [c for c in rows.columns if c != "decoded"]

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda x: coder(path).decode(x) if x is not None else "")

    return rows.select(*kept, text_of("ids").alias("decoded"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, of every row. The ids stay in the
    task: only digests leave it."""
    short_batches(docs.sparkSession)

    def run(batches):
        own = coder(path)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1).to_pylist():
                joined = own.encode_text(text or "")
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hex.append(hashlib.sha256(own.decode_text(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)
