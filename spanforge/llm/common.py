"""Helpers shared by the operators of this subpackage: shared storage, cut lineage, bounded broadcasts."""

from __future__ import annotations

import ctypes
import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StringType, StructType

from ..sources.scratch import cut, cut_to, drop, shared_path

__all__ = ["bounded_side", "cut", "cut_to", "documents", "drop_tables", "is_broadcast", "located", "locator", "shared_path", "short_batches", "trimmed", "without_rows", "word_count"]

#: A side with at most this many rows and bytes may be broadcast; above either the join is shuffled.
BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 8 << 20
#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Plan nodes that keep a file's rows one by one: at most one row comes out for each row of the file.
_ROW_BY_ROW = frozenset(("Project", "Filter", "SubqueryAlias", "View"))

drop_tables = drop


def _one_file_relation(df: DataFrame) -> bool:
    """Whether ``df`` only filters and projects, always alike, the rows of one file relation that reads no file twice."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.children().size() == 1:
        if node.nodeName() not in _ROW_BY_ROW:
            return False
        node = node.children().apply(0)
    if node.nodeName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = node.relation().location().rootPaths()
    paths = sorted(f"{roots.apply(i).toString().rstrip('/')}/" for i in range(roots.size()))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def located(df: DataFrame) -> DataFrame:
    """Rows of files as they are; anything else (joins, exploded or united rows, limits, random filters, other sources) is
    written first. Each row then has a locator of its own that stays the same: ``_metadata.file_path`` and
    ``_metadata.row_index``."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        plain = _one_file_relation(df)
    except AnalysisException:
        plain = False
    return df if plain else cut(df, "located")


def locator(file: str, row: str) -> list[Column]:
    """A locator in 24 bytes: two hashes of the path, which has no bounded length, and the row."""
    return [F.xxhash64(file).alias("_sf_file"), F.xxhash64(file, F.lit(1)).alias("_sf_more"), F.col(row).alias("_sf_row")]


def without_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a located ``df`` but those whose locators ``gone`` has as ``file`` and ``row``."""
    gone = cut(gone.select(*locator("file", "row")), "gone")
    at = df.select("*", *locator("_metadata.file_path", "_metadata.row_index"))
    return at.join(bounded_side(gone), ["_sf_file", "_sf_more", "_sf_row"], "left_anti").select(*df.columns)


def _bytes(column: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
            raise TypeError(f"the size of {kind.simpleString()} isn't counted")
        return F.greatest(F.size(column), F.lit(0)) * (4 if isinstance(kind.elementType, IntegerType) else 8) + 24
    if isinstance(kind, StructType):
        return functools.reduce(lambda a, b: a + b, [_bytes(column[f.name], f.dataType) for f in kind.fields], F.lit(8))
    return F.lit(8)


def bounded_side(df: DataFrame, limit: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows of at most ``most_bytes`` in all (measured; of more
    rows only one beyond the limit is looked at); else as it is, so that the join is shuffled and adaptive execution splits
    its hot keys."""
    few = df.limit(limit + 1)
    size = functools.reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(8))
    n, total = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= most_bytes else df


def is_broadcast(df: DataFrame) -> bool:
    """Whether ``bounded_side`` has found that ``df`` may be broadcast."""
    return df._jdf.queryExecution().logical().nodeName() in ("ResolvedHint", "UnresolvedHint")


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts go to Python in batches of this many rows at most: the usual 10,000 whole texts, held by the JVM and by the
    worker, would take hundreds of megabytes. The session keeps a smaller setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trimmed(work):
    """A function over Arrow batches that, when it is done, gives freed memory back to the system: idle Python workers
    count as their executor's memory."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
