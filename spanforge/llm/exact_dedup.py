"""Exact deduplication by a stateful stream [native].

A Structured Streaming aggregation without watermark keeps, in RocksDB (disk-backed, never expired), one entry for each
SHA-256 digest: the stable identifier of the row that stays, its content locator (file and row index) and the number of
rows seen. The stream reads the digests in batches of at most ``BATCH_BYTES``. Digests that were hit are then checked on
full bytes, those of earlier calls by their locators. DataFrame functions only; the driver's ``foreachBatch`` hook only
starts a write.

A ``Store`` is a folder that keeps digests, state and the stream's checkpoint from call to call: later documents meet what
earlier ones left, and a call that was broken off is taken up where its stream stood. Without one, the state goes with the
driver.

Defined results: a null text counts as empty; identifiers may be null (null is smallest) or repeated - of rows with the
same text and identifier exactly one stays, that with the largest locator; an empty table gives an empty result; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_side, cut_to, drop_tables, is_broadcast, located, shared_path, without_rows

#: State on disk: no preallocated files (megabytes for each partition of small state), native memory with a bound for all
#: partitions of an executor, and none of it held once a batch is committed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Settings of the caller's session that the stream's own session takes over.
_SHARED = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone")
#: Digests (of about 50 bytes) that one batch of the stream takes at most.
BATCH_BYTES = 1 << 30
#: The states of digests that more rows have go to the rows; so many rows don't go to one task.
HOT_GROUP = 100_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Store:
    """A folder for digests (a folder in it for each call), states, the checkpoint of a stream, files whose hits have been
    checked, and digests that differing texts share."""

    path: str

    def __getattr__(self, part: str) -> str:
        if part in ("digests", "states", "stream", "checked", "differ"):
            return f"{self.path}/{part}"
        raise AttributeError(part)

    def add(self, digests: DataFrame) -> None:
        """Digests appear in the store at once or, if writing them fails, not at all."""
        spark, name = digests.sparkSession, uuid.uuid4().hex
        digests.write.parquet(f"{self.path}/incoming/{name}")
        jvm = spark.sparkContext._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}") for x in (f"incoming/{name}", "digests"))
        fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        if not fs.rename(source, jvm.org.apache.hadoop.fs.Path(target, name)):
            raise OSError(f"{source} could not be moved to {target}")


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def _stream(spark: SparkSession, store: Store, schema, batch_bytes: int) -> DataFrame:
    """Run those of the digests through the state that it hasn't seen; the last state of each digest."""
    own = spark.newSession()  # its settings are the stream's alone
    for key in _SHARED:
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    for key, value in STATE_STORE.items():
        own.conf.set(key, value)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.states}/batch={number}")

    digests = own.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{store.digests}/*")
    state = digests.groupBy("digest").agg(F.max("at").alias("keeper"), F.min("at").alias("first"), F.count(F.lit(1)).alias("group_size"))
    query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", store.stream).trigger(availableNow=True).start()
    query.awaitTermination()
    states = _read(spark, store.states, state.schema)
    # all parts of a state only go one way, so the last one has the extremes
    return states.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def _plain_text(docs: DataFrame) -> bool:
    """Whether ``text`` is the column of that name of the files that locators lead to."""
    plan = docs._jdf.queryExecution().analyzed()
    node, out = plan, plan.output()
    while node.children().size() == 1:
        node = node.children().apply(0)
    return any(out.apply(i).name() == "text" and node.outputSet().contains(out.apply(i)) for i in range(out.size()))


def _content(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """digest, at and text of ``rows`` (digest, at) of earlier calls, read at their locators."""
    files = [r["file"] for r in rows.select("at.file").distinct().collect()]  # names of files only
    if not files:
        return rows.select("digest", "at", F.lit("").alias("text"))
    texts = spark.read.parquet(*files).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("_sf_file"), F.col("_metadata.row_index").alias("_sf_row"))
    return rows.join(texts, (F.col("at.file") == F.col("_sf_file")) & (F.col("at.row") == F.col("_sf_row"))).select("digest", "at", "text")


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with the state of their digest."""
    hot = bounded_side(state.where(F.col("group_size") > HOT_GROUP))
    if not is_broadcast(hot) or not hot.limit(1).count():
        return rows.join(state, "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(state.where(F.col("group_size") <= HOT_GROUP), "digest")
    return rows.join(hot, "digest").unionByName(rest)


def classify(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, store: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs`` (with ``store``: of all documents that it has met): doc_id, file, row (its locator),
    digest, keep_id, group_size, kept.

    ``digest`` may be weaker than SHA-256: texts that share a digest but differ are told apart by their bytes. A store
    passes over files that it has met, and their rows must stay in place, as their texts are read again on hits.
    """
    spark = docs.sparkSession
    docs = located(docs)
    if store is not None and not _plain_text(docs):
        raise ValueError("a store finds texts again by file and row: write the documents first")
    place = Store(store or shared_path(spark, "dedup"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.col("doc_id").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keyed = docs.select(text.alias("text"), digest(text).alias("digest"), row.alias("at"))
    rows, schema = keyed.select("digest", "at"), keyed.select("digest", "at").schema
    if store is not None:
        met = _read(spark, f"{place.digests}/*", schema).select(F.col("at.file").alias("_sf_met")).distinct()
        rows = rows.join(bounded_side(met), F.col("at.file") == F.col("_sf_met"), "left_anti")
    place.add(rows)
    staged = spark.read.schema(schema).parquet(f"{place.digests}/*")
    state, _ = cut_to(_stream(spark, place, schema, batch_bytes), "dedup-final")

    hit = state.where("group_size > 1")
    if store is None:
        texts = keyed.join(bounded_side(hit.select("digest")), "digest", "left_semi")
    else:  # what this call, or one that was broken off, has brought, and what the state has kept of earlier ones
        checked = bounded_side(_read(spark, place.checked, "_sf_file string"))
        fresh, _ = cut_to(staged.join(checked, F.col("at.file") == F.col("_sf_file"), "left_anti"), "dedup-fresh")
        hit = hit.join(bounded_side(fresh.select("digest").distinct()), "digest", "left_semi")
        both = fresh.join(hit.select("digest"), "digest", "left_semi").unionByName(hit.select("digest", F.col("first").alias("at")))
        texts = _content(spark, both)
    clashes = texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")
    if store is None:
        differ, differ_path = cut_to(clashes, "dedup-differ")
    else:
        clashes.write.mode("append").parquet(place.differ)
        fresh.select(F.col("at.file").alias("_sf_file")).distinct().write.mode("append").parquet(place.checked)
        differ = _read(spark, place.differ, clashes.schema).distinct()

    joined = _with_state(staged, state.drop("first"))
    if differ.limit(1).count():
        clash = keyed.join(differ, "digest", "left_semi") if store is None else _content(spark, staged.join(differ, "digest", "left_semi"))
        classes = clash.groupBy("digest", "text").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        joined = joined.join(differ, "digest", "left_anti").unionByName(clash.join(classes, ["digest", "text"]).drop("text"))
    elif store is None:
        drop_tables(spark, differ_path)
    return joined.select(
        F.col("at.id").alias("doc_id"),
        F.col("at.file").alias("file"),
        F.col("at.row").alias("row"),
        "digest",
        F.col("keeper.id").alias("keep_id"),
        "group_size",
        F.col("at").eqNullSafe(F.col("keeper")).alias("kept"),
    )


def report(docs: DataFrame, store: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return classify(docs, store=store).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = located(docs)
    return without_rows(docs, classify(docs).where("not kept"))
