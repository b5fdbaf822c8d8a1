"""Ingest of event logs as they arrive: zones close incrementally, statistics follow.

The log is a directory of files of ``trace_events``. Per (capture, thread) the state is the stack of open zones; it never
expires, as a zone may stay open to the end of a capture. Batches may bring events of any thread; within a batch they are
ordered by (time, seq). An event that comes in a later batch than one after it can't be nested where it belongs: each zone
that closes from then on tells in ``late`` how many such events its thread has had.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = "capture_id string, thread long, zone_id long, name string, start long, end long, depth int, parent_id long, reentrant boolean, dur long, self_time long, late long"


def event_log(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _close_zones(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    capture, thread = key
    # [zone id, name, start, time of closed children] of each open zone; time and seq of the last event; late events
    stack, last, late = json.loads(state.get[0]) if state.exists else ([], [-(1 << 62), 0], 0)
    rows = []
    batch = pd.concat(list(frames)).sort_values(["time", "seq"], kind="stable")
    late += sum((int(t), int(s)) < tuple(last) for t, s in zip(batch["time"], batch["seq"], strict=True))
    last = max(last, [int(batch["time"].iloc[-1]), int(batch["seq"].iloc[-1])])
    for kind, time, seq, name in zip(batch["kind"], batch["time"], batch["seq"], batch["name"], strict=True):
        if kind == "begin":
            stack.append([int(seq), name, int(time), 0])
        elif kind == "end" and stack:
            zone, own, start, below = stack.pop()
            dur = int(time) - start
            if stack:
                stack[-1][3] += max(dur, 0)
            rows.append((capture, thread, zone, own, start, int(time), len(stack), stack[-1][0] if stack else None, any(s[1] == own for s in stack), dur, dur - below, late))
    state.update((json.dumps((stack, last, late)),))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in ZONES.split(", ")])
    out["parent_id"] = out["parent_id"].astype("Int64")
    yield out


def closed_zones(events: DataFrame) -> DataFrame:
    """A stream of zones as they close, with self time and re-entrancy."""
    rows = events.where(F.col("kind").isin("begin", "end")).select("capture_id", "thread", "kind", "time", "seq", "name")
    return rows.groupBy("capture_id", "thread").applyInPandasWithState(_close_zones, ZONES, "stack string", "append", "NoTimeout")


def zone_totals(events: DataFrame) -> DataFrame:
    """A stream of counts per kind and name of raw events, in update mode."""
    return events.groupBy("capture_id", "kind", "name").agg(F.count(F.lit(1)).alias("events"), F.min("time").alias("first"), F.max("time").alias("last"))


def capture(events: DataFrame, target: str, checkpoint: str, timeout: float | None = None) -> DataFrame:
    """Run until the log is read and append closed zones to Parquet; what has been written. A log that isn't read after
    ``timeout`` seconds is a ``TimeoutError``: its first zones are in ``target``, and a call with the same ``checkpoint``
    goes on from there."""
    query = closed_zones(events).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"the log wasn't read in {timeout} seconds; {target} holds a part of its zones, {checkpoint} the state to go on from")
    finally:
        query.stop()  # nothing more is written after an error
    return events.sparkSession.read.schema(ZONES).parquet(target)
