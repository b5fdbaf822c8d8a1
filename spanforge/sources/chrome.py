"""Chrome trace JSON: an array of events or an object with ``traceEvents``, plain or zstd-compressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imported

_STRUCT = "struct<ph:string,ts:double,dur:double,name:string,pid:bigint,tid:bigint,args:map<string,string>,loc:string>"


def _events(text: Column) -> Column:
    whole = F.from_json(text, f"traceEvents array<{_STRUCT}>")["traceEvents"]
    return F.when(F.ltrim(text).startswith("{"), whole).otherwise(F.from_json(text, f"array<{_STRUCT}>"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files at ``path`` with their order in the file."""
    return parse(spark.read.format("binaryFile").load(path))


def parse(files: DataFrame) -> DataFrame:
    """Events of files (path, content) with their order in the file; ``.zst`` files are decompressed in the tasks."""
    import pandas as pd

    @F.pandas_udf("string")
    def text_of(contents, paths):
        out = []
        for data, name in zip(contents, paths):
            if name.endswith(".zst"):
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(bytes(data))
            out.append(bytes(data).decode("utf-8", "replace"))
        return pd.Series(out)

    rows = files.select(F.col("path").alias("capture_id"), text_of("content", "path").alias("json"))
    parsed = rows.select("capture_id", F.posexplode(_events(F.col("json"))).alias("seq", "e"))
    return parsed.select("capture_id", F.col("seq").cast("long").alias("seq"), "e.*")


#: What the letters of an event mean; the first of a group that ends the import's event of that kind.
KINDS = {"b": "begin", "B": "begin", "e": "end", "E": "end", "X": "complete", "i": "instant", "I": "instant", "C": "counter", "M": "thread_name"}


def events(rows: DataFrame) -> DataFrame:
    """Events of Chrome traces in the columns of ``imported.EVENTS``; a counter gives one for each of its values."""
    text = F.concat_ws("", F.transform(F.map_entries("args"), lambda a: F.concat(a["key"], F.lit(": "), a["value"], F.lit("\n"))))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("ph")], F.lit("other"))
    own = rows.select(
        "capture_id", "seq", (F.col("ts") * 1000).cast("long").alias("time"), imported.thread(F.col("pid"), F.col("tid")).alias("thread"), F.when((kind == "thread_name") & ~F.col("name").eqNullSafe("thread_name"), "other").otherwise(kind).alias("kind"), "name",
        F.when(F.size("args") > 0, text).alias("text"), imported.file_of(F.col("loc")).alias("file"), imported.line_of(F.col("loc")).alias("line"), F.round(F.coalesce("dur", F.lit(0.0)) * 1000).cast("long").alias("dur"), "args",
    )
    plot = F.concat_ws("-", "name", "arg")
    counters = own.where("kind = 'counter'").select("*", F.explode("args").alias("arg", "shown")).withColumns({"plot": plot, "value": F.expr("try_cast(shown as double)"), "format": F.when(plot.endswith("_bytes"), "Memory").otherwise("Number")}).drop("args", "arg", "shown")
    others = own.where("kind <> 'counter'").withColumn("name", F.when(F.col("kind") == "thread_name", F.col("args")["name"]).otherwise(F.col("name"))).drop("args")
    return counters.unionByName(others, allowMissingColumns=True)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Trace tables of the events that ``read`` gives, times from the least one on."""
    return imported.tables(events(rows))
