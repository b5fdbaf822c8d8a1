"""Traces as directories of Parquet tables: writing, selective reading, stripping, snapshots, catalogue; CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLASSES, STRIP, TABLES

CODECS = ("snappy", "lz4", "zstd", "gzip", "none")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write(tables: dict[str, DataFrame], path: str, codec: str = "zstd", mode: str = "error") -> None:
    """One directory per table, by capture; facts are sorted by thread and time within files, so that statistics of row
    groups prune ranges."""
    for name, df in tables.items():
        keys = [c for c in ("thread", "start", "time") if c in df.columns]
        rows = df.sortWithinPartitions(*keys) if keys else df
        out = rows.write.mode(mode).option("compression", codec)
        (out.partitionBy("capture_id") if "capture_id" in df.columns else out).parquet(f"{path}/{name}")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Tables of a trace with their bytes."""
    fs, p = _fs(spark, path)
    rows = [(s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p) if s.isDirectory()]
    return spark.createDataFrame(rows, "table string, bytes long")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures that a trace directory holds, with the tables that each has."""
    fs, p = _fs(spark, path)
    rows = []
    for table in fs.listStatus(p):
        if table.isDirectory():
            names = [s.getPath().getName() for s in fs.listStatus(table.getPath()) if s.isDirectory()]
            rows += [(n.removeprefix("capture_id="), table.getPath().getName()) for n in names if n.startswith("capture_id=")]
    return spark.createDataFrame(rows, "capture_id string, table string")


def read(spark: SparkSession, path: str, without: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables of a trace, but those of the classes ``without``; what isn't asked for isn't opened."""
    skipped = {t for c in without for t in CLASSES[c]}
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if n in TABLES and n not in skipped}


def strip(spark: SparkSession, source: str, target: str, flags: str, codec: str = "zstd") -> None:
    """Copy a trace without the classes whose letters ``flags`` holds."""
    write(read(spark, source, tuple(STRIP[f] for f in flags)), target, codec)


def snapshot(tables: dict[str, DataFrame], path: str, codec: str = "zstd") -> dict[str, int]:
    """Write a trace; bytes of each table."""
    write(tables, path, codec)
    spark = next(iter(tables.values())).sparkSession
    return {r["table"]: r["bytes"] for r in catalogue(spark, path).collect()}  # a row per table


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Temporary views, for SQL over a trace."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def export_csv(df: DataFrame, path: str, separator: str = ",", single: bool = True) -> None:
    """A CSV file with header; ``single``: one file, for results that are reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def unwrap(zones: DataFrame) -> DataFrame:
    """Export, one row per closed zone; ``value`` is null where the zone has no text."""
    return zones.where("dur is not null").select("name", F.col("file").alias("src_file"), F.col("line").alias("src_line"), F.col("start").alias("ns_since_start"), F.col("dur").alias("exec_time_ns"), "thread", F.col("text").alias("value"))


def unwrap_plots(points: DataFrame) -> DataFrame:
    """Export of plot points in the columns of ``unwrap``: time in the fourth, value in the last."""
    return points.select(F.col("plot").alias("name"), F.col("time").alias("ns_since_start"), F.col("val").cast("string").alias("value"))


def export_gpu(zones: DataFrame) -> DataFrame:
    return zones.where("gpu_end is not null").select("name", F.col("file").alias("src_file"), F.col("gpu_start").alias("Time from start of program"), (F.col("gpu_end") - F.col("gpu_start")).alias("GPU execution time"))


def export_messages(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("text").alias("MessageName"), F.col("time").alias("total_ns"))


def visible_stats(stats: DataFrame) -> DataFrame:
    return stats.select("name", F.col("file").alias("src_file"), F.col("line").alias("src_line"), F.col("total").alias("total_ns"), F.col("count").alias("counts"))
