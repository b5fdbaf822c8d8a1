"""Spark-native analytics of execution traces: zones, frames, plots, memory, locks, scheduling, samples and GPU work as
DataFrames, and the queries that a profiler's user asks of them."""
