"""Connected components by repeated contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_to, drop_tables


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root). In each round every node joins its smallest neighbour and the links
    between the nodes that are left are contracted; nodes should be hashes, so that chains halve in a few rounds."""
    edges, edges_path = cut_to(links.select("a", "b").where("a <> b").distinct(), "cc-edges")
    nodes, nodes_path = cut_to(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "cc-roots")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        joined = both.groupBy(F.col("a").alias("old")).agg(F.least("old", F.min("b")).alias("new"))
        step, step_path = cut_to(joined, "cc-step")
        moved, moved_path = cut_to(nodes.join(step, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "cc-roots")
        first, second = (step.select(F.col("old").alias(f"{x}"), F.col("new").alias(f"{x}_new")) for x in "ab")
        left = edges.join(first, "a").join(second, "b").select(F.col("a_new").alias("a"), F.col("b_new").alias("b")).where("a <> b")
        # smaller end first, so that a link and its reverse are one
        fresh, fresh_path = cut_to(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        drop_tables(links.sparkSession, edges_path, nodes_path, step_path)
        edges, edges_path, nodes, nodes_path = fresh, fresh_path, moved, moved_path
    return nodes


