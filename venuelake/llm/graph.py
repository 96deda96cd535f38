"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step sends a row for each edge, and hubs are met by joins that adaptive execution can split, never by
gathering the neighbours of a node. Each round is written to the shared folder, and the one before is deleted.
Nodes may be of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges``(a, b); root is the smallest node that can be reached."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current, before, step = materialize(both, f"{label}-0"), None, 0
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before, step = seen, step + 1
        around = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, f"{label}-{step}m")  # so that the join has plain exchanges, and a hub can be split
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"{label}-{step}l")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-{step}n")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        done, current = current, materialize(small, f"{label}-{step}")
        release(done, least, large, low)
    roots = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
