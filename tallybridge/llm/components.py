"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybridge.workspace import Workspace


def connected_components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """``(node, component)`` for every linked node; the component is its smallest node.

    ``links`` has the columns ``a`` and ``b``; direction, repeats and self-links don't
    matter. Large-star and small-star steps alternate until nothing changes, which takes
    a number of rounds in the order of the logarithm of the longest chain. Each round is
    written to the shared folder, so a lost executor costs a re-read. A hub is only a
    key of aggregates, which combine on the map side, and of joins with the one row they
    leave, which adaptive execution can split.
    """
    edges = workspace.store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    state = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = workspace.store(small.union(least.select("u", F.col("m"))).toDF("u", "v").distinct(), "edges")
        seen = edges.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.count_distinct("u")
        ).head()
        if tuple(seen) == state and seen[0] == seen[2]:
            break
        state = tuple(seen)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.toDF("node", "component").unionByName(roots)
