"""Connected components of an edge table, by alternating large and small stars.

Every round turns each node's neighbourhood into a star around its smallest member; after a few rounds (about the
logarithm of the longest path) each component is one star around its smallest node.  A round is joins and minima on the
edge table, written to the shared folder; no component or edge list reaches the driver or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilink.sources.store import store


def _kept(edges: DataFrame):
    figures = {"mark": F.bit_xor(F.xxhash64("u", "v"))}
    return store(edges.where("u <> v").distinct(), "stars", **figures)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node.  Null ends are no edges."""
    now = _kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()))
    while now.rows:
        down = now.frame
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
        )))
        new = _kept(small)
        if (new.rows, new.seen["mark"]) == (now.rows, now.seen["mark"]):
            break
        now = new
    leaves = now.frame.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.frame.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
