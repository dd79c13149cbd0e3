"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return row[0], row[1] or 0


def _least(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest neighbour v of every u; written, so that Spark can split joins with it where a node has many edges."""
    return scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Hangs the larger neighbours of every node under its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, scratch)
    return both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Hangs every node and its smaller neighbours under the smallest of them."""
    least = _least(edges, scratch)
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (node, component) for every linked node but the components' smallest ones.

    Steps go on until nothing changes; each writes its edges to the shared folder.  Self links are ignored.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        large = scratch.write(_large_star(edges, scratch))
        small = scratch.write(_small_star(large, scratch))
        scratch.drop(edges, large)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
