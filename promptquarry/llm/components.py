"""Connected components by alternating large-star and small-star steps, each a grouped aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .keyfilter import joined_in_slices


def _nearest(edges: DataFrame, most: int) -> DataFrame:
    """u, v and the least node m of u and its neighbours, for at most so many edges. Degrees are unbounded: neighbours
    are not gathered, and those of a hub are joined in slices."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
    return joined_in_slices(edges, least, "u", "degree", most, "v").drop("degree")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the edges u, v (longs); loops and null ends are ignored."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = _nearest(large, 2 * state[0])
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
