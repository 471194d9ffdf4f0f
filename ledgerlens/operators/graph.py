"""Edges, hops and connected components as iterated equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.runtime import stored


def hops(edges: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """(start, node, hops): nodes within ``most`` directed edges (src, dst) of each start, by the fewest edges."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    last = seen
    for i in range(1, most + 1):
        step = last.join(edges, last["node"] == edges["src"]).select("start", F.col("dst").alias("node"), F.lit(i).alias("hops")).distinct()
        last = stored(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "hops")
        seen = seen.unionByName(last)
    return seen


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node that undirected edges (src, dst) reach; labels jump along, so rounds are few."""
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "edges")
    label = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("dst"), F.col("label").alias("seen")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("seen").alias("seen"))
        step = label.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = stored(step.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("next")), "labels")
        if new.filter("label <> next").isEmpty():
            break
        label = new.select("node", F.col("next").alias("label"))
    else:
        raise RuntimeError(f"labels still changed after {most} rounds")
    return label.select("node", F.col("label").alias("component"))
