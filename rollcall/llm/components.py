"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the component is its
    smallest node.

    Each round every node of the contracted graph joins its smallest neighbour if that
    is smaller, the chains are followed to their ends, and the edges are renamed; at
    least every node that is not smaller than all its neighbours goes, so there are
    about log2(nodes) rounds. Minima are aggregated before the shuffle, so a node with
    very many edges is no hot group; nothing comes to the driver but counts.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    graph = stored(both, "cc-edges")
    left = graph.count()
    size, label = left, None  # no table below has more rows
    while left:
        hook = graph.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("x"), F.least("a", "least").alias("to"))
        hook = stored(hook, "cc-hooks", size)
        while True:  # follow the chains
            nxt = hook.select(F.col("x").alias("to"), F.col("to").alias("end"))
            jump = stored(hook.join(nxt, "to").select("x", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "cc-jumps", size)
            hook = jump.select("x", "to")
            if jump.filter("moved").isEmpty():
                break
        if label is None:
            label = hook.select(F.col("x").alias("node"), F.col("to").alias("component"))
        else:
            new = hook.select(F.col("x").alias("component"), F.col("to").alias("root"))
            label = stored(label.join(new, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "cc-labels", size)
        to_a, to_b = hook.select(F.col("x").alias("a"), F.col("to").alias("na")), hook.select(F.col("x").alias("b"), F.col("to").alias("nb"))
        graph = stored(graph.join(to_a, "a").join(to_b, "b").filter("na != nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "cc-edges", size)
        left = graph.count()
    if label is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, component) after more edges: only the components that the new
    edges touch are looked at again."""
    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    new = edges.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    ends = new.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(ends).select(F.col("node").alias("component"), F.col("component").alias("root"))
    # nodes that had no label are their own component
    fresh = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = label.unionByName(fresh)
    return every.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
