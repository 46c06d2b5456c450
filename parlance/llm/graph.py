"""Connected components by contraction, with every table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.store import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``links(a, b)``; the component is its least node.

    Each round every node joins its least neighbour, twice over, and links are carried to the
    nodes that remain; rounds grow with the logarithm of a component's width, and a hub costs
    one partial aggregate and one join that Spark can split.
    """
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = stored(ends(links.select("a", "b")), "graph-links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        hooks = stored(hooks, "graph-hooks")
        over = hooks.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        step = hooks.join(over, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("to"))
        step = stored(step, "graph-step")
        if labels is None:
            fresh = step.select(F.col("node").alias("id"), F.col("to").alias("component"))
        else:
            fresh = labels.join(step, F.col("component") == F.col("node"), "left").select(
                "id", F.coalesce("to", "component").alias("component")
            )
        fresh = stored(fresh, "graph-labels")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        after = stored(ends(moved), "graph-links")
        discard(edges, hooks, step, *([labels] if labels is not None else []))
        edges, labels = after, fresh
    discard(edges)
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return labels
