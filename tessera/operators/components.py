"""Connected components of a graph of any size, by hooking and contraction; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hot import join_values
from tessera.sources.rounds import drop_round as discard
from tessera.sources.rounds import keep_round as written


def _roots(hooks: DataFrame) -> DataFrame:
    """hooks (x, to), to < x: every x with the end of its chain, by pointer doubling. hooks is discarded."""
    while True:
        ahead = hooks.select(F.col("x").alias("to"), F.col("to").alias("_next"))
        longer = written(hooks.join(ahead, "to", "left").select("x", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")), "hooks")
        discard(hooks)
        hooks = longer
        if hooks.where("_moved").isEmpty():
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the least node that each node of an edge can reach.

    Each round hooks every node to its least smaller neighbour, follows the hooks to their ends
    and contracts the edges, which leaves at most half of the nodes that had an edge. Hot nodes
    are aggregated before they are shuffled. Null ends and loops are ignored; repeated edges
    count once; no edges give no rows.
    """
    left = written(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        roots = _roots(written(left.groupBy("x").agg(F.min("y").alias("to")), "hooks"))
        steps.append(roots)
        to_x, to_y = roots.select("x", F.col("to").alias("_x")), roots.select(F.col("x").alias("y"), F.col("to").alias("_y"))
        moved = left.join(to_x, "x", "left").join(to_y, "y", "left").select(F.coalesce("_x", "x").alias("a"), F.coalesce("_y", "y").alias("b"))
        fewer = written(moved.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
        discard(left)
        left = fewer
    discard(left)
    nodes = edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    used: list[DataFrame] = []
    for roots in steps:
        named = written(nodes, "named")
        nodes = join_values(named, roots.select(F.col("x").alias("component"), "to"), "component").select("node", F.coalesce("to", "component").alias("component"))
        used.append(named)
    out = written(nodes, "components")
    discard(*steps, *used)
    return out
