"""Property graphs as two DataFrames: nodes (id, ...) and edges (src, dst, ...).

Iterative operators write each round to the shared folder and read it again, so plans stay short
and lost executors cost one round. Nothing but counts comes to the driver, unless a docstring says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import components
from tessera.operators.hot import join_values
from tessera.sources.rounds import drop_round, keep_round, release, rounds


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def match_nodes(nodes: DataFrame, labels: Sequence[str] = (), properties: dict | None = None, label_col: str = "labels") -> DataFrame:
    """MATCH (n:Label {key: value}): nodes with all labels and equal properties."""
    for label in labels:
        nodes = nodes.where(F.array_contains(label_col, label))
    for k, v in (properties or {}).items():
        nodes = nodes.where(F.col(k) == v)
    return nodes


def match_path(start: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1, direction: str = "out", types: Sequence[str] = ()) -> DataFrame:
    """(n0, n1, ..., nh): bindings of a path of `hops` relationships from the start nodes, each relationship used once.

    direction: out, in or both; edges may have a column `type`.
    """
    e = edges.where(F.col("type").isin(list(types))) if types else edges
    e = e.select(F.monotonically_increasing_id().alias("_e"), "src", "dst")
    if direction == "in":
        e = e.select("_e", F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        e = e.unionByName(e.select("_e", F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = start.select(F.col("id").alias("n0"), F.array().cast("array<long>").alias("_used"))
    for h in range(hops):
        step = e.select(F.col("src").alias(f"n{h}"), F.col("dst").alias(f"n{h + 1}"), "_e")
        out = out.join(step, f"n{h}").where(~F.array_contains("_used", F.col("_e"))).withColumn("_used", F.array_append("_used", F.col("_e"))).drop("_e")
    return out.select(*[f"n{h}" for h in range(hops + 1)])


def variable_length(start: DataFrame, edges: DataFrame, least: int = 1, most: int = 10, direction: str = "out") -> DataFrame:
    """(start, end, hops): every path of least..most distinct relationships from the start nodes, one row for each path."""
    e = edges.select(F.monotonically_increasing_id().alias("_e"), "src", "dst")
    if direction == "both":
        e = e.unionByName(e.select("_e", F.col("dst").alias("src"), F.col("src").alias("dst")))
    with rounds() as made:
        e = keep_round(e, "edges")
        frontier = start.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array().cast("array<long>").alias("_used"))
        kept: list[DataFrame] = []
        out = None
        for h in range(1, most + 1):
            step = frontier.join(e, F.col("end") == F.col("src")).where(~F.array_contains("_used", F.col("_e")))
            frontier = keep_round(step.select("start", F.col("dst").alias("end"), F.array_append("_used", F.col("_e")).alias("_used")), "paths")
            if h >= least:
                rows = frontier.select("start", "end", F.lit(h).alias("hops"))
                out = rows if out is None else out.unionByName(rows)
                kept.append(frontier)
            if frontier.isEmpty():
                break
    release(made, *kept)
    return out


def bfs(start: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): the fewest hops along directed edges from each start node, itself at 0."""
    with rounds() as made:
        e = keep_round(edges.select("src", "dst").distinct(), "edges")
        seen = keep_round(start.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)), "bfs")
        frontier, depth = seen, 0
        while max_depth is None or depth < max_depth:
            depth += 1
            reached = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
            frontier = keep_round(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
            if frontier.isEmpty():
                break
            seen = keep_round(seen.unionByName(frontier), "bfs")
            release([r for r in made if r is not e], seen, frontier)
    release(made, seen)
    return seen


def traverse(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(source, target, relationship, depth): breadth-first rows, one for each (current, neighbour) pair over all starts, at its least depth."""
    kind = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
    with rounds() as made:
        e = keep_round(edges.select("src", "dst", kind.alias("relationship")).distinct(), "edges")
        frontier = start.select(F.col("id").alias("node")).distinct()
        done, kept = None, []
        visited = keep_round(frontier, "visited")
        for depth in range(1, max_depth + 1):
            step = frontier.join(e, F.col("node") == F.col("src")).groupBy("src", "dst").agg(F.min("relationship").alias("relationship"))
            rows = keep_round(step.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship", F.lit(depth).alias("depth")), "traverse")
            kept.append(rows)
            done = rows if done is None else done.unionByName(rows)
            frontier = keep_round(rows.select(F.col("target").alias("node")).distinct().join(visited, "node", "left_anti"), "frontier")
            if frontier.isEmpty():
                break
            visited = keep_round(visited.unionByName(frontier), "visited")
            release([r for r in made if r is not e], *kept, frontier, visited)
    release(made, *kept)
    return done


def shortest_path(start: int, edges: DataFrame, weight: str | None = None, max_rounds: int = 1000) -> DataFrame:
    """(node, cost): the least cost from start to every node that it reaches, edges taken both ways; weight defaults to 1.

    Relaxation in rounds over the nodes that improved, until none does.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = edges.select("src", "dst", w.alias("w"))
    with rounds() as made:
        e = keep_round(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
        best = keep_round(e.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("node"), F.lit(0.0).alias("cost")), "best")
        frontier = best
        for _ in range(max_rounds):
            offers = frontier.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
            better = keep_round(offers.join(best, "node", "left").where("cost is null or offer < cost").select("node", F.col("offer").alias("cost")), "better")
            if better.isEmpty():
                break
            best = keep_round(best.join(better.select("node"), "node", "left_anti").unionByName(better), "best")
            frontier = better
            release([r for r in made if r is not e], best, frontier)
        else:
            raise RuntimeError(f"costs still fall after {max_rounds} rounds: a negative cycle?")
    release(made, best)
    return best


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(id, rank): teleport (1 - damping) / n, directed, the mass of nodes without out-edges dropped; ends when the L1 change is below tolerance."""
    n = nodes.select("id").distinct().count()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = keep_round(edges.join(degree, "src").select("src", "dst", "out"), "links")
    rank = keep_round(nodes.select("id").distinct().withColumn("rank", F.lit(1.0 / n)), "rank")
    for _ in range(iterations):
        inflow = links.join(rank, links["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("inflow"))
        step = rank.join(inflow, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("inflow", F.lit(0.0))).alias("new"), "rank")
        step = keep_round(step.select("id", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("change")), "rank")
        moved = step.agg(F.sum("change")).first()[0] or 0.0
        drop_round(rank)
        rank = step
        if moved < tolerance:
            break
    return rank.select("id", "rank")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node reaches over edges taken both ways; nodes without edges are their own.

    By contraction: each round at least halves the nodes that still have edges, and a component's
    label, however many nodes have it, is joined by a broadcast.
    """
    found = components.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return join_values(nodes.select("id").distinct(), found.withColumnRenamed("node", "id"), "id").select("id", F.coalesce("component", "id").alias("component"))


def communities(nodes: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """(component, members long) of at least min_size members."""
    return connected_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_size)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree), 0 for nodes without edges."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = nodes.select("id").join(sums, "id", "left").na.fill(0)
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles) of the simple undirected graph.

    Edges point from the end of lower degree to that of higher: a node then has at most
    sqrt(2 * edges) followers, so that a hub's neighbours are never paired with each other.
    """
    both = keep_round(undirected(edges), "edges")
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    lower = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    out = keep_round(lower.where("d < d2 or (d = d2 and src < dst)").select("src", "dst"), "oriented")
    wedge = out.join(out.select("src", F.col("dst").alias("third")), "src").where("dst <> third")
    closed = wedge.join(out.select(F.col("src").alias("dst"), F.col("dst").alias("third")), ["dst", "third"])
    corners = closed.select(F.explode(F.array("src", "dst", "third")).alias("id"))
    counts = corners.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return nodes.select("id").join(counts, "id", "left").na.fill(0, ["triangles"])


MAX_GRAPH_EDGES = 5_000_000
SOURCES_AT_ONCE = 1_000


def _is_small(both: DataFrame, max_edges: int) -> bool:
    """Whether a graph, with both directions of its edges, may go to every worker."""
    return both.limit(2 * max_edges + 1).count() <= 2 * max_edges


def _adjacency(nodes: DataFrame, both: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row starts and neighbours (as places) of the simple undirected graph."""
    ids = np.sort(nodes.select("id").distinct().toArrow().column(0).to_numpy())
    e = both.toArrow()
    src, dst = np.searchsorted(ids, e.column(0).to_numpy()), np.searchsorted(ids, e.column(1).to_numpy())
    order = np.lexsort((dst, src))
    return ids, np.searchsorted(src[order], np.arange(len(ids) + 1)), dst[order]


def _by_blocks(nodes: DataFrame, both: DataFrame, of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """of(sources, edges) for blocks of SOURCES_AT_ONCE source nodes, dealt by hash; the results written and put together."""
    e = keep_round(both, "edges")
    sources = keep_round(nodes.select("id").distinct(), "sources")
    blocks = max(1, -(-sources.count() // SOURCES_AT_ONCE))
    out = None
    for k in range(blocks):
        with rounds() as made:
            found = keep_round(of(sources.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), e), "block")
        release(made, found)
        out = found if out is None else out.unionByName(found)
    drop_round(e, sources)
    return out


def _shortest_paths(sources: DataFrame, e: DataFrame) -> list[DataFrame]:
    """For each depth: (start, node, paths), the nodes at that distance and how many shortest paths lead there."""
    levels = [keep_round(sources.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("paths")), "level")]
    while True:
        step = levels[-1].join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:  # a neighbour is at most one level back
            step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        now = keep_round(step, "level")
        if now.isEmpty():
            return levels
        levels.append(now)


def _levels(start: np.ndarray, to: np.ndarray, s: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Breadth-first levels from s, each node's depth and its number of shortest paths."""
    n = len(start) - 1
    depth, paths = np.full(n, -1), np.zeros(n)
    depth[s], paths[s] = 0, 1
    levels = [np.array([s])]
    while len(levels[-1]):
        now = levels[-1]
        size = start[now + 1] - start[now]
        at = np.repeat(start[now] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        frm, nxt = np.repeat(now, size), to[at]
        fresh = (depth[nxt] == -1) | (depth[nxt] == len(levels))
        depth[nxt[fresh]] = len(levels)
        np.add.at(paths, nxt[fresh], paths[frm[fresh]])
        levels.append(np.unique(nxt[fresh]))
    return levels[:-1], depth, paths


@dataclass
class _Folded:
    """A graph without what hangs on it as trees: places of the core's nodes and its edges, and for every node what was taken off."""

    ids: np.ndarray
    core: np.ndarray  # places of the nodes left that have edges
    start: np.ndarray
    to: np.ndarray
    size: np.ndarray  # nodes hung on each node, itself included
    inner: np.ndarray  # the sum of their distances to it
    squares: np.ndarray  # of the sizes of what hangs on it directly
    root: np.ndarray  # the node left that each hangs on, or is
    depth: np.ndarray  # the distance to it
    passed: np.ndarray  # the sum of the sizes from the node up to below the root


def _fold(ids: np.ndarray, start: np.ndarray, to: np.ndarray) -> _Folded:
    """Takes off nodes of one neighbour until none is left: trees need no search, and a search of the core counts each node as often as it weighs."""
    n = len(ids)
    degree, size, inner, squares = np.diff(start), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near = np.zeros(n, np.int64)  # exclusive or of the neighbours left: of a single one, that one
    np.bitwise_xor.at(near, np.repeat(np.arange(n), degree), to)
    root, depth, passed, left = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    taken, leaves = [], np.flatnonzero(degree == 1)
    while len(leaves):
        up = near[leaves]
        go = ~((degree[up] == 1) & (leaves < up))  # of a last pair the first stays
        leaves, up = leaves[go], up[go]
        taken.append((leaves, up))
        np.add.at(size, up, size[leaves])
        np.add.at(inner, up, inner[leaves] + size[leaves])
        np.add.at(squares, up, size[leaves].astype(float) ** 2)
        np.subtract.at(degree, up, 1)
        np.bitwise_xor.at(near, up, leaves)
        degree[leaves], left[leaves] = 0, False
        up = np.unique(up)
        leaves = up[degree[up] == 1]
    for leaves, up in taken[::-1]:
        root[leaves], depth[leaves], passed[leaves] = root[up], depth[up] + 1, passed[up] + size[leaves]
    core = np.flatnonzero(left & (degree > 0))
    src = np.repeat(np.arange(n), np.diff(start))
    kept = left[src] & left[to]
    place = np.cumsum(left & (degree > 0)) - 1
    counts = np.bincount(place[src[kept]], minlength=len(core)) if len(core) else np.zeros(0, int)
    return _Folded(ids, core, np.concatenate([[0], np.cumsum(counts)]), place[to[kept]], size, inner, squares, root, depth, passed)


def _searched(nodes: DataFrame, both: DataFrame, run: Callable[[_Folded, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> tuple[_Folded, DataFrame]:
    """The folded graph, and run's rows for the places of its core's nodes, dealt to tasks."""
    spark = nodes.sparkSession
    f = _fold(*_adjacency(nodes, both))
    shared = spark.sparkContext.broadcast(f)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return f, spark.range(len(f.core)).repartition(parts, "id").mapInPandas(lambda found: run(shared.value, found), schema)


def _nodes_of(nodes: DataFrame, f: _Folded) -> DataFrame:
    """(id, root, depth, passed, size, squares, far, n) of every node; far and n of the root, where it isn't of the core."""
    free = np.ones(len(f.ids), bool)
    free[f.core] = False
    place = np.zeros(len(f.ids), np.int64)
    place[f.core] = np.arange(len(f.core))
    out = ~free[f.root]
    known = lambda x: pa.array(x[f.root], mask=out)
    columns = {"id": f.ids, "root": pa.array(place[f.root], mask=~out), "depth": f.depth, "passed": f.passed, "size": f.size, "squares": f.squares, "own": f.root == np.arange(len(f.ids)), "far": known(f.inner), "n": known(f.size)}
    return nodes.sparkSession.createDataFrame(pa.table(columns)).withColumn("id", F.col("id").cast(nodes.schema["id"].dataType))


def closeness(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_GRAPH_EDGES) -> DataFrame:
    """(id, closeness): reachable others divided by the sum of their distances, 0 without any.

    A graph of at most max_edges edges comes to the driver, which takes off the trees that hang on it
    (their sums follow from those of the node they hang on); what is left goes to every worker, which
    is dealt sources. A larger one is searched level by level with joins, from blocks of sources.
    """
    both = undirected(edges)
    if not _is_small(both, max_edges):

        def far(sources: DataFrame, e: DataFrame) -> DataFrame:
            found = sources.select("id", F.lit(0).alias("n"), F.lit(0).alias("total"))
            for depth, level in enumerate(_shortest_paths(sources, e)[1:], 1):
                found = found.unionByName(level.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * depth).alias("total")))
            return found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

        return _by_blocks(nodes, both, far).select("id", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("closeness"))

    def run(f: _Folded, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, inner = f.size[f.core], f.inner[f.core]
        for part in parts:
            out = []
            for s in part["id"]:
                _, depth, _ = _levels(f.start, f.to, s)
                met = depth >= 0
                out.append((int(s), int((size[met] * depth[met]).sum() + inner[met].sum()), int(size[met].sum())))
            yield pd.DataFrame(out, columns=["root", "core_far", "core_n"])

    f, found = _searched(nodes, both, run, "root long, core_far long, core_n long")
    rows = _nodes_of(nodes, f)
    rows = rows.join(found, "root", "left") if len(f.core) else rows.withColumns({"core_far": F.lit(None).cast("long"), "core_n": F.lit(None).cast("long")})
    n = F.coalesce("n", "core_n")
    far = F.coalesce("far", "core_far") + n * F.col("depth") - 2 * F.col("passed")  # a step down is nearer to what hangs there, farther from all else
    return rows.select("id", F.when(n > 1, (n - 1) / far).otherwise(0.0).alias("closeness"))


def betweenness(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_GRAPH_EDGES) -> DataFrame:
    """(id, betweenness) of the undirected graph, by Brandes' accumulation from every source, halved.

    Where the graph goes to every worker (see closeness), trees that hang on it are taken off, sources
    of what is left are dealt to tasks and count as often as they have nodes, and the tasks' sums are added; else the levels are searched and then accumulated backwards with joins.
    """
    both = undirected(edges)
    if not _is_small(both, max_edges):

        def credit(sources: DataFrame, e: DataFrame) -> DataFrame:
            levels = _shortest_paths(sources, e)
            total, back = sources.select("id", F.lit(0.0).alias("b")), None
            for level in levels[:0:-1]:
                here = level if back is None else level.join(back, ["start", "node"], "left")
                here = here.withColumn("b", F.coalesce("b", F.lit(0.0)) if back is not None else F.lit(0.0))
                total = total.unionByName(here.groupBy(F.col("node").alias("id")).agg(F.sum("b").alias("b")))
                share = here.select("start", F.col("node").alias("src"), ((1 + F.col("b")) / F.col("paths")).alias("share"))
                before = levels[levels.index(level) - 1]
                up = share.join(e, "src").select("start", F.col("dst").alias("node"), "share").join(before, ["start", "node"])
                back = keep_round(up.groupBy("start", "node").agg(F.sum(F.col("share") * F.col("paths")).alias("b")), "back")
            return total.groupBy("id").agg(F.sum("b").alias("b"))

        found = _by_blocks(nodes, both, credit).groupBy("id").agg((F.sum("b") / 2).alias("betweenness"))
        return nodes.select("id").distinct().join(found, "id", "left").na.fill(0.0)

    def run(f: _Folded, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, to, size = f.start, f.to, f.size[f.core]
        total, n = np.zeros(len(size)), np.zeros(len(size), np.int64)
        for part in parts:
            for s in part["id"]:
                levels, depth, paths = _levels(start, to, s)
                n[s] = size[depth >= 0].sum()
                back = np.zeros(len(size))
                for now in levels[:0:-1]:
                    step = start[now + 1] - start[now]
                    at = np.repeat(start[now] - np.concatenate([[0], np.cumsum(step)[:-1]]), step) + np.arange(step.sum())
                    frm, prev = np.repeat(now, step), to[at]
                    up = depth[prev] == depth[frm] - 1
                    np.add.at(back, prev[up], paths[prev[up]] / paths[frm[up]] * (size[frm[up]] + back[frm[up]]))
                back[s] = 0
                total += size[s] * back
        yield pd.DataFrame({"root": np.arange(len(size)), "b": total, "core_n": n})

    f, found = _searched(nodes, both, run, "root long, b double, core_n long")
    rows = _nodes_of(nodes, f)
    found = found.groupBy("root").agg((F.sum("b") / 2).alias("b"), F.sum("core_n").alias("core_n"))
    rows = rows.join(found, "root", "left") if len(f.core) else rows.withColumns({"b": F.lit(0.0), "core_n": F.lit(None).cast("long")})
    hung = (F.col("size") - 1).cast("double")
    through = (hung * hung - F.col("squares")) / 2 + hung * (F.coalesce("n", "core_n") - F.col("size"))  # pairs that the node itself parts
    return rows.select("id", (through + F.when(F.col("own"), F.coalesce("b", F.lit(0.0))).otherwise(0.0)).alias("betweenness"))


def random_walks(nodes: DataFrame, edges: DataFrame, length: int = 10, walks: int = 5, seed: int = 7) -> DataFrame:
    """(walk, path array): `walks` walks of at most `length` steps from every node over edges taken both ways.

    The next node is the neighbour of the least hash of seed, walk, step and neighbour; a walk ends
    where there is none. Each step is one join with a partial minimum.
    """
    with rounds() as made:
        e = keep_round(undirected(edges), "edges")
        now = nodes.select("id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).select(F.struct("id", "k").alias("walk"), F.array("id").alias("path"))
        for step in range(length):
            ends = now.withColumn("src", F.element_at("path", -1))
            draw = F.xxhash64(F.lit(seed), F.lit(step), F.col("walk"), F.col("dst"))
            chosen = ends.select("walk", "src").join(e, "src").groupBy("walk").agg(F.min_by("dst", draw).alias("next"))
            now = keep_round(now.join(chosen, "walk", "left").select("walk", F.when(F.col("next").isNotNull(), F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path")), "walks")
            release([r for r in made if r is not e], now)
    release(made, now)
    return now


def node_embeddings(nodes: DataFrame, edges: DataFrame, size: int = 16, length: int = 10, walks: int = 5, seed: int = 7) -> DataFrame:
    """(id, embedding array<float>): words' vectors of the random walks, by Spark's Word2Vec, as in Node2Vec without return bias."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    text = random_walks(nodes, edges, length, walks, seed).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, minCount=1, inputCol="path", outputCol="out", seed=seed, numPartitions=1, windowSize=4).fit(text)
    kind = nodes.schema["id"].dataType
    return model.getVectors().select(F.col("word").cast(kind).alias("id"), vector_to_array("vector", "float32").alias("embedding"))


def neighbourhood_means(nodes: DataFrame, edges: DataFrame, features: str = "features", rounds_: int = 2) -> DataFrame:
    """(id, features): each round the mean of a node's own vector and its neighbours' mean, as an untrained aggregation over the graph."""
    e = undirected(edges)
    now = nodes.select("id", F.col(features).cast("array<double>").alias("features"))
    for _ in range(rounds_):
        spread = e.join(now.select(F.col("id").alias("src"), "features"), "src").select("dst", F.posexplode("features").alias("k", "v"))
        means = spread.groupBy("dst", "k").agg(F.avg("v").alias("v")).groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("m"))
        near = now.join(means, "id", "left")
        now = near.select("id", F.when(F.col("m").isNull(), F.col("features")).otherwise(F.zip_with("features", "m", lambda x, m: (x + m["v"]) / 2)).alias("features"))
    return now


def depth_first(start: int, edges: DataFrame, max_depth: int | None = None) -> list[tuple[int, int]]:
    """(node, depth) in depth-first order, neighbours by id. The order is sequential by nature: graphs of at most MAX_GRAPH_EDGES edges, on the driver."""
    if edges.limit(MAX_GRAPH_EDGES + 1).count() > MAX_GRAPH_EDGES:
        raise ValueError("depth-first order needs the graph on the driver")
    near: dict[int, list[int]] = {}
    for r in edges.select("src", "dst").distinct().orderBy("src", F.desc("dst")).toLocalIterator():
        near.setdefault(r["src"], []).append(r["dst"])
    out, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((node, depth))
        if max_depth is None or depth < max_depth:
            stack += [(x, depth + 1) for x in near.get(node, []) if x not in seen]
    return out


def merge_nodes(nodes: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE: rows whose keys no node has are added."""
    return nodes.unionByName(rows.join(nodes.select(*keys), list(keys), "left_anti").select(*nodes.columns))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in gone (id) and what hangs on them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)
