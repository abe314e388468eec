"""Connected components of an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.staging import discard, stage

#: Edges that a task contracts at once, and of what is left those that one task finishes.
HELD = 1_000_000
#: Alternating rounds; each takes a node at least twice as near to its component, so this bounds no real graph.
ROUNDS = 60


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reached from each of n nodes over the links (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(u, v) with the same components: what a task holds is replaced by stars around the least nodes."""

    def run(batches):
        us, vs, size = [], [], 0

        def forest():
            nodes, at = np.unique(np.concatenate([*us, *vs]), return_inverse=True)
            n = len(at) // 2
            root = local_roots(len(nodes), at[:n], at[n:])
            far = np.flatnonzero(root != np.arange(len(nodes)))
            us.clear(), vs.clear()
            return nodes[far], nodes[root[far]]

        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            size += len(batch)
            if size > held:
                u, v = forest()
                if 2 * len(u) > held:  # little was saved: passed on
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                else:
                    us.append(u), vs.append(v)
                size = sum(map(len, us))
        if size:
            u, v = forest()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, name: str = "components", rounds: int = ROUNDS, held: int = HELD, forest: bool = False) -> DataFrame:
    """(node, component) for every end of the undirected edges (u, v); component is the smallest node reached.

    Tasks contract their edges first (unless they come as a forest of each task already, which spares
    a second Python worker beside the one that makes them). Once at most `held` are left, one task finishes; until then
    large-star and small-star steps alternate (Kiveris et al., 2014): each joins edges with the
    least neighbour of their end, so that no step holds a node's neighbours in one task. The least
    neighbours are pre-aggregated before they are shuffled, and staged: both sides of a join are then
    plain shuffles, of which the adaptive planner splits the partition of a hub."""
    ends = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    links = stage(ends if forest else contracted(ends, held), name)
    for left in range(rounds, -1, -1):
        if links.count() <= held:
            before, links = links, stage(contracted(links.repartition(1), 2 * held), name)
            discard(before)
            break
        if not left:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = stage(large, name), least
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), name)
        discard(before)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = stage(small, name)
        discard(links, large, least)
        if _settled(small):
            links = small
            break
        links = stage(contracted(small, held), name)
        discard(small)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(e: DataFrame) -> bool:
    """Every edge leads from a node to its component: one edge a node, and no component has one."""
    n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
