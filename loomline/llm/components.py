"""Connected components of an edge table by hooking and contraction, all in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise, renamed, small_batches, tidy

#: A graph of so many edges (16 bytes each) is finished in one task; a larger one is contracted first.
LOCAL_EDGES = 500_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges a - b: roots hook to the smallest root beside them, then every path is compressed."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        least = np.minimum(x, y)
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, up: the root of each node; the edges between the roots). At least half of the nodes aren't roots.

    Every node hooks to its smallest neighbour. Along hooks, every second node is no larger than the one before, so
    the only cycles are pairs that hook to each other; the smaller of a pair is its tree's root, and every tree has
    two nodes or more. Pointer jumping then takes a logarithm of the depth.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "cc-hooks")
    above = lambda t: t.select(F.col("node").alias("up"), F.col("up").alias("top"))
    root = (F.col("top") == F.col("node")) & (F.col("node") < F.col("up"))
    tree = materialise(hooks.join(above(hooks), "up").select("node", F.when(root, F.col("node")).otherwise(F.col("up")).alias("up")), "cc-trees")
    discard(hooks)
    while True:
        jumped = materialise(tree.join(above(tree), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "cc-trees")
        discard(tree)
        tree = jumped
        if jumped.where("moved").isEmpty():
            break
    ends = edges.join(tree.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(tree.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
    left = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return tree, materialise(left, "cc-edges")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """edges: a, b (longs). Returns node, component: one of the component's nodes, the same for all. Nodes without edges aren't listed.

    Each round at least halves the nodes, on any graph, so rounds are at most log2 of the nodes; there is no other
    limit. A graph of local_edges or fewer is finished by union in one task: 16 bytes an edge. Either way gives the same
    components. A hub's edges meet in a minimum with map-side combine, and as a join's large side, which AQE splits.
    Each round's tables are written to the shared folder, so a lost executor costs no earlier round, and deleted when
    the next are in place.
    """
    small_batches(edges.sparkSession)

    @tidy
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["a"].to_numpy(np.int64), b["b"].to_numpy(np.int64)) for b in batches]
        if parts:
            node, root = local_components(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pd.DataFrame({"node": node, "up": root})

    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps = []
    while (n := left.count()) > local_edges:
        step, contracted = _contract(left)
        steps.append(step)
        discard(left)
        left = contracted
    if n or not steps:
        steps.append(materialise(left.coalesce(1).mapInPandas(finish, "node long, up long"), "cc-last"))
    found = steps[0]
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    if len(steps) > 1:
        found = materialise(found, "cc-labels")
        discard(*steps)
    discard(left)
    return renamed(found, {"up": "component"})
