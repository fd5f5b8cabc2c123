"""Connected components by contraction, without collecting nodes or edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def smallest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of ``n`` nodes in memory, by edges ``a``, ``b``."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``. Every round each node points at the smallest node of
    its closed neighbourhood, pointers are followed twice, and edges are rewritten between the
    targets; the graph shrinks by a constant factor or more, a star in one round. The smallest node
    of a component always points at itself, so the last target is that node. Returns ``node``,
    ``root``; self-loops and null ends are ignored; an empty input gives an empty table.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = edges.where("a is not null and b is not null and a <> b")
    current = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        near = materialize(near.select("node", F.least("node", "m").alias("p")), "near")
        up = near.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jump = materialize(near.join(up, "p").select("node", F.col("pp").alias("p")), "jump")
        maps.append(jump)
        left = jump.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = jump.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = current.join(left, "a").join(right, "b").where("pa <> pb")
        following = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(current, near)
        current = following
    if maps:
        discard(current)
    else:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0].select("node", F.col("p").alias("root"))
    for step in maps[1:]:
        roots = roots.join(step.select(F.col("node").alias("root"), F.col("p").alias("further")), "root", "left")
        roots = roots.select("node", F.coalesce("further", "root").alias("root"))
    if len(maps) == 1:
        roots._tracelode_path = maps[0]._tracelode_path  # noqa: SLF001
        return roots
    out = materialize(roots, "roots")
    discard(*maps)
    return out
