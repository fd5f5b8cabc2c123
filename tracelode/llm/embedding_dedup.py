"""Embedding near-duplicates by collision counting over one-dimensional projections.

Vectors of a label are projected on ``PROJECTIONS`` fixed random directions and sorted along each. A
query's window on a direction is centred on its own projection; a vector inside it collides. Pairs
with ``LEAST_COLLISIONS`` collisions or more are verified by cosine in double precision.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .graph import connected_components, smallest_roots

PROJECTIONS = 32
#: Half a window, in standard deviations of the projected difference of a pair at the threshold.
HALF_WINDOW = 2.0
#: Share of pairs exactly at the threshold that may have too few collisions.
MISS = 1e-5
#: Vectors that a block holds on average; a task compares two blocks.
BLOCK = 2048


def least_collisions(projections: int = PROJECTIONS, half_window: float = HALF_WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with a probability of at least 1 - miss.

    On Gaussian directions the projected difference of a pair is normal with the pair's distance as
    standard deviation, so collisions of independent directions are binomial.
    """
    p = erf(half_window / sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(dims: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(93).standard_normal((dims, projections))


def collision_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` with cosine of at least ``threshold``, i < j where ``same``."""
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    ux, uy = unit(x), unit(y)
    d = directions(x.shape[1])
    px, py = ux @ d, uy @ d
    order = np.argsort(py, axis=0, kind="stable")
    lines = np.take_along_axis(py, order, axis=0)
    half = HALF_WINDOW * sqrt(max(0.0, 2 - 2 * threshold)) + 1e-12
    need = least_collisions()
    lo = np.stack([np.searchsorted(lines[:, k], px[:, k] - half, "left") for k in range(d.shape[1])])
    hi = np.stack([np.searchsorted(lines[:, k], px[:, k] + half, "right") for k in range(d.shape[1])])
    columns = [np.ascontiguousarray(order[:, k]) for k in range(d.shape[1])]
    found_a, found_b = [], []
    counts = np.empty(len(y), np.uint8)
    for i in range(len(x)):
        counts[:] = 0
        for k, column in enumerate(columns):
            counts[column[lo[k, i] : hi[k, i]]] += 1
        j = np.flatnonzero(counts >= need)
        if same:
            j = j[j > i]
        if len(j):
            dots = y[j] @ x[i]
            norms = np.sqrt((y[j] * y[j]).sum(axis=1)) * sqrt(float((x[i] * x[i]).sum()))
            j = j[dots / norms >= threshold]
            found_a.append(np.full(len(j), i))
            found_b.append(j)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_duplicate_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Equal vectors of a label are one class with a multiplicity. A label's classes are dealt by hash
    to blocks of ``block``; every two blocks of a label meet in one task, which counts collisions,
    verifies, and gives back the number of links of each class and a spanning forest of the links, so
    what leaves a task grows with its rows, not with its pairs. Work grows with the square of a
    label's distinct vectors, over as many tasks as there are pairs of blocks.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing; vectors of different lengths don't link. Repeated rows link with each
    other. A component's id is its smallest id, null ids passed over. Extra columns are not read; an
    empty table gives an empty result.
    """
    kind = embeddings.schema[id_col].dataType
    values = F.transform(F.col(vector_col), lambda v: v.cast("double") + F.lit(0.0))
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), values.alias("v"))
    bad = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.coalesce(squares, F.lit(0.0)) > 0)
    rows = rows.select("id", "label", "v", F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", F.size("v"), "v"))).withColumn("check", F.when(F.col("usable"), F.xxhash64("v", "label")))
    rows = materialize(rows.select("id", "node", "check", "label", F.when(F.col("usable"), F.col("v")).alias("v")), "vectors")
    classes = rows.where("node is not null").groupBy("node", "check").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes, "vector_classes")

    groups = classes.groupBy("label", F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = classes.withColumn("dims", F.size("v")).join(groups, ["label", "dims"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "v")

    def compare(table: pa.Table) -> pa.Table:
        node, copies, blocks = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        order = np.lexsort((node, blocks))
        node, copies, blocks = node[order], copies[order], blocks[order]
        v = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(node), -1)[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i == j:
            a, b = collision_links(v, v, threshold, True)
        else:
            n = int((blocks == i).sum())
            a, b = collision_links(v[:n], v[n:], threshold, False)
            b = b + n
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = smallest_roots(len(node), a, b)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[root][some]})

    out = materialize(dealt.groupBy("label", "dims", "i", "j").applyInArrow(compare, "node long, links long, root long"), "collisions")
    roots = connected_components(out.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = out.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("node", "check", "rep", "copies").join(degrees, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    placed = placed.join(smallest, "root").select(F.col("node").alias("n"), F.col("check").alias("c"), n_links.cast("long").alias("n_links"), "component_id")
    placed = materialize(placed, "placed_vectors")
    discard(classes, out)
    result = rows.select("id", "node", "check").join(placed, (F.col("node") == F.col("n")) & (F.col("check") == F.col("c")), "left")
    result = result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast(kind).alias("component_id"))
    return result.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
