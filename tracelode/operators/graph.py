"""Temporal provenance graphs: rarity, reachability, spanning forests, criticality, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

#: Edges that a task unites at a time.
EDGES_AT_ONCE = 250_000


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage in an iteration: a table in the folder that the cluster shares; a local one only under a local master."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = os.path.join(top, "tracelode", uuid.uuid4().hex, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracelode_path = path  # noqa: SLF001
    return back


def spent(*frames: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tracelode_path", None)
        if path:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def _united(most: int):
    """Per ``most`` rows of edges ``a, b``, with the ends' keys ``x, y``: every end and the end of least key, then name, that they connect it to."""

    def trees(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).dictionary_encode().combine_chunks()
        at, names = ends.indices.to_numpy(), ends.dictionary
        key, place, rank = (np.zeros(len(names), np.int64) for _ in range(3))
        key[at] = np.concatenate([edges["x"].to_numpy(), edges["y"].to_numpy()])
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((place, key))
        rank[order] = np.arange(len(names))
        a, b = rank[at].reshape(2, -1).tolist()
        root = list(range(len(names)))
        for x, y in zip(a, b, strict=True):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)
        for x, y in enumerate(root):
            root[x] = root[y]  # no root comes after its nodes, so that of y is final
        return pa.RecordBatch.from_arrays([names.take(pa.array(order)), names.take(pa.array(order[root]))], ["node", "root"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if n + part.num_rows > most:
                    yield trees(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield trees(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable; edges without both ends count for nothing.

    Tasks unite the edges they hold, some at a time, to trees. Roots of one node are edges of the next
    round, which has roots only. Few edges are united by one task; of more, each node's are dealt to
    one task and roots are the least by a hash that differs by round, so that a round leaves three
    quarters of the nodes or fewer, in the mean, however long the paths are.
    """
    kind = edges.select("a").union(edges.select("b")).schema["a"].dataType
    left = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a is not null and b is not null")
    maps: list[DataFrame] = []
    while True:
        keys = [F.xxhash64(end, F.lit(len(maps))) if maps else F.lit(0).cast("long") for end in ("a", "b")]
        trees = left.select("a", "b", keys[0].alias("x"), keys[1].alias("y")).mapInArrow(_united(EDGES_AT_ONCE), T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
        near = trees.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        maps.append(cut(near.select("node", "root", F.array_remove("roots", F.col("root")).alias("others")), "trees"))
        spent(left)
        left = cut(maps[-1].select(F.col("root").alias("a"), F.explode("others").alias("b")).distinct(), "edges")
        n = left.count()
        if not n:
            break
        path = left._tracelode_path  # noqa: SLF001
        if n <= EDGES_AT_ONCE:
            left = left.coalesce(1)
        else:
            left = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a").sortWithinPartitions("a")
        left._tracelode_path = path  # noqa: SLF001
    spent(left)
    label = maps[0].select("node", F.col("root").alias("component"))
    if len(maps) == 1:
        label._tracelode_path = maps[0]._tracelode_path  # noqa: SLF001
        return label
    tree = maps[1].select("node", "root")
    for step in maps[2:]:
        tree = tree.join(step.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    tree = cut(tree, "roots")  # the first round's roots are its trees' smallest nodes, so the smallest of all is one
    low = tree.join(tree.groupBy("root").agg(F.min("node").alias("low")), "root").select(F.col("node").alias("component"), "low")
    label = cut(label.join(low, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
    spent(tree, *maps)
    return label


def node_anomaly(edges: DataFrame) -> DataFrame:
    """``node, anomaly``: the largest of the incoming edges, 0 without any."""
    incoming = edges.groupBy(F.col("dst").alias("node")).agg(F.max("anomaly").alias("anomaly"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(incoming, "node", "left").select("node", F.coalesce("anomaly", F.lit(0.0)).alias("anomaly"))


def edge_rarity(edges: DataFrame) -> DataFrame:
    """Adds ``rarity``, one over the count of the edge's action, or of its ends where it has none, and its place in its window."""
    key = F.coalesce("action", F.concat_ws("->", "src", "dst"))
    counts = edges.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = edges.withColumn("k", key).join(counts, "k").withColumn("rarity", F.round(1 / F.col("n"), 9)).withColumn("window", F.floor(F.col("ts") / S.WINDOW_SECONDS).cast("long")).drop("k", "n")
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.col("rarity").desc(), "ts", "src", "dst"))
    return rows.withColumn("place", place.cast("long"))


def reachable(edges: DataFrame, seeds: DataFrame, anchor_ts: float, horizon: float = S.HORIZON_SECONDS, direction: str = "both", causal: bool = False) -> DataFrame:
    """``node, depth`` within the horizon of the anchor time; ``causal`` asks for times that don't fall back."""
    near = edges.where(F.abs(F.col("ts") - F.lit(anchor_ts)) <= horizon)
    hops = []
    if direction in ("out", "both"):
        hops.append(near.select(F.col("src").alias("x"), F.col("dst").alias("y"), "ts"))
    if direction in ("in", "both"):
        hops.append(near.select(F.col("dst").alias("x"), F.col("src").alias("y"), (-F.col("ts") if causal else F.col("ts")).alias("ts")))
    hop = hops[0] if len(hops) == 1 else hops[0].union(hops[1])
    hop = cut(hop.distinct(), "hops")
    seen = cut(seeds.select(F.col("node"), F.lit(0).alias("depth"), F.lit(float("-inf")).alias("at")).distinct(), "seen")
    front, depth = seen, 0
    while True:  # each round adds a node, or ends it
        depth += 1
        step = front.join(hop, F.col("node") == F.col("x"))
        if causal:
            step = step.where("ts >= at")
        step = step.groupBy(F.col("y").alias("node")).agg(F.min("ts").alias("at")).withColumn("depth", F.lit(depth)).select("node", "depth", F.col("at").cast("double"))
        front = cut(step.join(seen.select("node").distinct(), "node", "left_anti"), "front")
        if front.isEmpty():
            spent(hop, front)
            break
        old, seen = seen, cut(seen.union(front), "seen")
        spent(old)
    return seen.select("node", F.col("depth").cast("long").alias("depth"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges in order of time that join two trees: neither cycles nor diamonds stay.

    In rounds: the first edge (by time, then ends, then the other columns) that leaves a tree is in
    the forest, and trees joined so are one. The order is strict, so this is the forest that a fold
    over the edges in order would give, without one: a round is joins, and trees at least halve.
    """
    others = [c for c in edges.columns if c not in ("ts", "src", "dst")]
    order = F.struct(*[F.col(c) for c in ("ts", "src", "dst", *others)])
    left = cut(edges.where("src <> dst").distinct().select(order.alias("e"), F.col("src").alias("a"), F.col("dst").alias("b")), "forest_edges")
    chosen: list[DataFrame] = []
    while not left.isEmpty():
        first = left.select("e", F.explode(F.array("a", "b")).alias("tree")).groupBy("tree").agg(F.min("e").alias("e"))
        taken = cut(left.join(first.select("e").distinct(), "e", "left_semi"), "taken")
        chosen.append(taken)
        tree = components(taken.select("a", "b"))
        moved = left.join(tree.toDF("a", "ta"), "a", "left").join(tree.toDF("b", "tb"), "b", "left")
        moved = moved.select("e", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b")
        old, left = left, cut(moved, "forest_edges")
        spent(old, tree)
    if not chosen:
        return edges.limit(0)
    out = chosen[0]
    for taken in chosen[1:]:
        out = out.union(taken)
    return out.select("e.*").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    rows = out.join(in_, "node", "full")
    return rows.select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def criticality(edges: DataFrame) -> DataFrame:
    """``node, criticality``: half of scaled degrees, half of scaled anomaly."""
    rows = degrees(edges).join(node_anomaly(edges), "node")
    tops = rows.agg(F.max("out_degree").alias("mo"), F.max("in_degree").alias("mi"), F.max("anomaly").alias("ma"))
    rows = rows.crossJoin(F.broadcast(tops))
    shape = 0.5 * (F.col("out_degree") / F.greatest("mo", F.lit(1)) + F.col("in_degree") / F.greatest("mi", F.lit(1)))
    return rows.select("node", "out_degree", "in_degree", "anomaly", F.round(0.5 * (shape + F.col("anomaly") / F.greatest("ma", F.lit(1.0))), 6).alias("criticality"))


def reconstruct(edges: DataFrame, seeds: DataFrame, anchor_ts: float, horizon: float = S.HORIZON_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Forest edges around the seeds that hang from the best entry, and nodes with their role.

    Entries have no incoming edge in the forest, exits no outgoing one; the most critical of each,
    ties by name, is the role's holder.
    """
    nodes = reachable(edges, seeds, anchor_ts, horizon).select("node")
    near = edges.where(F.abs(F.col("ts") - F.lit(anchor_ts)) <= horizon)
    near = near.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi").distinct()
    forest = cut(spanning_forest(near), "forest")
    scored = degrees(forest).join(criticality(near).select("node", "criticality"), "node")
    best = Window.partitionBy("role").orderBy(F.col("criticality").desc(), "node")
    roles = scored.where("in_degree = 0").withColumn("role", F.lit("entry")).union(scored.where("out_degree = 0").withColumn("role", F.lit("exit")))
    roles = roles.withColumn("chosen", F.row_number().over(best) == 1)
    entry = roles.where("role = 'entry' and chosen").select("node")
    below = reachable(forest, entry, anchor_ts, horizon, "out").select("node")
    return forest.join(below.toDF("src"), "src", "left_semi"), roles
