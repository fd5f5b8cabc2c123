"""Splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def time_forward_split(rows: DataFrame, group: str, ts: str) -> DataFrame:
    """``group, first_ts, position, split``: the latest groups test, those before validate, the others train."""
    first = rows.groupBy(group).agg(F.min(ts).alias("first_ts"))
    n = first.agg(F.count(F.lit(1)).alias("n"))
    rows = running(first, F.col("first_ts"), [F.col(group).cast("string")], {}).withColumnRenamed("__position", "position").crossJoin(F.broadcast(n))
    n_test = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(0.15 * F.col("n")))).when(F.col("n") == 2, 1).otherwise(0)
    n_val = F.when(F.col("n") - n_test >= 3, F.greatest(F.lit(1), F.bround(0.15 * F.col("n")))).otherwise(0)
    split = F.when(F.col("position") > F.col("n") - n_test, "test").when(F.col("position") > F.col("n") - n_test - n_val, "val").otherwise("train")
    return rows.select(group, "first_ts", "position", split.alias("split"))


def open_set_split(rows: DataFrame, actor: str, seed: int = 42) -> DataFrame:
    """``actor, split``: a fifth of the actors by salted hash, half of them to validation, the rest to test."""
    salt = F.sha2(F.lit(f"open-set:{seed}").cast("binary"), 256)
    actors = rows.select(F.col(actor).cast("string").alias("actor")).distinct()
    key = F.sha2(F.concat(salt, F.col("actor")).cast("binary"), 256)
    n = actors.agg(F.count(F.lit(1)).alias("n"))
    rows = actors.withColumn("hash", key)
    rows = running(rows, F.conv(F.substring("hash", 1, 8), 16, 10), ["hash", "actor"], {}).withColumnRenamed("__position", "place").crossJoin(F.broadcast(n))
    hold = F.when(F.col("n") >= 2, F.greatest(F.lit(1), F.bround(0.2 * F.col("n")))).otherwise(0)
    split = F.when(F.col("place") <= F.floor(hold / 2), "val").when(F.col("place") <= hold, "test").otherwise("train")
    return rows.select("actor", split.alias("split"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``auc`` of one row: area under the ROC curve, ties averaged; null with one class.

    Counts by distinct score come first; ranks are running sums over ranges of scores.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    by = running(by, F.col("s"), [], {"upto": F.col("n")})
    by = by.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    area = (F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0.0))
    return by.agg(F.round(area, 6).alias("auc"))


def calibration_bins(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """``bin, n, mean_p, mean_y, gap``: bins open below and closed above, the first closed at 0 too."""
    which = F.least(F.greatest(F.ceil(F.col(p) * bins), F.lit(1)), F.lit(bins)).cast("long")
    by = rows.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("mean_y"))
    return by.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"), F.round(F.abs(F.col("mean_p") - F.col("mean_y")), 6).alias("gap"))


def calibration_error(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """``ece``: gaps of the bins weighted by their rows."""
    b = calibration_bins(rows, p, label, bins)
    return b.agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 6).alias("ece"))


def precision_recall(rows: DataFrame, predicted: Column, label: Column) -> DataFrame:
    """``tp, fp, fn, precision, recall`` of one row; ratios without a denominator are 0."""
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    got = rows.agg(count(predicted & label).alias("tp"), count(predicted & ~label).alias("fp"), count(~predicted & label).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.round(a / F.nullif(a + b, F.lit(0)), 6), F.lit(0.0))
    return got.select("*", ratio(F.col("tp"), F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("fn")).alias("recall"))


def abstention(outcomes: DataFrame) -> DataFrame:
    """``n, unresolved, abstained, precision`` of one row: shares without candidates and without an attribution, and right ones of the attributed.

    ``outcomes``: status, actor, truth.
    """
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6)
    made = F.col("status") == "attributed"
    right = F.sum(F.when(made & (F.col("actor") == F.col("truth")), 1).otherwise(0)) / F.nullif(F.sum(F.when(made, 1).otherwise(0)), F.lit(0))
    return outcomes.agg(F.count(F.lit(1)).alias("n"), share(F.col("status") == "unresolved").alias("unresolved"), share(~made).alias("abstained"), F.coalesce(F.round(right, 6), F.lit(0.0)).alias("precision"))


def neighbour_recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted, found, recall``: the share of wanted pairs among the found ones."""
    hit = wanted.select("a", "b").distinct().join(found.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return hit.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("recall"))


def summarize(runs: DataFrame, condition: str, metrics) -> DataFrame:
    """Mean, least and greatest of metrics over runs per condition."""
    aggs = [f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("min", F.min), ("max", F.max))]
    return runs.groupBy(condition).agg(*aggs)


def boundary_gate(events: DataFrame, incident_nodes: DataFrame, top: int = 3, coverage: float = 0.8, purity: float = 0.5) -> DataFrame:
    """``incident, covered, purity, passed``: do the traces with the most attack nodes hold them, and little else.

    ``events``: trace_id, node; ``incident_nodes``: incident, node.
    """
    nodes = events.select("trace_id", "node").distinct()
    sizes = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("size"))
    hits = nodes.join(incident_nodes.distinct(), "node").groupBy("incident", "trace_id").agg(F.count(F.lit(1)).alias("hits"))
    rank = F.row_number().over(Window.partitionBy("incident").orderBy(F.col("hits").desc(), "trace_id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= top).join(sizes, "trace_id")
    covered = best.select("incident", "trace_id").join(nodes, "trace_id").join(incident_nodes.distinct(), ["incident", "node"]).select("incident", "node").distinct().groupBy("incident").agg(F.count(F.lit(1)).alias("c"))
    pure = best.groupBy("incident").agg(F.sum("hits").alias("h"), F.sum("size").alias("s"))
    total = incident_nodes.distinct().groupBy("incident").agg(F.count(F.lit(1)).alias("t"))
    rows = total.join(covered, "incident", "left").join(pure, "incident", "left")
    share, clean = F.coalesce(F.round(F.col("c") / F.col("t"), 6), F.lit(0.0)), F.coalesce(F.round(F.col("h") / F.col("s"), 6), F.lit(0.0))
    return rows.select("incident", share.alias("covered"), clean.alias("purity"), ((share >= coverage) & (clean >= purity)).alias("passed"))


def separability(sketches: DataFrame, label: str, id_col: str, per_class: int = 200, seed: int = 7) -> DataFrame:
    """``auc`` of sketch similarity between pairs of one label and pairs of two, over a hash-chosen sample."""
    from ..functions.text import sketch_jaccard

    order = F.xxhash64(F.col(id_col), F.lit(seed))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order, id_col))
    rows = sketches.withColumn("k", rank).where(F.col("k") <= per_class)
    a = rows.select(F.col(id_col).alias("ia"), F.col(label).alias("la"), F.col("sketch").alias("sa"), "k")
    b = rows.select(F.col(id_col).alias("ib"), F.col(label).alias("lb"), F.col("sketch").alias("sb"), "k")
    near = a.withColumn("m", F.col("k") % 20).join(b.withColumn("m", F.col("k") % 20).drop("k"), "m").where("ia < ib")
    scored = near.select(F.round(sketch_jaccard(F.col("sa"), F.col("sb")), 6).alias("s"), F.when(F.col("la") == F.col("lb"), 1).otherwise(0).alias("y"))
    return auc(scored, "s", "y")
