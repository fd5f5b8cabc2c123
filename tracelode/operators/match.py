"""Pair features, scores, budgets and calibrated models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import duration_sim, jaccard, sketch_jaccard
from .ranges import running

FEATURES = ("minhash", "tfidf", "idf_shared", "technique", "provenance", "gap", "shared", "duration")


def idf_table(docs: DataFrame, id_col: str, terms: str, plus: float = 1.0) -> DataFrame:
    """``term, df, idf``: ln((N + 1) / (df + 1)) + plus."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + plus).alias("idf"))


def tfidf_cosine(pairs: DataFrame, docs: DataFrame, id_col: str, terms: str, sublinear: bool = False) -> DataFrame:
    """``a, b, tfidf`` for given pairs: raw term counts times idf, cosine; 0 where nothing is shared."""
    idf = idf_table(docs, id_col, terms)
    tf = docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = (1 + F.ln("tf")) if sublinear else F.col("tf")
    w = tf.join(idf, "term").select("id", "term", (weight * F.col("idf")).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left = pairs.join(w.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), "a")
    dots = left.join(w.select(F.col("id").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dots, ["a", "b"], "left").join(norm.toDF("a", "na"), "a", "left").join(norm.toDF("b", "nb"), "b", "left")
    return out.select("a", "b", F.coalesce(F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6), F.lit(0.0)).alias("tfidf"))


def idf_shared(pairs: DataFrame, uses: DataFrame, idf: DataFrame, trace: str, value: str) -> DataFrame:
    """``a, b, idf_shared``: the sum of idf over shared values."""
    u = uses.select(trace, value).distinct().join(idf.select(F.col("term").alias(value), "idf"), value)
    both = pairs.join(u.withColumnRenamed(trace, "a"), "a").join(uses.select(F.col(trace).alias("b"), value).distinct(), ["b", value])
    return pairs.join(both.groupBy("a", "b").agg(F.sum("idf").alias("s")), ["a", "b"], "left").select("a", "b", F.coalesce(F.round("s", 6), F.lit(0.0)).alias("idf_shared"))


def pair_features(pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """Adds to ``a, b, tfidf, idf_shared, shared, provenance_shared`` the other features of both traces.

    ``traces``: trace_id, sketch, techniques, start_ts, end_ts.
    """
    t = traces.select("trace_id", "sketch", "techniques", "start_ts", "end_ts")
    rows = pairs.join(t.toDF("a", "sa", "ta", "a0", "a1"), "a").join(t.toDF("b", "sb", "tb", "b0", "b1"), "b")
    gap = F.greatest(F.lit(0.0), F.greatest("a0", "b0") - F.least("a1", "b1"))
    return rows.select(
        "a", "b", F.round(sketch_jaccard(F.col("sa"), F.col("sb")), 6).alias("minhash"), "tfidf", "idf_shared",
        F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("technique"), F.when(F.col("provenance_shared") > 0, 1.0).otherwise(0.0).alias("provenance"),
        F.round(F.log1p(gap / 60), 6).alias("gap"), F.col("shared").cast("double").alias("shared"), F.round(duration_sim(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")), 6).alias("duration"),
    )


def estimate_similarity(mh: Column, tfidf: Column, technique: Column, idf: Column) -> Column:
    return 0.45 * mh + 0.30 * tfidf + 0.15 * technique + 0.10 * idf / (1 + idf)


def baseline_score(mh: Column, tfidf: Column, shared: Column, technique: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * mh + 0.30 * tfidf + 0.15 * F.least(F.lit(1.0), shared.cast("double")) + 0.10 * technique)


def evidence_classes(mh: Column, tfidf: Column, shared: Column, technique: Column, provenance: Column) -> Column:
    """Names of the kinds of evidence that a pair has."""
    tests = {"behavior": mh >= 0.4, "execution": tfidf >= 0.5, "infrastructure": shared > 0, "technique": technique > 0, "provenance": provenance > 0}
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def demo_evidence(mh: Column, shared: Column, technique: Column, gap_hours: Column, idf: Column) -> tuple[Column, Column]:
    """The five features of the batch path, and how many of three classes they show."""
    vector = F.array(mh, idf, technique, shared.cast("double"), -F.log1p(gap_hours))
    count = F.when(mh > 0.05, 1).otherwise(0) + F.when(shared > 0, 1).otherwise(0) + F.when(technique > 0, 1).otherwise(0)
    return vector, count


def pair_cost(size_a: Column, size_b: Column) -> Column:
    return (F.least(size_a, F.lit(256)) * F.least(size_b, F.lit(256)) + 1).cast("long")


def degraded(cost: Column, limit: int) -> Column:
    """Whether a pair is scored without its sketch: by its cost, not by the clock, so that reruns agree."""
    return cost > limit


def contributions(values: Column, weights: list[float]) -> Column:
    return F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w)


def budget_round(jobs: DataFrame, budget: int = S.ROUND_BUDGET, priority: str = "estimate", cost: str = "cost", order: str = "seq", group: str | None = None) -> DataFrame:
    """Best jobs first while their running cost fits; the head always goes, the first misfit ends the round.

    ``group`` runs a round per group, in parallel; without it the queue is one ordered list, of which
    no task sees more than a range of priorities.
    """
    if group is None:
        rows = running(jobs, F.col(priority), [order], {"running": F.col(cost)}, descending=True)
        rows = rows.withColumnRenamed("__position", "position").withColumn("running", F.col("running").cast("long"))
    else:
        w = Window.partitionBy(group).orderBy(F.col(priority).desc(), order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = jobs.withColumn("position", F.row_number().over(w).cast("long")).withColumn("running", F.sum(cost).over(upto).cast("long"))
    return rows.where((F.col("running") <= budget) | (F.col("position") == 1))


def rounds(jobs: DataFrame, budget: int = S.ROUND_BUDGET, priority: str = "estimate", cost: str = "cost", order: str = "seq") -> DataFrame:
    """Adds ``position`` and ``round``: jobs best first, a round for each budget's worth of running cost."""
    rows = running(jobs, F.col(priority), [order], {"__running": F.col(cost)}, descending=True)
    rows = rows.withColumnRenamed("__position", "position").withColumn("round", F.floor((F.col("__running") - 1) / budget).cast("long"))
    return rows.select(*jobs.columns, "position", "round")


def order_candidates(pairs: DataFrame, mode: str = "best_first", by: str = "similarity", inserted: str = "seq", trace: str = "a") -> DataFrame:
    """Adds ``position`` per trace: by similarity, or first in first out."""
    if mode not in ("best_first", "fifo"):
        raise ValueError("best_first or fifo is expected")
    w = Window.partitionBy(trace).orderBy(*([F.col(by).desc()] if mode == "best_first" else []), inserted)
    return pairs.withColumn("position", F.row_number().over(w).cast("long"))


def degree_priority(jobs: DataFrame) -> DataFrame:
    """estimate / sqrt(degree a * degree b), degrees counted over the jobs."""
    ends = jobs.select(F.col("a").alias("n")).union(jobs.select(F.col("b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    rows = jobs.join(ends.toDF("a", "da"), "a").join(ends.toDF("b", "db"), "b")
    return rows.withColumn("priority", F.round(F.col("estimate") / F.sqrt(F.col("da") * F.col("db")), 6))


def round_robin(candidates: DataFrame, budget: int) -> DataFrame:
    """Round r takes every trace's r-th candidate, in trace order, until the budget of pairs."""
    return candidates.orderBy("rank", "a").limit(budget)


def fit_pair_model(pairs: DataFrame, features=FEATURES, label: str = "label", seed: int = 42, c: float = 1.0):
    """Logistic regression on three quarters, isotonic calibration on the margins of the rest.

    Rows are split by hash within each label. Fewer than 12 rows, or a class with fewer than two,
    calibrate on the rows they were fitted on. Returns the fitted models and a scoring function.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(pairs)
    n, classes, fewest = rows.groupBy(label).count().agg(F.sum("count"), F.count(F.lit(1)), F.min("count")).first()
    if classes != 2:
        raise ValueError("two classes are needed")
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(*features, F.lit(seed)), *features))
    size = F.count(F.lit(1)).over(Window.partitionBy(label))
    held = F.when(F.lit(n < 12 or fewest < 2), F.lit(True)).otherwise(place > F.ceil(size * 0.75))
    rows = rows.withColumn("held", held)
    fitted_on = rows if n < 12 or fewest < 2 else rows.where(~F.col("held"))
    lr = LogisticRegression(labelCol=label, regParam=1 / (c * max(1, fitted_on.count())), standardization=False, maxIter=200).fit(fitted_on)
    margin = lambda df: lr.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction")
    iso = IsotonicRegression(labelCol=label, featuresCol="margin").fit(margin(rows.where("held")))

    def score(df: DataFrame) -> DataFrame:
        out = margin(VectorAssembler(inputCols=list(features), outputCol="features").transform(df))
        out = iso.transform(out).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
        return out.drop("features", "rawPrediction", "probability", "prediction")

    return lr, iso, score


def decision_context(coefficients, intercept: float) -> str:
    """A hash that names a model's parameters."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"coef": [float(x) for x in coefficients], "intercept": float(intercept)}, sort_keys=True).encode()).hexdigest()


def best_threshold(scored: DataFrame, score: str = "cos", label: str = "label") -> DataFrame:
    """``threshold, accuracy`` of the cut with the most right answers, the least on ties."""
    by = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    total = by.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    by = running(by, F.col("threshold"), [], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}).crossJoin(F.broadcast(total))
    # below the threshold negatives are right, from it on positives
    right = F.col("neg_upto") - F.col("neg") + F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    return by.select("threshold", (right / (F.col("all_pos") + F.col("all_neg"))).alias("accuracy")).orderBy(F.col("accuracy").desc(), "threshold").limit(1)
