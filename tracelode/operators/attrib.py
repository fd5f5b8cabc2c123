"""Attribution of groups to actors, with an explicit unresolved outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def technique_profiles(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``actor, technique`` sets, and ``technique, idf`` = ln((1 + n) / (1 + c)) over actors."""
    sets = train.select("actor", F.explode("techniques").alias("technique")).distinct()
    n = train.select("actor").distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = sets.groupBy("technique").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n))
    return sets, idf.select("technique", F.ln((1 + F.col("n")) / (1 + F.col("c"))).alias("idf"))


def technique_scores(groups: DataFrame, train: DataFrame) -> DataFrame:
    """``group_id, actor, tech``: half Jaccard, half idf-weighted Jaccard of technique sets."""
    sets, idf = technique_profiles(train)
    g = groups.select("group_id", F.explode("techniques").alias("technique")).distinct()
    weigh = lambda df: df.join(idf, "technique", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    g, a = weigh(g), weigh(sets)
    both = g.join(a.select("actor", "technique"), "technique").groupBy("group_id", "actor").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("w"))
    gs = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("gn"), F.sum("idf").alias("gw"))
    as_ = a.groupBy("actor").agg(F.count(F.lit(1)).alias("an"), F.sum("idf").alias("aw"))
    rows = both.join(gs, "group_id").join(as_, "actor")
    plain = F.col("n") / (F.col("gn") + F.col("an") - F.col("n"))
    union = F.col("gw") + F.col("aw") - F.col("w")
    return rows.select("group_id", "actor", (0.5 * plain + 0.5 * F.when(union > 0, F.col("w") / union).otherwise(0.0)).alias("tech"))


def fit_text_model(train: DataFrame, label: str = "actor", tokens: str = "tokens"):
    """TF-IDF over one- and two-grams into multinomial logistic regression; gives a function to class probabilities."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, SQLTransformer, StringIndexer
    from pyspark.ml.functions import vector_to_array

    n = train.select(label).distinct().count()
    if n < 2:
        raise ValueError("two actors are needed")
    stages = [
        NGram(n=2, inputCol=tokens, outputCol="__two"),
        SQLTransformer(statement=f"SELECT *, concat({tokens}, __two) AS __grams FROM __THIS__"),
        CountVectorizer(inputCol="__grams", outputCol="__tf", minDF=1.0),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        LogisticRegression(labelCol="__label", family="multinomial", regParam=1e-3, maxIter=100),
    ]
    model = Pipeline(stages=stages).fit(train)
    names = model.stages[-2].labels

    def probabilities(df: DataFrame) -> DataFrame:
        out = model.transform(df.withColumn(label, F.lit(names[0])) if label not in df.columns else df)
        p = vector_to_array("probability")
        pairs = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("actor"), F.slice(p, 1, len(names)).alias("p"))
        return out.select("group_id", F.explode(pairs).alias("x")).select("group_id", F.col("x.actor").alias("actor"), F.col("x.p").alias("p"))

    return model, probabilities


def posterior(scores: DataFrame, n_actors: int, unknown_prior: float = S.UNKNOWN_PRIOR) -> DataFrame:
    """``group_id, actor, p`` from ``group_id, actor, s``: softmax over actors and an unknown of logit 0."""
    s = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("s")))
    prior = float((1 - unknown_prior) / n_actors / unknown_prior)
    rows = scores.withColumn("logit", F.ln(s / (1 - s)) + F.ln(F.lit(prior)))
    w = Window.partitionBy("group_id")
    top = F.greatest(F.max("logit").over(w), F.lit(0.0))
    rows = rows.withColumn("e", F.exp(F.col("logit") - top)).withColumn("u", F.exp(-top))
    total = F.sum("e").over(w) + F.col("u")
    return rows.select("group_id", "actor", (F.col("e") / total).alias("p"), (F.col("u") / total).alias("unknown"))


def fuse(classifier: Column, technique: Column) -> Column:
    return S.CLASSIFIER_WEIGHT * classifier + S.TECHNIQUE_WEIGHT * technique


def outcome(posteriors: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``group_id, status, actor, p, unknown, candidates``: attributed, candidates or unresolved.

    Attribution needs 0.9 and, where ``evidence`` (group_id, n_classes) is given, two classes.
    """
    best = posteriors.groupBy("group_id").agg(
        F.max_by(F.struct("actor", "p"), F.struct(F.col("p"), F.col("actor"))).alias("best"), F.first("unknown").alias("unknown"),
        F.array_sort(F.collect_list(F.when(F.col("p") >= S.CANDIDATE_P, F.col("actor")))).alias("candidates"),
    )
    several = F.lit(True)
    if evidence is not None:
        best = best.join(evidence, "group_id", "left")
        several = F.coalesce(F.col("n_classes") >= 2, F.lit(False))
    status = F.when((F.col("best.p") >= S.ATTRIBUTED_P) & several, "attributed").when(F.size("candidates") > 0, "candidates").otherwise("unresolved")
    return best.select("group_id", status.alias("status"), F.when(status != "unresolved", F.col("best.actor")).alias("actor"), F.col("best.p").alias("p"), "unknown", "candidates")
