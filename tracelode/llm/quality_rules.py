"""Quality rules in DataFrame functions only: repetition counts and a hashed n-gram likelihood ratio."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams; the weights of all of them are one array of that many doubles.
BUCKETS = 1 << 14
#: A document passes at a mean log ratio of at least this.
THRESHOLD = -0.25
SMOOTHING = 1.0
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the array, first occurrences included.

    A window is its 64-bit hash. A text whose hashes are all distinct has none. In the others a window
    is one long, its position in as many low bits as the count needs, its hash in the rest; sorted,
    equal windows are neighbours. Positions of repeated windows, sorted, each cover up to three words
    not yet covered. Two windows of one text share a hash by chance with a probability under n^3 / 2^65.
    """
    unsigned = lambda x, bits: F.call_function("shiftrightunsigned", x, bits)

    def covered(h: Column) -> Column:
        bits = F.greatest(F.lit(1), F.length(F.bin(F.size(h) + 2))).cast("int")
        windows = F.transform(h, lambda x, i: F.call_function("shiftleft", unsigned(x, bits), bits).bitwiseOR((i + 1).cast("long")))
        again = lambda s: lambda x, i: F.coalesce(unsigned(F.get(s, i - 1), bits) == unsigned(x, bits), F.lit(False)) | F.coalesce(unsigned(F.get(s, i + 1), bits) == unsigned(x, bits), F.lit(False))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        positions = _bound(F.sort_array(windows), lambda s: F.sort_array(F.transform(F.filter(s, again(s)), lambda x: x.bitwiseAND(mask))))
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last"))
        step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last"))
        return F.aggregate(positions, zero, step, lambda a: a["sum"])

    def found(ws: Column) -> Column:
        hashes = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, F.greatest(F.size(ws) - 2, F.lit(0)))
        return _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bound(words, found)).cast("long")


def base_rules(text: Column, words: Column) -> dict[str, Column]:
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    chars = F.coalesce(F.length(F.array_join(words, "")), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.coalesce(F.size(words), F.lit(0)).cast("long"),
        "word_chars": chars.cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all unigrams and bigrams over runs of letters and digits and runs of symbols, case kept."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def both(t: Column) -> Column:
        one = F.transform(t, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
        two = F.transform(t, lambda w, i: F.pmod(F.xxhash64(w, F.get(t, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, F.slice(two, 1, F.greatest(F.size(t) - 1, F.lit(0))))

    return F.element_at(F.transform(F.array(tokens), both), 1)


def ngram_score(text: Column, weights: Column, buckets: int) -> Column:
    """Mean weight of all unigrams and bigrams of the text (``ngram_buckets``); 0 without any."""
    of = lambda *words: F.element_at(weights, F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int") + 1)

    def mean(t: Column) -> Column:
        n = F.size(t)
        each = F.transform(t, lambda w, i: of(w) + F.when(i + 1 < n, of(w, F.get(t, i + 1))).otherwise(0.0))
        return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * n - 1)).otherwise(0.0)

    return _bound(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), mean)


def ngram_weights(documents: DataFrame, targets: DataFrame, id_col: str, text_col: str, buckets: int) -> list[float]:
    """log p(bucket | trusted target) - log p(bucket | raw corpus), over all documents, smoothed by one count.

    Only two sums per bucket come to the driver: ``buckets`` rows whatever the corpus.
    """
    trusted = targets.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().withColumn("__target", F.lit(1))
    # a shuffle at every size: a list of ids has no bound that a broadcast could rely on
    rows = documents.join(trusted.hint("merge"), F.col(id_col) == F.col("__id"), "left")
    rows = rows.select(F.coalesce("__target", F.lit(0)).alias("target"), F.explode(ngram_buckets(F.col(text_col), buckets)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    got = counts.collect()
    all_raw, all_target = sum(r.raw for r in got), sum(r.target for r in got)
    if not all_target:
        return [0.0] * buckets
    # a bucket without counts is in no document of this corpus
    weights = [0.0] * buckets
    for r in got:
        weights[r.bucket] = log((r.target + SMOOTHING) / (all_target + SMOOTHING * buckets)) - log((r.raw + SMOOTHING) / (all_raw + SMOOTHING * buckets))
    return weights


def apply_rules(
    documents: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Base counts, mean log ratio and verdict of every document.

    ``targets`` holds the ids of trusted documents. ``score`` is the mean of the n-gram weights over
    all unigrams and bigrams of the whole text; a document is kept if no base rule fails and its
    score is at least ``threshold``. With no trusted documents all scores are 0.

    A null or empty text has no words, fails the base rule and scores 0; texts of any length are read
    whole. Repeated rows and null ids are judged like any other row; an empty table gives an empty
    result. Extra columns, whatever their names, are not read.
    """
    weights = ngram_weights(documents, targets, id_col, text_col, buckets)
    vector = F.expr("cast(split('" + ",".join(f"{w:.6f}" for w in weights) + "', ',') as array<double>)")
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    score = ngram_score(F.col("text"), vector, buckets)
    rows = rows.select("id", *[c.alias(k) for k, c in base_rules(F.col("text"), F.col("words")).items()], score.alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = (~F.col("base_failed")) & (F.col("score") >= threshold)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(F.col("id").alias(id_col), *names, kept.alias("kept"), "score")

