"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

The network sees statistics of the text only. It is fitted on the driver on a bounded sample
(``max_positives`` and ``max_unlabelled`` rows, the smallest by a hash of the id) and scores every
document's whole text on the executors.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, slices

FEATURES = (
    "log_words", "log_bytes", "word_bytes", "upper", "digit", "high", "stop_marks", "bang", "rare_marks",
    "bars", "quotes", "distinct_words", "adjacent_equal", "top_word", "distinct_lines", "words_a_line", "distinct_bytes",
)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop_marks": b".,;:?", "bang": b"!", "rare_marks": b"#$%&*@^~+=", "bars": b"|<>{}[]\\", "quotes": b"'\"`()_/-"}
_TABLE = np.zeros((256, len(_CLASSES) + 1), np.float64)
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _i] = 1
_TABLE[128:, -1] = 1


def text_features(text: bytes | None) -> list[float]:
    """Scale-free statistics of one text in UTF-8; a null text is an empty one."""
    text = text or b""
    n = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = seen @ _TABLE / max(n, 1)
    by = dict(zip([*_CLASSES, "high"], shares, strict=True))
    words = text.split()
    k = len(words)
    counts = Counter(words)
    distinct = len(counts)
    again = sum(map(eq, words, words[1:]))
    lines = text.split(b"\n")
    return [
        np.log1p(k), np.log1p(n), n / max(k, 1) / 10, by["upper"], by["digit"], by["high"], by["stop_marks"], by["bang"], by["rare_marks"],
        by["bars"], by["quotes"], np.log1p(distinct) / np.log1p(k) if k else 0.0, again / max(k - 1, 1), max(counts.values()) / k if k else 0.0,
        len(set(lines)) / len(lines), np.log1p(k / len(lines)), np.count_nonzero(seen) / 128,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk_gradients(params: list[np.ndarray], x: np.ndarray, n: int, prior: float | None, decay: float = 1e-4) -> list[np.ndarray]:
    """Gradients of the risk over rows ``x``, of which the first ``n`` are positive and the others unlabelled.

    With a prior it is the non-negative estimate with logistic loss: prior * R_p(+) + max(0, R_u(-) -
    prior * R_p(-)); where the second part is negative the step goes back along it alone. Without one
    it is the plain mean loss of positives against unlabelled rows.
    """
    w1, b1, w2, b2 = params
    h = np.maximum(x @ w1 + b1, 0)
    z = (h @ w2 + b2)[:, 0]
    s = _sigmoid(z)
    # gradients by output of the logistic losses l(z) (wants 1) and l(-z) (wants 0)
    to_one, to_zero = s - 1, s
    g = np.zeros(len(x))
    if prior is None:
        g[:n], g[n:] = to_one[:n] / n, to_zero[n:] / (len(x) - n)
    else:
        zero_loss = np.logaddexp(0, z)
        negative = zero_loss[n:].mean() - prior * zero_loss[:n].mean()
        if negative >= 0:
            g[:n] = prior * (to_one[:n] - to_zero[:n]) / n
            g[n:] = to_zero[n:] / (len(x) - n)
        else:  # the negative part is over-fitted: step back along it only
            g[:n] = prior * to_zero[:n] / n
            g[n:] = -to_zero[n:] / (len(x) - n)
    gh = g[:, None] * w2[:, 0] * (h > 0)
    return [x.T @ gh + decay * w1, gh.sum(0), h.T @ g[:, None] + decay * w2, g.sum(keepdims=True)]


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, hidden: int, epochs: int, rate: float) -> list[np.ndarray]:
    """Adam on the non-negative PU risk with logistic loss; ``prior`` None trains positives against unlabelled."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, p.shape[1] ** -0.5, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in params]
    x = np.concatenate([p, u])
    n = len(p)
    for step in range(1, epochs + 1):
        grads = risk_gradients(params, x, n, prior)
        for w, d, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives: the least ratio of upper tails, with a confidence margin.

    For every threshold the unlabelled share above it over the positives' share above it bounds the
    prior from above; the margin keeps thresholds with few rows from winning by chance.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    margin = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    best = np.argmin((u + margin) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11, hidden: int = 24, epochs: int = 600, rate: float = 0.02) -> Model:
    """Fit on feature rows: half of each side estimates the class prior, all of them train the classifier."""
    width = len(FEATURES)
    if not len(positive) or not len(unlabelled):  # nothing to learn from: every score is one half
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 0.5)
    # rows come in order of id: the halves are drawn at random, ids may have a pattern
    rng = np.random.default_rng(seed)
    positive, unlabelled = rng.permutation(positive), rng.permutation(unlabelled)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rough = Model(np.zeros(width), np.ones(width), _train(p[::2], u[::2], None, seed, hidden, epochs // 3, rate), 0.5)
    prior = estimate_prior(rough.logits(p[1::2]), rough.logits(u[1::2]))
    return Model(mean, scale, _train(p, u, prior, seed + 1, hidden, epochs, rate), prior)


def _features_frame(documents: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text=len(keep)):
                rows = pa.array([text_features(x) for x in part.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], rows], [*keep, "features"])

    return documents.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def train_model(documents: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positives: int = 6000, max_unlabelled: int = 12000, seed: int = 11) -> Model:
    """Fit on at most ``max_positives`` trusted and ``max_unlabelled`` other documents, the first by hash of id.

    ``positives`` holds trusted ids. Both bounds are independent of the corpus; the sample's ids are
    broadcast (18,000 longs at most by default).
    """
    first = lambda df, n: df.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(n)
    ids = first(positives, max_positives).withColumn("__p", F.lit(1)).withColumn("__u", F.lit(0))
    ids = ids.unionByName(first(documents, max_unlabelled).withColumn("__p", F.lit(0)).withColumn("__u", F.lit(1)))
    ids = ids.groupBy("__id").agg(F.max("__p").alias("__p"), F.max("__u").alias("__u"))
    rows = documents.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).join(F.broadcast(ids), F.col("__i") == F.col("__id"))
    rows = rows.groupBy("__i", "__p", "__u").agg(F.min("__t").alias("__t"))  # the first of texts that repeat an id
    got = _features_frame(rows, ["__i", "__p", "__u"], "__t").toPandas().sort_values("__i")
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
    x = np.array(got["features"].tolist(), dtype=np.float64)
    return fit(x[got["__p"] == 1], x[got["__u"] == 1], seed=seed)


def score_quality(documents: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score whole texts; nothing but the text enters a score.

    Returns the id, ``score`` (0 to 1, the probability of good quality) and ``predicted`` (score >=
    0.5) for every row: nulls and empty texts are scored as a text without words, texts of any length
    whole, repeated rows each, null ids too (they are only left out of the sample, where of texts that
    repeat an id the first counts). Without trusted documents every score is 0.5. An empty table
    gives an empty result; extra columns, whatever their names, are not read.
    """
    model = train_model(documents, positives, id_col, text_col, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([documents.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text=1):
                x = np.array([text_features(t) for t in part.column(1).to_pylist()])
                s = shared.value.scores(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema.fieldNames())

    return documents.select(id_col, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def keep_good(documents: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` predicted good, all columns kept, whatever their names; each row is judged on its own text as in ``score_quality``."""
    model = train_model(documents, positives, id_col, text_col, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text=at):
                x = np.array([text_features(t) for t in part.column(at).cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(shared.value.scores(x) >= 0.5))

    return documents.mapInArrow(run, documents.schema)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids labelled good, of the folds that may be learnt from (crc32 of the id modulo 3 is not 1)."""
    return labels.where((F.col(label_col) == 1) & (fold(F.col(id_col), 3) != 1)).select(id_col)
