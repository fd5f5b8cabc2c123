import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty, text
from pyspark.sql import functions as F

from tracelode.llm import quality_classifier as qc
from tracelode.llm import quality_rules as qr
from tracelode.llm.common import fold


def junk(rng, n):
    kind = rng.randrange(3)
    words = text(rng, n).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(("$$$", "&&&", "%%%")) for w in words)
    return " ".join([words[0]] * n)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(i, junk(rng, 60 + i % 50) if i % 5 == 0 else text(rng, 60 + i % 50)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 600, 2)], "doc_id long, quality int")


def test_pu_learns_from_positives_alone(corpus):
    docs, labels = corpus
    ids = {r.doc_id for r in qc.trusted_ids(labels).collect()}
    import zlib

    assert ids == {i for i in range(0, 600, 2) if i % 5 and zlib.crc32(str(i).encode()) % 3 != 1}
    got = qc.score_quality(docs, qc.trusted_ids(labels)).toPandas()
    truth = (got.doc_id % 5 != 0).astype(int)
    assert (got.predicted == truth).mean() > 0.95 and got.score.between(0, 1).all()
    kept = qc.keep_good(docs, qc.trusted_ids(labels))
    assert kept.columns == docs.columns and kept.count() == int(got.predicted.sum())


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2800), n[:1200]])
    assert abs(qc.estimate_prior(p, u) - 0.7) < 0.06


def test_classifier_awkward(spark):
    df = awkward(spark)
    trusted = df.where("doc_id < 6").select("doc_id")
    got = qc.score_quality(df, trusted)
    assert got.count() == df.count() and got.where("score is null").count() == 0
    none = qc.score_quality(df, trusted.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert qc.score_quality(empty(df), trusted).count() == 0


def brute_rules(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {j for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if tri[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(9)
    few = ["a", "b", "c#", "d|"]
    texts = [" ".join(rng.choice(few) for _ in range(rng.randrange(40))) for _ in range(60)] + ["x y z\nx y z\n\n \nx y z", "a b c", "a b c a b c", "é\u2003x \x1c y", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(awkward(spark).select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = qr.apply_rules(df, df.select("doc_id").limit(0)).join(df, "doc_id").collect()
    assert rows
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text), r.text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_ratio_equals_brute_force(spark, corpus):
    docs, _ = corpus
    trusted = docs.where("doc_id % 5 <> 0 and doc_id % 2 = 0").select("doc_id")
    n = 512
    grams = docs.select("doc_id", qr.ngram_buckets(F.col("text"), n).alias("g")).toPandas()
    good = set(trusted.toPandas().doc_id)
    raw, target = np.zeros(n), np.zeros(n)
    for i, g in zip(grams.doc_id, grams.g, strict=True):
        c = np.bincount(g, minlength=n)
        raw += c
        target += c * (i in good)
    w = np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))
    want = {i: w[np.array(g)].mean() for i, g in zip(grams.doc_id, grams.g, strict=True)}
    got = qr.apply_rules(docs, trusted, buckets=n).toPandas()
    assert all(abs(want[i] - s) < 1e-5 for i, s in zip(got.doc_id, got.score, strict=True))
    assert (got.kept == (~got.base_failed & (got.score >= qr.THRESHOLD))).all()
    by = got.assign(good=got.doc_id % 5 != 0)
    assert by[by.good].kept.mean() > 0.95 and by[~by.good].kept.mean() < 0.1


def test_rules_awkward_and_native(spark):
    df = awkward(spark)
    out = qr.apply_rules(df, df.select("doc_id").where("doc_id < 5"))
    assert out.count() == df.count() and qr.apply_rules(empty(df), df.select("doc_id")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fold(spark):
    import zlib

    rows = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def plain_risk(params, x, n, prior, decay=1e-4):
    w1, b1, w2, b2 = params
    z = np.array([float(np.maximum(r @ w1 + b1, 0) @ w2[:, 0] + b2[0]) for r in x])
    one, zero = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
    wd = decay / 2 * (float((w1 * w1).sum()) + float((w2 * w2).sum()))
    if prior is None:
        return one[:n].mean() + zero[n:].mean() + wd
    negative = zero[n:].mean() - prior * zero[:n].mean()
    return (prior * one[:n].mean() + negative if negative >= 0 else -negative) + wd


@pytest.mark.parametrize(("prior", "lift"), [(None, 0.0), (0.3, 0.0), (0.95, 3.0)])
def test_gradients_equal_differences_of_the_risk(prior, lift):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 5))
    x[:10] += lift
    params = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=(4, 1)), rng.normal(size=1)]
    if lift:  # unlabelled rows score low, positives high: the negative part is below zero
        params[0], params[2] = np.abs(params[0]), np.abs(params[2])
        x[10:] -= lift
    grads = qc.risk_gradients(params, x, 10, prior)
    zero = np.logaddexp(0, (np.maximum(x @ params[0] + params[1], 0) @ params[2] + params[3])[:, 0])
    if prior is not None:
        assert (zero[10:].mean() - prior * zero[:10].mean() < 0) == bool(lift)
    for w, g in zip(params, grads, strict=True):
        for at in np.ndindex(w.shape):
            old = w[at]
            w[at] = old + 1e-5
            up = plain_risk(params, x, 10, prior)
            w[at] = old - 1e-5
            down = plain_risk(params, x, 10, prior)
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_scores_equal_a_plain_forward_pass(spark, corpus):
    docs, labels = corpus
    model = qc.train_model(docs, qc.trusted_ids(labels))
    got = {r.doc_id: r.score for r in qc.score_quality(docs, qc.trusted_ids(labels)).collect()}
    w1, b1, w2, b2 = model.weights
    for r in docs.where("doc_id % 40 = 0").collect():
        x = (np.array(qc.text_features(r.text.encode())) - model.mean) / model.scale
        z = sum(w2[k, 0] * max(0.0, float(sum(x[j] * w1[j, k] for j in range(len(x))) + b1[k])) for k in range(len(b1))) + b2[0]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_repeated_ids_train_alike(spark):
    rows = [(i % 20, text(random.Random(i), 30 + i)) for i in range(60)]
    models = [qc.train_model(spark.createDataFrame(x, "doc_id long, text string").repartition(n), spark.createDataFrame([(i,) for i in range(9)], "doc_id long")) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert all((a == b).all() for a, b in zip(models[0].weights, models[1].weights, strict=True))
