"""Corpus operators on texts that bounds once cut short."""

import random

import numpy as np
import pytest
from helpers import text

from tracelode.llm import lm_scoring as lm
from tracelode.llm import pii
from tracelode.llm.quality_classifier import FEATURES, text_features
from tracelode.llm.tokens import WordTokens


def mixed_line(rng, n):
    """One line of very many shapes with entities that only the field finds, between them."""
    odd = lambda: "".join(rng.choice("aZ9-_/.:;+=é") for _ in range(14))
    words = []
    for i in range(n):
        words.append(odd())
        if i % 50 == 0:
            words += ["mail", "jane", "(at)", "mail", "(dot)", "org", "then", 'token = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"', "or"]
    return " ".join(words)


def test_field_spans_do_not_depend_on_the_shape_bound(monkeypatch):
    crf = pii.train_field()
    rng = random.Random(6)
    texts = [mixed_line(rng, 700), "short text, (555) 123-4567 there", mixed_line(rng, 60) + "\n" + mixed_line(rng, 300), "", mixed_line(rng, 20)]
    want = pii.field_spans(texts, crf)
    assert len(crf.ids) > 900 and all(len(s) > 5 for s in (want[0], want[2]))
    assert any("(at)" in texts[0][a:b] and "(dot)" in texts[0][a:b] for _, a, b in want[0])
    for most in (900, 100, 7):
        monkeypatch.setattr(pii, "MOST_SHAPES", most)
        fresh = pii.Field(crf.weights, crf.trans)
        assert pii.field_spans(texts, fresh) == want
        assert [pii.field_spans([t], fresh)[0] for t in texts] == want


def test_field_reads_a_line_of_more_shapes_than_it_numbers():
    rng = random.Random(7)
    line = mixed_line(rng, 215_000)
    crf = pii.train_field()
    spans = pii.field_spans([line], crf)[0]
    found = sum("(at)" in line[a:b] for k, a, b in spans if k == "email")
    assert found > 0.9 * 4300 and sum(k == "secret" for k, _, _ in spans) > 0.9 * 4300


def test_field_spans_beside_base_spans_stay():
    crf = pii.train_field()
    for text, kept in (("write jane (at) mail (dot) org bob@x.org today", "jane (at) mail (dot) org"), ("call (555) 123-4567 +1 (555) 555-0199 now", "555) 123-4567")):
        base, more = pii.base_spans(text), pii.field_spans([text], crf)[0]
        spans = pii.all_spans(base, more, text)
        assert set(base) < set(spans) and any(kept in text[a:b] for _, a, b in spans[len(base) :])
        assert kept not in pii.mask(text, spans)


def test_rest_of_field_spans():
    text = "aa bb, cc dd; ee"
    assert pii.all_spans([("ip", 3, 5)], [("phone", 0, 9)], text) == [("ip", 3, 5), ("phone", 0, 2), ("phone", 7, 9)]
    assert pii.all_spans([("ip", 3, 12), ("card", 7, 9)], [("phone", 3, 13)], text) == [("ip", 3, 12), ("card", 7, 9)]
    assert pii.all_spans([], [("phone", 0, 2)], text) == [("phone", 0, 2)]
    rng = random.Random(2)
    for _ in range(500):
        cut = sorted(rng.sample(range(41), 6))
        more = [("phone", *cut[:2]), ("email", *cut[2:4]), ("phone", *cut[4:])]
        base = [("ip", a, a + rng.randrange(1, 9)) for a in rng.sample(range(32), rng.randrange(4))]
        inside = lambda spans: {i for _, a, b in spans for i in range(a, b)}
        spans = pii.all_spans(base, more, "x" * 41)
        assert inside(spans) == inside(base) | inside(more) and not inside(spans[len(base) :]) & inside(base)


def test_a_long_text_does_not_end_the_sample():
    lengths = [900, 3, 5, 40]
    share = lm.even_share(lengths, 100)
    assert share == 52 and sum(min(n, share) for n in lengths) == 100
    assert lm.even_share([3, 5], 100) == 5 and lm.even_share([], 5) == 1 and lm.even_share([9, 9], 10) == 5


def test_network_reads_every_training_text(spark):
    rng = random.Random(8)
    texts = [text(rng, 40 + 30 * (i % 5)) for i in range(60)] + [None, "", text(rng, 3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    uni = np.zeros(lm.IDS)
    uni[:2000] = np.random.default_rng(1).integers(1, 99, 2000)
    vocabulary, shares = lm.build_vocabulary(uni, np.ones((lm.SIZE, lm.SIZE)))
    scorer = lm.Scorer(vocabulary, lm.Network(shares))
    start = {k: w.copy() for k, w in scorer.network.p.items()}
    tokens, sums, total = WordTokens(), dict.fromkeys(start, 0.0), 0
    for rows in df.rdd.glom().collect():  # each part by hand
        network = lm.Network(shares)
        network.p = {k: w.copy() for k, w in start.items()}
        ids = [np.frombuffer(b"".join(tokens[w] for w in (r.text or "").lower().split()) + lm.END_ID.to_bytes(4, "little"), "<u4") for r in rows]
        network.read(*scorer.lessons(ids), network.moments(*lm.COUNTED), 0)
        seen = sum(map(len, ids))
        total += seen
        sums = {k: sums[k] + seen * network.p[k].astype(float) for k in start}
    lm.read_all(df, "text", scorer, None)
    for k, w in scorer.network.p.items():
        assert np.allclose(w, sums[k] / total, atol=1e-5) and (k in lm.COUNTED) == np.allclose(w, start[k], atol=1e-3), k


def test_read_uses_every_live_place_once(monkeypatch):
    net, used = lm.Network(np.full((lm.SIZE, lm.CLASSES), 1 / lm.CLASSES)), np.zeros((21, lm.STRIDE), int)
    before = np.arange(21 * lm.STRIDE).reshape(21, lm.STRIDE)
    live = np.random.default_rng(3).random(before.shape) < 0.8

    def grads(b, begin, target, use, table):
        np.add.at(used.ravel(), b.ravel()[use], 1)
        return {}

    monkeypatch.setattr(net, "_gradients", grads)
    net.read(before, np.zeros(21, bool), before % lm.CLASSES, live, {}, 0)
    assert (used == live).all()


def test_top_word_is_of_the_whole_text():
    words = [f"w{i}" for i in range(320)]
    words[1:320:21] = ["same"] * 16
    assert text_features(" ".join(words).encode())[FEATURES.index("top_word")] == 16 / 320
    assert text_features(None)[FEATURES.index("top_word")] == 0 and text_features(b"a b a")[FEATURES.index("top_word")] == 2 / 3


def test_entities_side_by_side_stay_apart():
    crf = pii.train_field()
    found = lambda t: pii.written(pii.all_spans(pii.base_spans(t), pii.field_spans([t], crf)[0], t))
    assert found("bo.12@kim3.example.com jane (at) corp (dot) com") == "email:0:22,email:23:47"
    assert found("jane (at) mail (dot) org bob (at) mail (dot) com") == "email:0:24,email:25:48"
    assert found("4111111111111111 5500005555555559") == "card:0:16,card:17:33"
    assert found("call (555) 123-4567 (555) 123-4568 now") == "phone:5:19,phone:20:34"


def test_secret_after_its_name():
    crf = pii.train_field()
    for t in ("password=ab12cd34ef56ab", "set password=ab12cd34ef56ab now", "the passwd=0a1b2c3d4e5f66 x"):
        assert any(k == "secret" for k, _, _ in pii.field_spans([t], crf)[0]), t
    assert pii.field_spans(["see page=12 and key=value, Version 3.2."], crf) == [[]]


def test_masking_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a.b@c.example.org", "m", 7, 22), (None, None, None, None, None), (1, "", "m", 7, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, masked string, chars int, n_chars long")
    out = pii.mask_pii(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "mail <EMAIL>", "m", 7, 12), (None, None, None, None, None), (1, "", "m", 7, 0)], key=repr)


def test_skipped_words_are_outside_on_the_best_path():
    """Tags of lines decoded in open runs equal those of a Viterbi over every word."""
    crf = pii.train_field()
    rng = random.Random(11)
    kinds = [t for t, _ in pii.labelled_table(300, seed=8)]
    for _ in range(120):
        line = [w for _ in range(4) for w in [*text(rng, rng.randrange(6)).split(), *rng.choice(kinds)]]
        words = ["", "", *line, "", ""]
        e = crf.emissions(crf.numbers(words))[2:-2]
        score, back = crf.trans[0] + e[0], []
        for row in e[1:]:
            paths = score[:, None] + crf.trans
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + row
        want = [int((score + crf.trans[:, 0]).argmax())]
        for b in back[::-1]:
            want.append(int(b[want[-1]]))
        assert crf.tags(words)[2:-2].tolist() == want[::-1]


def test_a_step_takes_the_gradient_of_all_its_runs(monkeypatch):
    """Gradients of a few runs at a time add up to those of all at once."""
    rng = np.random.default_rng(4)
    before, first, target, live = rng.integers(0, lm.SIZE, (70, lm.STRIDE)).astype(np.int16), rng.random(70) < 0.2, rng.integers(0, lm.CLASSES, (70, lm.STRIDE)), rng.random((70, lm.STRIDE)) < 0.7
    got = []
    for together in (1, 1000):
        monkeypatch.setattr(lm, "TOGETHER", together)
        monkeypatch.setattr(lm, "RUN", 8)
        net, steps = lm.Network(np.full((lm.SIZE, lm.CLASSES), 1 / lm.CLASSES)), []
        monkeypatch.setattr(net, "_adam", lambda m, grads, step, rate, steps=steps: steps.append(grads))
        net.read(before, first, target, live, net.moments(*lm.COUNTED), 0)
        got.append(steps)
    for x, y in zip(*got, strict=True):
        assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-5) for k in x)


def test_the_model_is_trained_on_every_text_only(spark, monkeypatch):
    """Each pass reads all texts, of however many; none is picked to start with, and small corpora are read again."""
    read = []
    monkeypatch.setattr(lm, "read_all", lambda rows, *rest: read.append(rows.count()))
    monkeypatch.setattr(lm.Network, "train", lambda *a, **k: pytest.fail("trained on some texts"))
    rng = random.Random(3)
    df = spark.createDataFrame([(i, text(rng, 30)) for i in range(1300)], "id long, text string")
    counts = lm.word_counts(df, "text")
    lm.train_model(df, counts, "id", "text", None)
    assert read == [1300] * lm.PASSES
    read.clear()
    monkeypatch.setattr(lm, "STEPS", 1)
    monkeypatch.setattr(lm, "RUN", 1)
    lm.train_model(df, counts, "id", "text", None)
    assert read == [1300]


def test_texts_are_encoded_once_for_all_passes(spark):
    """Ids and counts of one pass are those of the tokenizer and of plain counting, and a pass that reads ids learns what one that reads texts does."""
    rng = random.Random(5)
    texts = [text(rng, 50), "Ab-c'd 12,5 Été!! Жa ﬁx", None, "", " \n\t ", text(rng, 400), "same same SAME"]
    rows = [(i, t, i % 3 != 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, learnt boolean").coalesce(1)
    got = lm.encode_texts(df, "text", "learnt", None).collect()
    tokens, want = WordTokens(), {}
    for i, t, learnt in rows:
        words = (t or "").encode().lower().split()
        ids = next(np.frombuffer(r.ids, "<u2") for r in got if r.id == i)
        whole = [] if not words else tokens.tokenizer.encode(" ".join(w.decode() for w in words), add_special_tokens=False).ids
        assert ids.tolist() == [*whole, lm.END_ID]
        for w in [*words, b""] if learnt else []:
            want[w.decode()] = want.get(w.decode(), 0) + 1
    assert {r.word: r.c for r in got if r.word is not None} == want and len(got) == len(rows) + len(want)
    uni = np.zeros(lm.IDS)
    uni[:2000] = np.random.default_rng(1).integers(1, 99, 2000)
    vocabulary, shares = lm.build_vocabulary(uni, np.ones((lm.SIZE, lm.SIZE)))
    weights = []
    for rows, ids in ((df, None), (spark.createDataFrame([(r.id, r.ids) for r in got if r.ids], "id long, ids binary").coalesce(1).orderBy("id"), "ids")):
        scorer = lm.Scorer(vocabulary, lm.Network(shares))
        lm.read_all(rows, "text", scorer, None, ids_col=ids)
        weights.append(scorer.network.p)
    assert all(np.allclose(weights[0][k], weights[1][k], atol=1e-6) for k in weights[0])


def test_gradient_of_the_table_and_of_sums_that_overflow():
    rng = np.random.default_rng(6)
    net = lm.Network(np.full((lm.SIZE, lm.CLASSES), 1 / lm.CLASSES))
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    net.p["scale"][0] = 0.25
    before, target = rng.integers(0, 4, (2, lm.STRIDE)), rng.integers(0, lm.CLASSES, 2 * lm.STRIDE)
    first, use = np.array([1, 0], bool), np.ones(2 * lm.STRIDE, bool)
    g, b = net._gradients(before, first, target, use), int(before[1, 3])
    c = int(np.abs(g["table"][b]).argmax())
    z = net.forward(before, first)["z"]
    share = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) / len(z)
    share[np.arange(len(z)), target] -= 1 / len(z)
    assert g["table"][b, c] == pytest.approx(0.25 * share[before.ravel() == b, c].sum(), rel=1e-6)  # it was four times that
    net.p["bias"] += 5000.0  # the same model; sums of its exponentials overflow
    high = net._gradients(before, first, target, use)
    assert all(np.allclose(high[k], g[k], atol=1e-7) for k in g)
