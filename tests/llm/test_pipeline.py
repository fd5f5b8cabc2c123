import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from helpers import awkward, text
from test_dedup import brute_set, roots

import corpus_pipeline
from tracelode.llm import mixing, pii
from tracelode.llm import quality_classifier as qc
from tracelode.llm.tokens import WordTokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: clean texts, junk, copies and personal data, in a folder of tables."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        t = text(rng, 60 + i % 40)
        if i % 6 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 25 == 7:
            t += " bo.1@mail2.example.com"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(200 + k, rows[k][1] + " more", "en", "s0", 1) for k in (1, 2, 3)]
    top = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mix_sources", "pack"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.toPandas()
    good = {i for i in range(150) if i % 6}
    ids = set(seen["quality"].doc_id)
    assert len(good - ids) <= 2 and len(ids & set(range(0, 150, 6))) <= 3
    kept = set(seen["near_duplicates"].doc_id)
    assert not kept & {201, 202, 203} and {1, 2, 3} & ids <= kept
    assert not seen["personal_data"].text.str.contains("@").any() and set(seen["personal_data"].doc_id) == kept
    words = lambda s: s.text.str.split().str.len().sum()
    assert abs(words(seen["mix_sources"]) - 1.5 * words(seen["personal_data"])) <= 5


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()
    assert corpus_pipeline.ORACLE_SQL is None


def text_rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("kind", ["plain", "awkward"])
def test_stages_equal_brute_force(spark, folder, tmp_path, kind):
    """Each stage on what its predecessor kept, against a plain version: which rows stay, their texts, words taken and tokens packed."""
    if kind == "awkward":
        folder = str(tmp_path)
        awkward(spark).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    again = lambda df: spark.createDataFrame(df.collect(), df.schema)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # quality: each row by the model's verdict on its own text
    model = qc.train_model(docs, qc.trusted_ids(spark.read.parquet(f"{folder}/labels.parquet")))
    good = lambda t: model.scores(np.array([qc.text_features((t or "").encode())]))[0] >= 0.5 if t is not None else model.scores(np.array([qc.text_features(None)]))[0] >= 0.5
    first = again(corpus_pipeline.quality(spark, docs, folder))
    assert text_rows(first) == Counter({k: n for k, n in text_rows(docs).items() if good(k[1])}) and first.columns == docs.columns
    # near duplicates: all pairs of rows
    rows = [(i, r.doc_id, r.text) for i, r in enumerate(first.collect())]
    sets = {i: brute_set(t) for i, _, t in rows}
    up = roots(sets, [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    least = {}
    for i, d, _ in rows:
        if d is not None:
            least[up[i]] = min(d, least.get(up[i], d))
    stay = {d for i, d, _ in rows if d is not None and (not sets[i] or least[up[i]] == d)}
    want = Counter({(d, t): 1 for _, d, t in rows if d in stay}) + Counter((d, t) for _, d, t in rows if d is None)
    second = again(corpus_pipeline.near_duplicates(spark, first, folder))
    assert text_rows(second) == want and second.columns == docs.columns
    # personal data: every text masked by hand
    crf = pii.train_field()
    hide = lambda t: None if t is None else pii.mask(t, pii.all_spans(pii.base_spans(t), pii.field_spans([t], crf)[0], t))
    third = again(corpus_pipeline.personal_data(spark, second, folder))
    assert text_rows(third) == Counter(x for (d, t), n in text_rows(second).items() for x in [(d, hide(t))] * n)
    # mix: the words that each source's budget takes, copies of whole texts and one cut text a source
    budget = {r.source_size: [r.target, 0] for r in mixing.mix(third).collect()}
    fourth = again(corpus_pipeline.mix_sources(spark, third, folder))
    sizes = Counter()
    for r in third.collect():
        sizes[r.source] += len(words(r.text))
    taken, cut = Counter(), Counter()
    whole = {(r.doc_id, r.source, r.text) for r in third.collect()}
    for r in fourth.collect():
        taken[r.source] += len(words(r.text))
        cut[r.source] += (r.doc_id, r.source, r.text) not in whole
    for s, n in sizes.items():
        assert taken[s] == int(budget[n][0]) and cut[s] <= 1, s
    # pack: each row's tokens, once, in sequences without gaps
    out = corpus_pipeline.pack(spark, fourth, folder).toPandas()
    tokens = WordTokens()
    want_tokens = Counter()
    for r in fourth.collect():
        want_tokens[r.doc_id] += len(tokens.encode(r.text or "")) // 4 + 1
    got_tokens = out.groupby("doc_id", dropna=False).length.sum()
    assert {None if d != d else int(d): int(n) for d, n in got_tokens.items()} == dict(want_tokens)
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 4096
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


def test_empty_tables(spark, tmp_path):
    awkward(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
