import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty, text
from pyspark.sql import functions as F

from tracelode.llm import license_scan as ls
from tracelode.llm import lm_scoring as lm
from tracelode.llm import mixing as mx
from tracelode.llm import packing as pk
from tracelode.llm import pii
from tracelode.llm import url_filters as uf
from tracelode.llm.tokens import WordTokens, tokenizer_path


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[n] for n in open_)
        over = [n for n in open_ if left * w[n] / total > most * sizes[n]]
        if not over:
            out.update({n: left * w[n] / total for n in open_})
            break
        for n in over:
            out[n] = most * sizes[n]
            open_.discard(n)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_mix_targets_and_budgets(spark):
    df = awkward(spark)
    got = mx.mix(df).join(df.select("doc_id", "source", "text").withColumn("k", F.monotonically_increasing_id()), "doc_id").dropDuplicates(["k"]).toPandas()
    plain = df.select("source", "text").toPandas()
    sizes = {}
    for s, t in zip(plain.source, plain.text, strict=True):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    for r in got.itertuples():
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    full = mx.mix(df).toPandas()
    assert len(full) == df.count()
    for target, part in full.groupby("target"):
        assert abs(part.taken.sum() - int(target)) <= 1 or len(set(part.source_size)) > 1
    assert full.equals(mx.mix(df).toPandas()) or full.sort_values(["doc_id", "size"]).taken.tolist() == mx.mix(df).toPandas().sort_values(["doc_id", "size"]).taken.tolist()
    assert mx.mix(empty(df)).count() == 0


def test_buckets_equal_one_window(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, text(rng, rng.randrange(1, 30)), rng.choice(("a", "b"))) for i in range(300)], "doc_id long, text string, source string")
    one = mx.mix(df).toPandas().sort_values("doc_id").taken.tolist()
    monkeypatch.setattr(mx, "BUCKET_ROWS", 7)
    assert mx.mix(df).toPandas().sort_values("doc_id").taken.tolist() == one


def test_equal_rows_share_the_exact_budget(spark, monkeypatch):
    """Rows alike in source, id and size take what the budget says, in the plan and in the corpus."""
    monkeypatch.setattr(mx, "RUN_ROWS", 7)
    rows = [(None, f"a b c d e f {'g' * (1 + i % 3)} h i j", "s0") for i in range(40)] + [(5, "x y z", "s0"), (5, "x y z", "s1"), (6, "p q", "s1"), (None, None, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mix(df, weights=(1.0, 9.0), share=0.97).toPandas()
    assert len(got) == len(rows)
    want = {}
    for r in got.itertuples():
        want[r.source_size] = want.get(r.source_size, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    for total, target in {(r.source_size, r.target) for r in got.itertuples()}:
        assert want[total] == int(target)
    out = Counter()
    for r in mx.apply_mix(df, weights=(1.0, 9.0), share=0.97).collect():
        out[r.source] += len(words(r.text))
    assert dict(out) == {"s0": want[403], "s1": want[5]}
    assert 0 < out["s0"] < 403 and out["s0"] % 10


def test_apply_mix_takes_exactly(spark):
    df = awkward(spark).dropDuplicates(["doc_id"])
    out = mx.apply_mix(df)
    assert out.columns == df.columns
    taken = {r.doc_id: r.taken for r in mx.mix(df).collect() if r.taken}
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == taken


# Licenses


def brute_license(t, named=False):
    """The best (score, license) of all lines, paragraphs, SPDX identifiers and, of a license file, the whole text: no gate."""
    from math import log, sqrt

    term = lambda s: re.findall(r"[^\W_]+(?:[.+][^\W_]+)*", s.lower())
    best = (0.0, None)
    t = t or ""
    parts = {"header": {*t.split("\n"), *re.split(r"\n[ \t\r]*\n", t)}, "file": {t} if named else set(), "spdx": set(re.findall(r"SPDX-License-Identifier:[ \t]*([^\n]*)", t))}
    for kind, own in parts.items():
        templates = [x for x in ls.TEMPLATES if x[0] == kind]
        docs = [Counter(term(x[3])) for x in templates]
        df = Counter(w for d in docs for w in d)
        weight = lambda c, w: (1 + log(c)) * (log((len(docs) + 1) / ((df[w] if w in df else 1) + 1)) + 1)  # noqa: B023, E731
        for part in own:
            if kind == "header" and len(part) > ls.HEADER_CHARS:
                continue
            v = Counter(term(part))
            n = sqrt(sum(weight(c, w) ** 2 for w, c in v.items()))
            for (_, name, _, _), d in zip(templates, docs, strict=True):
                m = sqrt(sum(weight(c, w) ** 2 for w, c in d.items()))
                s = sum(weight(c, w) * weight(d[w], w) for w, c in v.items() if w in d) / (n * m) if n else 0
                if round(s, 9) >= ls.THRESHOLD and (round(s, 9), name) > (best[0], best[1] or ""):
                    best = (round(s, 9), name)
    return best


WRAPPED = """# Copyright 2020 The Authors
#
# Licensed under the Apache License,
# Version 2.0 (the "License")

import this"""


def test_license_scan(spark):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "no license is named in this long line of words about other things altogether", "prose", "mit", "A work of general use, version 3, is subject to terms", "// SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    rows = [(i, f"some text\n{x}\n" + "more words here to be read by all who can " * 3, f"r/a/{i}.txt") for i, x in enumerate(lines)]
    rows += [(100, lines[0], "r/LICENSE"), (101, "plain", "r/a/b/c.txt"), (102, "plain", "q/x.txt"), (103, lines[2], "r/z/COPYING.md"), (104, "plain", "r/z/y/w.txt"), (105, None, "r/n.txt"), (106, "plain", None), (107, "", "top.txt"), (108, lines[3], "s/only.txt"), (109, "plain", "s/t/u.txt")]
    mit, bsd = (next(t[3] for t in ls.TEMPLATES if t[:2] == ("file", name)) for name in ("MIT", "BSD-3-Clause"))
    rows += [(110, mit.replace("(c)", "(c) 2019 Some One"), "m/LICENSE"), (111, "code", "m/src/a/b.c"), (112, bsd.replace(". ", ".\n"), "n/COPYING"), (113, "code", "n/x.c"), (114, WRAPPED, "v/a.py"), (115, "prose " * 9000 + lines[0], "w/long.txt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    out = ls.scan_licenses(df)
    got = {r.doc_id: r for r in out.collect()}
    for i, t, path in rows:
        s, name = brute_license(t, bool(re.match(ls.LICENSE_FILE, (path or "").rsplit("/", 1)[-1])))
        assert got[i].header_license == name and got[i].score == pytest.approx(s), i
    assert [got[i].header_license for i in (6, 7, 8, 9, 10, 110, 112, 114)] == [None, None, "Apache-2.0", "GPL-3.0", None, "MIT", "BSD-3-Clause", "Apache-2.0"]
    assert (got[101].license, got[101].inherited_from) == ("MIT", "r") and (got[104].license, got[104].inherited_from) == ("GPL-3.0", "r/z")
    assert got[102].license is None and got[106].license is None and got[105].license == "MIT" and got[109].license == "CC-BY-NC-4.0"
    assert (got[111].license, got[113].license) == ("MIT", "BSD-3-Clause")
    assert "Python" not in out._jdf.queryExecution().toString()
    aw = awkward(spark)
    assert ls.scan_licenses(aw.withColumn("path", ls.document_path(aw))).count() == aw.count()
    assert ls.scan_licenses(empty(df)).count() == 0


def test_long_notices_are_held_against_templates(spark, monkeypatch):
    """Notices of any length count, by line and by paragraph; what other words outweigh does not."""
    monkeypatch.setattr(ls, "HEADER_CHARS", 10**9)  # what the brute force leaves out: nothing
    notice = "Released under the MIT License"
    words = " ".join(f"word{i}" for i in range(900))
    texts = [" ".join([notice] * 100), "\n".join(["Licensed under CC BY 4.0"] * 120), f"{notice} {words}", notice + " " * 3000 + "today", (f"{notice}. " * 90) + words[:60], ("the work is licensed under the terms of the public license " * 50) + words]
    want = [brute_license(t) for t in texts]
    monkeypatch.setattr(ls, "HEADER_CHARS", 200)
    df = spark.createDataFrame([(i, t, f"a/{i}") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    got = {r.doc_id: r for r in ls.scan_licenses(df).collect()}
    assert [got[i].header_license for i in range(len(texts))] == [name for _, name in want]
    assert [got[i].score for i in range(len(texts))] == pytest.approx([score for score, _ in want])
    assert [got[i].header_license for i in (0, 1, 2, 3)] == ["MIT", "CC-BY-4.0", None, "MIT"]


def test_license_does_not_depend_on_the_id(spark):
    text_ = "Released under the MIT License"
    df = spark.createDataFrame([(1, text_, "a/x"), (None, text_, "a/y"), (1, "prose", "b/z"), (None, None, "c/q")], "doc_id long, text string, path string")
    assert sorted((r.path, r.header_license or "") for r in ls.scan_licenses(df).collect()) == [("a/x", "MIT"), ("a/y", "MIT"), ("b/z", ""), ("c/q", "")]


# URLs


def brute_url(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, a) for a, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, act = max(fit)
        return host, path, rule, act
    return host, path, None, "block" if host in listed else "allow"


@pytest.mark.parametrize(("shard_keys", "most"), [(1 << 18, 16 << 20), (60, 16 << 20), (60, 8)])
def test_urls(spark, shard_keys, most):
    rng = random.Random(5)
    hosts = [f"{rng.choice(('www', 'm', 'spam-x', 'ads'))}.h{i}.example.{rng.choice(('com', 'org', 'net'))}" for i in range(400)]
    urls = [f"http://{h}{rng.choice(('', '/', '/es/1', '/en/1', '/en/12', '/en/2', '/fr/', '/de/x'))}{rng.choice(('', '?a=/b://c', '#x'))}" for h in hosts]
    urls += [None, "", "no-scheme/x", "://", "HTTPS://WWW.Example.NET/Path", "http://org/", "http://org", "http://xorg/", "x\n://a.net/\n/y"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash"), (None, "http://a.b/", "c")], "page_id long, url string, host string")
    listed = uf.listed_hosts(df)
    names = {r.host for r in listed.collect()}
    got = uf.judge_urls(df, listed, shard_keys=shard_keys, max_broadcast=most).collect()
    assert len(got) == len(urls) + 2 and names
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id], names)
    assert uf.judge_urls(df.limit(0), listed).count() == 0
    assert {r.verdict for r in uf.judge_urls(df, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_cascade_is_exact():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 1 << 63, (2, 6000), dtype=np.uint64)
    listed = np.arange(6000) % 7 == 0
    cascade = uf.cascade_of(h1, h2, listed, bits_per_key=2.0)
    assert len(cascade.levels) > 2 and (cascade.listed(h1, h2) == listed).all()
    assert uf.cascade_of(h1, h2, listed & False).levels == () and uf.cascade_of(h1, h2, listed | True).listed(h1, h2).all()
    with pytest.raises(ValueError, match="share both"):
        uf.cascade_of(np.repeat(h1[:1], 2), np.repeat(h2[:1], 2), np.array([True, False]))


# Personal data


def regex_base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii._luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    bits = ["a.b", "@", "x-y", ".", "com", "192", "168", "0", "300", "+", "1", " ", "(", ")", "-", "555", "4111", "1111", "4111 1111 1111 1111", "é", "\n", "a@b.c", "+1 (555) 555-0100", "10.0.0.1", "00000000000000000000.1.1.1", "٣"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert sorted(pii.base_spans(t)) == sorted(regex_base(t)), repr(t)
    long = "a" * 200_000 + "@" * 3 + "1" * 100_000
    assert pii.base_spans(long) == []


def test_field_learns_and_viterbi_is_exact():
    crf = pii.train_field()
    held = pii.labelled_table(150, seed=77)
    right = sum([pii.TAGS[i] for i in crf.tags(["", "", *w, "", ""])[2:-2]] == t for w, t in held)
    assert right >= 0.93 * len(held)
    for w, _ in held[:60]:  # plain Viterbi over the whole chain
        seq = ["", "", *w, "", ""]
        e = crf.emissions(crf.numbers(seq))[2:-2]
        s, back = e[0] + crf.trans[0], []
        for x in e[1:]:
            p = s[:, None] + crf.trans
            back.append(p.argmax(0))
            s = p.max(0) + x
        best = [int((s + crf.trans[:, 0]).argmax())]
        for b in reversed(back):
            best.append(int(b[best[-1]]))
        assert crf.tags(seq)[2:-2].tolist() == best[::-1]


def test_pii_rows(spark):
    df = awkward(spark).unionByName(spark.createDataFrame([(90, "mail bo.12@mail3.example.com or +1 (555) 555-0100, card 4111 1111 1111 1111 at 10.0.0.1. token = \"0cab398dc11d1a2a11dc6572c8df8bd228c864f3\"", "s", "en", 3, "c", "c", 1)], awkward(spark).schema))
    got = pii.find_pii(df).toPandas()
    assert len(got) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.where("doc_id is not null").collect()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        base = regex_base(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0]))))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    r = got[got.doc_id == 90].iloc[0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and "secret:" in r.spans
    out = pii.mask_pii(df)
    assert out.columns == df.columns
    masked = out.where("doc_id = 90").first()
    assert not regex_base(masked.text) and "<EMAIL>" in masked.text and masked.n_chars == len(masked.text)
    assert pii.find_pii(empty(df)).count() == 0 and out.where("text is null").count() == df.where("text is null").count()


# Tokens and packing


def test_word_tokens_equal_tokenizer():
    w = WordTokens()
    rng = random.Random(3)
    texts = ["it's don't", "ÀÉÎ Œuvre ﬁn İstanbul ǅ", "naïve éa x́", "<|endoftext|> a<|startoftext|>b", "日本語 テスト 123 4a5", "ÿŸ ß ẞ µm ªb ²", "a\x1cb a\x85b", "", "  ", "a\u2003b\u200bc \xa0d", "hello,world...!! ¨ ´", "x.'s A'LL"]
    texts += ["".join(rng.choice("abcÉé.,!'$ 1\n\tß") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(w.encode(t), "<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_and_bound():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets, used = pk.best_fit_decreasing(lengths, 100)
        fill = np.bincount(bins, lengths, used)
        assert fill.max() <= 100 and used == len(set(bins))
        for b in range(used):
            at = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][at] == np.concatenate([[0], np.cumsum(lengths[bins == b][at])[:-1]])).all()
        bound = pk.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert -(-lengths.sum() // 100) <= bound <= used
    assert pk.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert pk.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


@pytest.mark.parametrize("pieces", [40_000, 20])
def test_packing_round_trip(spark, pieces):
    from tokenizers import Tokenizer

    df = awkward(spark)
    got = pk.pack_documents(df, partition_pieces=pieces).toPandas()
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in df.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[(r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 4096 and (seq.offset == seq.length.cumsum() - seq.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + max(1, len(got) // pieces)
    assert pk.pack_documents(empty(df)).count() == 0


# Language model


def test_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 30)
    monkeypatch.setattr(lm, "STEPS", 10)
    df = awkward(spark)
    got = lm.score_texts(df).toPandas()
    assert len(got) == df.count()
    rows = df.select("doc_id", "text").collect()
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r.doc_id):
            c.update(low(r.text))
            c["\0end"] += 1
    n, v = sum(c.values()), len(c)
    want = {}
    for r in rows:
        t = [*low(r.text), "\0end"]
        want[r.doc_id] = (held(r.doc_id), len(t), sum(c[w] > 0 for w in t), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
    for r in got.dropna(subset=["doc_id"]).itertuples():
        h, k, known, base = want[int(r.doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, k, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and np.isfinite(r.score) and r.score < 0
    assert lm.score_texts(empty(df)).count() == 0


def tiny():
    rng = np.random.default_rng(1)
    uni = np.zeros(lm.IDS)
    uni[:2000] = rng.integers(1, 500, 2000)
    pairs = rng.integers(0, 5, (lm.SIZE, lm.SIZE)).astype(float)
    v, shares = lm.build_vocabulary(uni, pairs)
    return v, lm.Network(shares)


def test_model_is_normalized_and_causal():
    v, net = tiny()
    mass = np.zeros(lm.SIZE)
    np.add.at(mass, v.number, 10 ** v.rest.astype(float))
    assert np.allclose(mass[:-1], 1, atol=1e-3)  # every number's ids share it out
    for row in (0, 5, lm.EDGE):
        share = np.bincount(v.class_of[: lm.EDGE], 10 ** v.within[row, : lm.EDGE].astype(float), lm.CLASSES)
        assert np.allclose(share, 1, atol=1e-3)
    s = lm.Scorer(v, net)
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 3000, 400)
    whole = s.score(ids, np.array([400]))
    assert s.score(np.concatenate([ids, ids[:37]]), np.array([400, 37]))[0] == pytest.approx(whole[0], abs=1e-3)
    # windows in other batches score the same; a later token changes nothing before it
    assert s.score(ids, np.array([400]), step=3)[0] == pytest.approx(whole[0], abs=1e-3)
    prefix = s.score(ids[:200], np.array([200]))[0]
    other = ids.copy()
    other[200:] = 7
    numbers, previous, place, before, first = s.prepare(other, np.array([400]))
    target = np.zeros(before.size, np.int64)
    target[place] = v.class_of[numbers]
    each = net.log10_classes(before, first, target.reshape(before.shape))[place] + v.within[previous, numbers] + v.rest[other]
    assert each[:200].sum() == pytest.approx(prefix, abs=1e-3)


def test_scores_equal_a_plain_model_token_by_token():
    """Each token scored on its own: softmax attention over the subwords before it in its block and the block before."""
    v, net = tiny()
    net.p["scale"][0], net.p["bias"][:] = 0.9, np.linspace(-1, 1, lm.CLASSES)
    p = {k: w.astype(float) for k, w in net.p.items()}
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 3000, n) for n in (1, 16, 17, 75)]

    def plain(ids):
        numbers, total = v.number[ids].astype(int), 0.0
        before = [lm.EDGE, *numbers[:-1]]
        for t, (i, n) in enumerate(zip(ids, numbers, strict=True)):
            row = t % lm.STRIDE
            seen = range(max(0, t - row - lm.STRIDE), t + 1)
            x = {j: p["embed"][before[j]] for j in seen}
            score = np.array([x[t] @ p["q"] @ (x[j] @ p["k"]) * lm.WIDTH**-0.5 + p["place"][row, lm.STRIDE + j - (t - row)] for j in seen])
            share = np.exp(score - score.max())
            h = sum(a * (x[j] @ p["v"]) for a, j in zip(share / share.sum(), seen, strict=True)) @ p["o"] + x[t]
            z = h @ p["out"] + p["scale"] * p["table"][before[t]] + p["bias"]
            c = v.class_of[n]
            total += (z[c] - np.log(np.exp(z).sum())) / np.log(10) + v.within[before[t], n] + v.rest[i]
        return total

    got = lm.Scorer(v, net).score(np.concatenate(texts), np.array([len(t) for t in texts]), step=2)
    assert got == pytest.approx([plain(t) for t in texts], abs=1e-3)


def test_gradients_and_training():
    v, net = tiny()
    rng = np.random.default_rng(2)
    before, target = rng.integers(0, lm.SIZE, (6, lm.STRIDE)), rng.integers(0, lm.CLASSES, 6 * lm.STRIDE)
    first, use = np.array([1, 0, 0, 1, 0, 0], bool), np.ones(6 * lm.STRIDE, bool)
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    net.p["scale"][0], net.p["bias"][3] = 0.8, 0.4
    g = net._gradients(before, first, target, use)

    def loss():
        z = net.forward(before, first)["z"]
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target]).mean())

    for k in ("q", "k", "v", "o", "out", "place", "bias", "scale", "embed", "table"):
        w = net.p[k]
        at = tuple(int(rng.integers(n)) for n in w.shape) if k not in ("embed", "table") else (int(before[1, 3]), 2)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert g[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-4), k
    v, net = tiny()
    target = rng.integers(0, 3, (40, lm.STRIDE))
    before = rng.integers(0, 50, (40, lm.STRIDE))
    begin = np.zeros(40, bool)
    old = net.log10_classes(before, begin, target).mean()
    net.train(before, begin, target, np.ones((40, lm.STRIDE), bool), steps=60, batch=16)
    assert net.log10_classes(before, begin, target).mean() > old + 0.2
