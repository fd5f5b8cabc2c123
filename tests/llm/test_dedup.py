import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import WORDS, awkward, empty, text
from pyspark.sql import functions as F

from tracelode.llm import embedding_dedup as ed
from tracelode.llm import near_dedup as nd
from tracelode.llm.graph import connected_components


def brute_set(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(sets, links)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df).toPandas()
    sizes, comp = brute(rows)
    assert {r.doc_id: r.n_shingles for r in got.itertuples()} == sizes
    assert {r.doc_id: r.component_id for r in got.itertuples()} == comp
    assert (got.kept == (got.doc_id == got.component_id)).all()


def mutated(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for _ in range(14):
        base = text(rng, rng.choice((6, 30, 120, 300))).split()
        for _ in range(rng.randrange(1, 8)):
            rows.append((i, mutated(rng, base, rng.choice((0, 0, 1, 1, 2, 4, 8)))))
            i += 1
    check(spark, rows)


def test_family_and_shared_passage(spark):
    rng = random.Random(8)
    base, passage = text(rng, 150).split(), text(rng, 60)
    rows = [(i, mutated(rng, base, 1 + i % 6)) for i in range(60)]
    rows += [(100 + i, f"{text(rng, 40)} {passage} {text(rng, 40)}") for i in range(40)]
    check(spark, rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(10)
    base = text(rng, 200).split()
    check(spark, [(i, mutated(rng, base, 2 + i % 9)) for i in range(50)])


def test_index_finds_all_within_errors():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (300, nd.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(nd.POSITIONS, nd.MOST_ERRORS, replace=False)
        row[at] ^= 1
    assert (nd.index_keys(a) == nd.index_keys(b)).any(axis=1).all()


def test_shingle_hashes_are_exact():
    rng = random.Random(3)
    for t in [text(rng, n) for n in (1, 4, 5, 50, 700)] + ["", "  ", "a\tb\nc\x0bd e f É é", "X " * 40]:
        assert len(nd.shingle_set(t.encode())) == len(brute_set(t))


def test_near_duplicates_awkward(spark):
    df = awkward(spark)
    got = nd.near_duplicates(df).toPandas()
    assert len(got) == df.count()
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.component_id[20] == 0 and by.component_id[21] == 1 and by.component_id[22] == 2 and by.component_id[30] == 30 and by.n_shingles[32] == 0
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns and out.where("doc_id = 50").count() == 0 and out.where("doc_id is null").count() == 2
    assert nd.near_duplicates(empty(df)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.root for r in connected_components(df).collect()} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(df.limit(0)).count() == 0


def brute_vectors(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a, b in combinations(ok, 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= threshold]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, roots(list(n), links)


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(160):
        c = centres[rng.integers(12)]
        v = c + rng.normal(size=24) * rng.choice([0.0, 0.2, 0.3, 0.35])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(2))))
    rows += [(200, None, 0), (201, [0.0] * 24, 0), (202, [float("nan")] + [1.0] * 23, 0), (203, rows[0][1], None), (204, [None] + [1.0] * 23, 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [], 1), (208, [float("inf")] * 24, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = ed.near_duplicate_vectors(df, block=block).toPandas()
    n, comp = brute_vectors(rows)
    assert {r.vec_id: r.n_links for r in got.itertuples()} == n
    assert {r.vec_id: r.component_id for r in got.itertuples()} == comp
    assert ed.near_duplicate_vectors(df.limit(0)).count() == 0


def test_repeated_rows_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [r.n_links for r in ed.near_duplicate_vectors(df).collect()] == [2, 2, 2]


def test_texts_without_ids_link(spark):
    """A chain of near copies whose middle has no id is one component."""
    rng = random.Random(3)
    a = text(rng, 100).split()
    b = [*a[:88], *text(rng, 12).split()]
    c = [*b[12:], *text(rng, 12).split()]
    sets = [brute_set(" ".join(x)) for x in (a, b, c)]
    like = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert like(sets[0], sets[1]) and like(sets[1], sets[2]) and not like(sets[0], sets[2])
    df = spark.createDataFrame([(7, " ".join(a)), (None, " ".join(b)), (9, " ".join(c))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(df).collect()} == {7: 7, None: 7, 9: 7}


def test_tile_rows_stay_below_members(spark, monkeypatch):
    """A family of near copies gives fewer likely pairs a tile than members, whatever its square."""
    rng = random.Random(5)
    base = text(rng, 200).split()
    rows = [(i, mutated(rng, base, 3)) for i in range(300)]
    sig = np.stack([nd.signature(nd.shingle_set(t.encode())) for _, t in rows])
    key = nd.index_keys(sig)
    best, count = np.unique(key[:, 0], return_counts=True)
    k = int(best[count.argmax()])
    at = np.flatnonzero((key == k).any(axis=1))
    zeros = [0] * len(at)
    held = [[k] * len(at), zeros, zeros, at.tolist(), at.tolist(), zeros, [sig[i].tobytes() for i in at]]
    comp, x, y = nd._candidates(held)
    first = (key[at][:, None] == key[at][None]).argmax(axis=2)
    within = (sig[at][:, None] != sig[at][None]).sum(axis=2) <= nd.MOST_ERRORS
    a, b = np.nonzero(within & (first == (k & 63)))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j}
    errors = (sig[at][x] != sig[at][y]).sum(axis=1)
    assert (np.diff(errors) >= 0).all() and len(x) > 3 * len(at)
    forest = nd._forest(comp, x, y)
    assert len(forest) < len(at)
    # the forest joins what all pairs join
    assert (nd.smallest_roots(len(at), x, y) == nd.smallest_roots(len(at), x[forest], y[forest])).all()


def test_a_large_bucket_is_not_copied(spark):
    """5,000 members of one key, with long texts: signatures are dealt out by their own bytes, one row each."""
    members = spark.range(5000).select(F.lit(1).alias("key"), F.col("id").alias("node"), F.lit(100_000).alias("bytes"), F.col("id").alias("comp"), F.lit(bytes(128)).alias("sig"))
    assert nd._tiles(members, "128").count() == 5000


def test_parts_of_a_tile_give_the_whole_forest(spark, monkeypatch):
    """Held a few pairs at a time, a tile's forest and the links left are those of all pairs."""
    rng = random.Random(5)
    base = text(rng, 200).split()
    sig = [nd.signature(nd.shingle_set(mutated(rng, base, 3).encode())) for _ in range(300)]
    key = nd.index_keys(np.stack(sig))
    best, count = np.unique(key[:, 0], return_counts=True)
    k = int(best[count.argmax()])
    at = np.flatnonzero((key == k).any(axis=1)).tolist()
    zeros = [0] * len(at)
    held = [[k] * len(at), zeros, zeros, at, at, zeros, [sig[i].tobytes() for i in at]]
    comp, x, y = nd._candidates(held)
    forest = np.sort(nd._forest(comp, x, y))
    monkeypatch.setattr(nd, "HELD_PAIRS", 20)
    assert len(list(nd._pairs_of(held)[1])) > 1
    got = nd._tile_forest(held)
    assert [g.tolist() for g in got] == [x[forest].tolist(), y[forest].tolist()]
    check(spark, [(i, mutated(rng, base, 2 + i % 9)) for i in range(50)])
