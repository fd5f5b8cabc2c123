import json
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelode import schema as S
from tracelode.functions import text as X
from tracelode.operators import attrib, evaluate, graph, group, ledger, match, normalize, ranges, retrieve, search, traces, views
from tracelode.plans.sqlgate import Refused, query_tables
from tracelode.sources import otlp, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sclc(spark):
    text = r"curl https://a.b/c?d 10.0.0.1:443 to C:\Users\x y\z.exe and /etc/passwd HKEY_LOCAL_MACHINE\Soft\Run 0123456789abcdef0123456789abcdef"
    out = one(spark, X.normalize_sclc(F.lit(text)))
    for mark in ("<URL>", "<IP>", "<FILE_PATH>", "<HASH>"):
        assert mark in out
    assert "10.0.0.1" not in out and "passwd" not in out


def test_flux_tags(spark):
    attrs = F.create_map(F.lit("gen_ai.system"), F.lit("x"), F.lit("status"), F.lit("ERROR"), F.lit("port"), F.lit("0"))
    tags = one(spark, X.flux_tags(F.lit("exec"), F.lit("whoami"), attrs))
    assert tags & S.ERROR and tags & S.ATTACK and tags & S.AI and not tags & S.NETWORK


def test_entropy_and_compression(spark):
    data = ["ab" * 20, "x" * 40, "", "short"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d string")
    got = {r.i: r for r in df.select("i", X.ascii_entropy(F.col("d")).alias("h"), X.compression_deviation("d").alias("c")).collect()}
    assert got[0].h == pytest.approx(1.0) and got[1].h == pytest.approx(0.0) and got[2].h == 0
    assert got[0].c.ratio == pytest.approx(len(zlib.compress(data[0].encode(), 1)) / 40) and got[3].c.ratio == 1.0


def test_normalize_and_reject(spark):
    good = {"ts": "2024-01-01T00:00:00Z", "host": "h", "action": "exec", "raw": "ls /etc/x", "session_id": "s", "attributes": {"a": 1}}
    bad = [{"ts": "2024-01-01T00:00:00", "host": "h", "action": "x"}, {"ts": 5, "host": " ", "action": "x"}, {"ts": 5, "host": "h", "action": "x", "source_seq": -1}]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([good, {"ts": 12.5, "host": "h", "action": "y"}, *bad])], "position long, value string")
    events, rejected = normalize.normalize(readers.parse_lines(lines, "src"), "2024-01-01T00:00:00Z")
    rows = {r.action: r for r in events.collect()}
    assert set(rows) == {"exec", "y"} and rows["y"].ts.startswith("1970-01-01T00:00:12.5")
    assert json.loads(rows["exec"].attributes) == {"a": "1", "session_id": "s"}
    assert sorted(r.problems for r in rejected.collect()) == ["host", "source_seq", "ts"]
    assert len({r.event_hash for r in rows.values()}) == 2
    a = normalize.adapt(events.where("action = 'exec'")).first()
    assert a.anchor == "session:h:s" and "/etc/x" in a.tokens


def test_readers(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"timestamp": 1, "hostname": "a", "src": "s", "dst": "d", "event_type": "read", "host": "b"}\n\n{"ts": 2, "host": "c", "action": "w"}\n')
    got = [r.record for r in readers.read_edges(spark, str(tmp_path / "e.jsonl")).orderBy("position").collect()]
    assert got[0] == {"ts": "1", "host": "b", "subject": "s", "object": "d", "action": "read"} and got[1]["action"] == "w"
    seq = spark.createDataFrame([(0, "a", None), (1, "a", 10), (2, "a", None), (3, "b", None)], "position long, source_id string, explicit_seq long")
    assert [r.source_seq for r in readers.stamp_sequence(seq).orderBy("position").collect()] == [0, 10, 11, 0]
    sessions = spark.createDataFrame([(json.dumps([{"session_id": "s", "actor": "x", "ts": "1", "commands": ["ls", {"ts": "5", "command": "id"}]}]),)], "value string")
    assert [(r.ts, r.raw) for r in readers.expand_sessions(sessions).orderBy("position").collect()] == [("1", "ls"), ("5", "id")]
    bodies = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"a":3}\n{"a":4}',), ('{"a":5}',)], "body string")
    assert sorted(r.record["a"] for r in readers.parse_body(bodies).collect()) == ["1", "2", "3", "4", "5"]


def test_otlp(spark):
    attr = lambda k, v: {"key": k, "value": v}
    span = {"traceId": "0af7651916cd43dd8448eb211c80319c", "spanId": "AAECAwQFBgc=", "name": "chat", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000060000000", "attributes": [attr("gen_ai.request.model", {"stringValue": "m"}), attr("gen_ai.usage.input_tokens", {"intValue": "210"}), attr("gen_ai.usage.output_tokens", {"intValue": 45}), attr("x", {"stringValue": "1"}), attr("x", {"stringValue": "2"})], "status": {"code": 2}}
    body = {"resourceSpans": [{"resource": {"attributes": [attr("service.name", {"stringValue": "svc"}), attr("host.name", {"stringValue": "hh"})]}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [span]}]}]}
    r = otlp.parse_traces(spark.createDataFrame([(json.dumps(body),)], "body string")).first()
    assert (r.host, r.source_id, r.status, r.duration_ms, r.span_id) == ("hh", "svc", "error", 60.0, "0001020304050607")
    assert r.ai.total_tokens == 255 and r.attributes["x"] == "2" and r.parent_span_id is None
    log = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"observedTimeUnixNano": "1700000000000000000", "severityText": "WARN", "body": {"stringValue": "hi"}, "traceId": span["traceId"], "spanId": span["spanId"]}]}]}]}
    g = otlp.parse_logs(spark.createDataFrame([(json.dumps(log),)], "body string")).first()
    assert (g.action, g.raw, g.span_id, g.host) == ("log.warn", "[WARN] hi", r.span_id, "localhost")


def test_search_trigram_short_and_bm25(spark):
    docs = spark.createDataFrame([(0, "Alpha beta"), (1, "gamma ALPHA"), (2, "beta beta")], "id int, raw string")
    post = search.trigram_index(docs, "id", "raw")
    assert sorted(r.id for r in search.trigram_search(docs, post, "alpha", "id", "raw").collect()) == [0, 1]
    assert sorted(r.id for r in search.trigram_search(docs, post, "be", "id", "raw").collect()) == [0, 2]
    assert [r.id for r in search.bm25(*search.bm25_index(docs, "id", "raw"), "beta").collect()] == [2, 0]
    with pytest.raises(ValueError):
        search.search(docs, "", limit=1)


def fold_sessions(times, idle, most):
    out, start, last, idx = [], None, None, 0
    for t in times:
        if start is not None and (t - last > idle or t - start > most):
            start, idx = None, idx + 1
        start = t if start is None else start
        last = t
        out.append(idx)
    return out


def test_sessionize_equals_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(6):
        t, times = 0, []
        for _ in range(80):
            t += rng.choice((1, 5, 30, 61, 60))
            times.append(t)
        for i, (t, s) in enumerate(zip(times, fold_sessions(times, 60, 200), strict=True)):
            rows.append((k, i, t * 1_000_000))
            want[k, i] = s
    df = spark.createDataFrame(rows, "k int, i int, us long")
    got = {(r.k, r.i): r.session for r in traces.sessionize(df, "k", "us", "i", 60, 200).collect()}
    assert got == want


def test_features_merge_like_one(spark):
    rows = [("t", float(i), "read" if i % 2 else "inject", "proc" if i % 3 else "file", [f"w{i}", "x"], ["T1"] if i % 2 else [], [f"e{i % 2}"]) for i in range(10)]
    df = spark.createDataFrame(rows, "trace_id string, ts_epoch double, action string, object string, tokens array<string>, techniques array<string>, entities array<string>")
    whole = traces.trace_features(df).first().asDict()
    parts = traces.trace_features(df.where("ts_epoch < 4")).unionByName(traces.trace_features(df.where("ts_epoch >= 4")))
    merged = traces.merge_features(parts).first().asDict()
    for k, v in whole.items():
        assert merged[k] == (pytest.approx(v) if k == "anomaly_sum" else v), k


def test_probe_is_hamming_one(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abc") for _ in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, sketch array<string>")
    got = {(r.a, r.b) for r in retrieve.probe_pairs(df, "id", 2, 4).collect()}
    near = lambda x, y: any(sum(p != q for p, q in zip(x[k : k + 4], y[k : k + 4], strict=True)) <= 1 for k in (0, 4))
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and near(x, y)}
    assert retrieve.bands_for_threshold(128, 0.5) == (32, 4)


def test_budget_round_takes_head(spark):
    jobs = spark.createDataFrame([(0, 0.9, 50), (1, 0.8, 5), (2, 0.7, 1)], "seq long, estimate double, cost long")
    assert [r.seq for r in match.budget_round(jobs, 10).collect()] == [0]
    assert sorted(r.seq for r in match.budget_round(jobs, 55).collect()) == [0, 1]


def test_pair_model(spark):
    rng = random.Random(1)
    rows = [tuple([y * 0.6 + rng.random() * 0.4 for _ in match.FEATURES] + [y]) for y in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, [*match.FEATURES, "label"])
    lr, _, score = match.fit_pair_model(df)
    got = score(df).select("p", "label").collect()
    assert sum((r.p >= 0.5) == bool(r.label) for r in got) >= 58
    with pytest.raises(ValueError):
        match.fit_pair_model(df.where("label = 1"))


def test_groups(spark):
    links = spark.createDataFrame([("t1", "t2", 0.88, 2, 0), ("t2", "t3", 0.85, 2, 1), ("t8", "t9", 0.9, 1, 2)], "a string, b string, p double, n_classes int, seq long")
    got = {(r.group_id, r.trace_id): r for r in group.fold_groups(links).collect()}
    assert ("t1+t2", "t1") in got and ("t1+t2", "t3") in got and not any("t8" in k for k, _ in got)
    m = spark.createDataFrame([("a", "g1", 0.9, "supported"), ("a", "g2", 0.8, "supported"), ("b", "g2", 0.6, "proposed")], "trace_id string, group_id string, strength double, state string")
    assert [(r.group_a, r.group_b, r.shared) for r in group.merge_proposals(m).collect()] == [("g1", "g2", 1)]
    d = spark.createDataFrame([("b", "g2", "rejected")], "trace_id string, group_id string, state string")
    assert {(r.trace_id, r.group_id): r.state for r in group.decide(m, d).collect()}["b", "g2"] == "rejected"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0, 0.1, "r"), ("b", "c", 2.0, 0.9, "w"), ("c", "a", 3.0, 0.1, "r"), ("c", "d", 900.0, 0.2, "x"), ("z", "y", 5.0, 0.3, "x")], "src string, dst string, ts double, anomaly double, action string")
    comp = {r.node: r.component for r in graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "y": "y", "z": "y"}
    forest = {(r.src, r.dst) for r in graph.spanning_forest(e).collect()}
    assert forest == {("a", "b"), ("b", "c"), ("c", "d"), ("z", "y")}
    seeds = spark.createDataFrame([("b",)], "node string")
    assert {r.node for r in graph.reachable(e, seeds, 0.0, 10.0).collect()} == {"a", "b", "c"}
    assert {r.node for r in graph.reachable(e, seeds, 0.0, 1000.0, "out", causal=True).collect()} == {"a", "b", "c", "d"}
    kept, roles = graph.reconstruct(e, seeds, 0.0, 1000.0)
    assert {(r.src, r.dst) for r in kept.collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    assert {(r.node, r.role) for r in roles.where("chosen").collect()} == {("a", "entry"), ("d", "exit")}


def test_attribution(spark):
    fx = readers.actor_fixture(spark, actors=3, sessions=12)
    model, probabilities = attrib.fit_text_model(fx.where("train"))
    test = fx.where("not train").withColumn("group_id", F.col("session_id"))
    p = probabilities(test.select("group_id", "tokens"))
    tech = attrib.technique_scores(test, fx.where("train"))
    s = p.join(tech, ["group_id", "actor"], "left").select("group_id", "actor", attrib.fuse(F.col("p"), F.coalesce("tech", F.lit(0.0))).alias("s"))
    out = attrib.outcome(attrib.posterior(s, 3)).join(test.select("group_id", F.col("actor").alias("truth")), "group_id").collect()
    assert sum(r.actor == r.truth for r in out) >= 0.9 * len(out)
    low = attrib.outcome(attrib.posterior(spark.createDataFrame([("g", "x", 0.1), ("g", "y", 0.1)], "group_id string, actor string, s double"), 2)).first()
    assert low.status == "unresolved" and low.actor is None


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1)], "p double, y int")
    assert evaluate.auc(df, "p", "y").first().auc == 1.0
    assert evaluate.auc(df.where("y = 1"), "p", "y").first().auc is None
    assert evaluate.calibration_error(df, "p", "y").first().ece > 0
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "c string, m double")
    assert evaluate.summarize(runs, "c", ["m"]).first().m_mean == 2.0


def test_ledger(spark, tmp_path):
    book = ledger.Ledger()
    for i in range(3):
        book.append("segment", {"i": i}, {"o": i}, {"c": i})
    ok = lambda df: df.where("not (hash_ok and link_ok and seq_ok)").count() == 0
    assert ok(ledger.verify_ledger(book.frame(spark)))
    book.export(spark, str(tmp_path / "l"))
    assert ledger.Ledger.load(spark, str(tmp_path / "l")).head == book.head
    book.records[1]["context"] = "{}"
    assert not ok(ledger.verify_ledger(book.frame(spark)))


def test_waterfall_orphans_and_cycles(spark):
    rows = [("t", "a", None, 0.0, 10.0), ("t", "b", "a", 2.0, 3.0), ("t", "c", "a", 1.0, 3.0), ("t", "d", "b", 3.0, 1.0), ("t", "o", "gone", 5.0, 1.0), ("t", "x", "y", 6.0, 1.0), ("t", "y", "x", 7.0, 1.0)]
    got = views.waterfall(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start_ms double, duration_ms double")).orderBy("position").collect()
    assert [r.span_id for r in got][:5] == ["a", "c", "b", "d", "o"] and {r.span_id for r in got} == set("abcdoxy")
    assert [r.depth for r in got][:5] == [0, 1, 1, 2, 0]


def test_deep_chain_of_spans(spark):
    """A chain of 200 spans keeps its depths, however deep; a cycle and what hangs from it are roots."""
    rows = [("t", f"s{i:03d}", f"s{i - 1:03d}" if i else None, float(i), 1.0) for i in range(200)]
    rows += [("c", "a", "b", 0.0, 1.0), ("c", "b", "a", 1.0, 1.0), ("c", "d", "a", 2.0, 1.0), ("c", "r", None, 3.0, 1.0)]
    got = views.waterfall(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start_ms double, duration_ms double")).collect()
    assert {(r.span_id, r.depth, r.position) for r in got if r.trace_id == "t"} == {(f"s{i:03d}", i, i + 1) for i in range(200)}
    assert {r.span_id: r.depth for r in got if r.trace_id == "c"} == {"a": 0, "b": 0, "d": 0, "r": 0}


def test_long_paths_and_chains(spark):
    n = 150
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}", float(i)) for i in range(n)], "src string, dst string, ts double")
    seeds = spark.createDataFrame([("n0000",)], "node string")
    assert graph.reachable(edges, seeds, 0.0).agg(F.max("depth")).first()[0] == n
    procs = spark.createDataFrame([(i, i - 1, "x") for i in range(1, n)] + [(900, 901, "x"), (901, 900, "x"), (902, 900, "x")], "pid long, parent long, image string")
    got = {r.pid: r.root for r in traces.session_roots(procs, ["service"]).collect()}
    assert all(got[i] == 1 for i in range(1, n)) and (got[900], got[901], got[902]) == (900, 901, 902)


@pytest.mark.parametrize("most", [250_000, 100, 7])
def test_components_of_long_paths(spark, monkeypatch, most):
    """Paths whose names fall and rise, a crowd, a hub, copies, loops and missing ends: few rounds, whether one task holds all edges or none does."""
    tables = []
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", most)
    monkeypatch.setattr(graph, "cut", lambda df, name, cut=graph.cut: tables.append(name) or cut(df, name))
    rng = random.Random(3)
    rows = [(f"t{i}", f"t{i + 1}") for i in range(2000)] + [(f"u{i + 5}", f"u{i}") for i in range(1000)]
    rows += [(f"c{rng.randrange(300)}", f"c{rng.randrange(300)}") for _ in range(200)] + [("hub", f"h{i}") for i in range(300)]
    rows += [("é", "z"), ("z", "\U0001f600"), ("loop", "loop"), ("t5", None), (None, "t7"), (None, None), ("alone", None)] + rows[::50]
    rng.shuffle(rows)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    df = spark.createDataFrame(rows, "a string, b string").repartition(3)
    assert sorted(map(tuple, graph.components(df).collect())) == sorted((x, top(x)) for x in list(up))
    assert len(tables) <= {250_000: 6, 100: 40, 7: 60}[most]
    assert graph.components(df.limit(0)).count() == 0
    numbers = spark.createDataFrame([(i * 7 % 500, (i + 1) * 7 % 500) for i in range(250)], "a long, b int")
    assert {tuple(r) for r in graph.components(numbers).collect()} == {(i * 7 % 500, 0) for i in range(251)}


def test_forest_equals_a_fold(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", float(rng.randrange(30)), rng.choice("ab")) for _ in range(300)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = set()
    for ts, src, dst, action in sorted((r[2], r[0], r[1], r[3]) for r in rows):
        a, b = top(src), top(dst)
        if a != b:
            up[a] = b
            want.add((src, dst, ts, action))
    df = spark.createDataFrame(rows, "src string, dst string, ts double, action string")
    assert sorted(map(tuple, graph.spanning_forest(df).collect())) == sorted(want)
    assert graph.spanning_forest(df.limit(0)).count() == 0


def test_fold_refuses_what_one_task_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(group, "MOST_LINKS", 2)
    links = spark.createDataFrame([("a", "b", 0.9, 2, i) for i in range(3)], "a string, b string, p double, n_classes int, seq long")
    with pytest.raises(Exception, match="too many links"):
        group.fold_groups(links).collect()


def test_a_fold_of_long_chains_takes_few_rounds(spark, monkeypatch):
    """Names of chains by number aren't in order of text: t9 comes after t10."""
    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, name, cut=graph.cut: tables.append(name) or cut(df, name))
    rows = [(f"t{i}", f"t{i + 2}", 0.5 + i * 37 % 50 / 100, i % 3 + 1, i) for i in range(400)]
    links = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "a string, b string, p double, n_classes int, seq long")
    got = sorted(map(tuple, group.fold_groups(links).collect()))
    assert got == sorted(group._fold(pd.DataFrame(rows, columns=links.columns)).itertuples(index=False, name=None))
    assert len(got) > 400 and len(tables) <= 6


def test_known_minhash_is_minhash(spark, monkeypatch):
    monkeypatch.setattr(X, "KEPT_WORDS", 3)
    monkeypatch.setattr(X, "GATHERED_WORDS", 4)
    sets = [["a", "b"], [], None, ["é", "b", "c", "d", "e", "f"], ["f"], ["a", "b"], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, ws array<string>").coalesce(1)
    for slots in (128, 9):
        got = df.select("id", X.minhash(F.col("ws"), slots).alias("x"), X.known_minhash(F.col("ws"), slots).alias("y")).collect()
        assert [r.x for r in got] == [r.y for r in got]
        assert [r.x is None for r in got] == [not s for s in sets]


def test_similar_pairs_are_all_banded_pairs(spark):
    rng = random.Random(5)
    base = [rng.choices(range(3), k=16) for _ in range(3)]
    sets = [[rng.randrange(3) if rng.random() < 0.3 else v for v in rng.choice(base)] for _ in range(150)] + base * 9 + [[v + 256 for v in base[0]]]
    df = spark.createDataFrame([(i * 7 % 1000, [f"{v:016x}" for v in s]) for i, s in enumerate(sets)], "id long, sketch array<string>")
    of = {r.id: r.sketch for r in df.collect()}
    pairs = [(r.a, r.b) for r in retrieve.banded_pairs(df, "id", 4, 4).select("a", "b").collect()]
    want = {(a, b, m) for a, b in pairs if (m := sum(x == y for x, y in zip(of[a], of[b])) / 16) >= 0.5}
    got = [tuple(r) for r in retrieve.similar_pairs(df, "id", 4, 4, 0.5).select("a", "b", "minhash").collect()]
    assert len(got) == len(want) > 500
    assert set(got) == want


def test_similar_pairs_join_no_sketches_to_candidates(spark):
    """Candidates that differ in most slots stop in their bucket: what leaves it is close to the result."""
    sets = [[f"{7:016x}"] * 2 + [f"{(i * 131 + j * 17) % 9973:016x}" for j in range(14)] for i in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, sketch array<string>")
    assert retrieve.banded_pairs(df, "id", 8, 2).count() == 200 * 199 // 2
    keys = [(b"k", i, bytes(int(x[14:], 16) for x in s)) for i, s in enumerate(sets)]
    likely = spark.createDataFrame(keys, "key binary, id long, mark binary").coalesce(1).mapInArrow(retrieve._likely(8), "x long, y long")
    assert likely.count() < 200


@pytest.mark.parametrize("text", [False, True])
def test_nearest_of_all_blocks(spark, monkeypatch, text):
    """Copies, zero, null and shorter vectors, over several blocks of queries and vectors, against one pair at a time."""
    for name, most in (("QUERY_BLOCK", 20), ("VECTOR_BLOCK", 30), ("COSINES", 100)):
        monkeypatch.setattr(retrieve, name, most)
    rng = random.Random(6)
    vectors = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(60)]
    vectors += vectors[:30] + [[0.0] * 4, None, [1.0, 2.0], [2.0, 4.0], [1.0, None, 0.0, 0.0], [], [3.0, 0.0, 0.0, 0.0]]
    name = (lambda i: f"t{i:03d}") if text else (lambda i: i)
    rows = [(name(i), v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"id {'string' if text else 'long'}, v array<double>")

    def cosine(x, y):
        if x is None or y is None or len(x) != len(y) or None in x + y:
            return None
        length = sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5
        return round(sum(a * b for a, b in zip(x, y)) / length, 6) if length else 0.0

    want = set()
    for a, x in rows[::2]:
        hits = sorted((-c, b) for b, y in rows if a != b and (c := cosine(x, y)) is not None and c >= -0.1)
        want |= {(a, b, -c, r + 1) for r, (c, b) in enumerate(hits[:7])}
    queries = df.where(F.col("id").isin([a for a, _ in rows[::2]]))
    got = retrieve.ann_topk(queries, df, "id", "v", 7, -0.1)
    assert {tuple(r) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_a_fold_does_not_look_through_whole_groups():
    """A chain is one group with every trace in it; a link looks at its ends' links only."""
    looks = 0

    class Members(dict):
        def __iter__(self):
            nonlocal looks
            looks += len(self)
            return super().__iter__()

    n = 400
    members, of, probs = {"g": Members()}, {}, {}
    for i in range(n):
        probs[i] = {j: 0.9 - 0.001 * (i % 7) for j in (i - 1, i + 1) if 0 <= j < n}
        of[i], members["g"][i] = {"g"}, (0.9, "supported")
    for i in range(n):
        group._assign(i, members, of, probs)
    assert looks <= 2 * n
    assert all(members["g"][i] == (sum(sorted(probs[i].values(), reverse=True)) / len(probs[i]), "supported") for i in range(n))


def test_sketches_of_empty_sets(spark):
    df = spark.createDataFrame([(["x"], []), ([], []), (["x"], ["x"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(X.sketch_jaccard(X.minhash(F.col("a")), X.minhash(F.col("b")))).collect()]
    assert got == [0.0, 1.0, 1.0]
    own = df.select(X.minhash(F.col("a"), 9).alias("s"), X.slot_hash(6, F.lit("x")).alias("h")).first()
    assert len(own.s) == 9 and own.s[6] == own.h


def test_sql_gate_reads_the_tree(spark):
    t = {"events": spark.range(5).withColumnRenamed("id", "k")}
    ok = ["SELECT count(*) FROM events", "WITH w AS (SELECT k FROM events) SELECT max(k) FROM w WHERE k IN (SELECT k FROM w)", "SELECT upper('java_method(') FROM events", "SELECT x FROM events LATERAL VIEW explode(array(1)) v AS x", "SELECT k FROM events UNION SELECT 7"]
    for sql in ok:
        assert query_tables(spark, sql, t).count() > 0, sql
    bad = [
        "SELECT `java_method`('java.lang.System', 'getProperty', 'user.dir')", "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.dir')", "SELECT `Try_Reflect` ('a', 'b')", "SELECT builtin.reflect('a', 'b')",
        "SELECT k FROM events WHERE k = (SELECT java_method('a', 'b'))", "WITH w AS (SELECT reflect('a', 'b') AS x) SELECT * FROM w", "SELECT input_file_name() FROM events", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM `parquet`.`/tmp/x`", "SELECT * FROM json . `/tmp/x`",
        "SELECT * FROM read_files('/tmp')", "SELECT * FROM other", "SELECT * FROM default.events", "DROP TABLE events", "INSERT INTO events VALUES (1)", "SELECT no_such(k) FROM events", "SELECT 1; SELECT 2", "SELECT current_user()", "SELECT current_user", "SELECT transform(k) USING 'cat' AS (k) FROM events",
    ]
    for sql in bad:
        with pytest.raises(Refused):
            query_tables(spark, sql, t)


def test_search_filters_are_checked(spark):
    docs = spark.createDataFrame([("a", "x y", 1), ("b", "x", 5)], "event_hash string, raw string, n int")
    assert [r.event_hash for r in search.search(docs, "x", "n > 2 AND length(raw) < 3").collect()] == ["b"]
    for bad in ("java_method('java.lang.System', 'getProperty', 'user.dir') IS NOT NULL", "`reflect`('a', 'b') = 'c'", "n IN (SELECT 1)", "EXISTS (SELECT 1)", "n = 1; DROP TABLE x"):
        with pytest.raises(Refused):
            search.search(docs, "x", bad).collect()


def test_running_sums_over_ranges(spark, monkeypatch):
    """Positions and sums equal those of one ordered window: ties, nulls, few and many distinct keys."""
    rng = random.Random(4)
    rows = [(i, rng.choice((None, float(rng.randrange(5)), rng.random() * 100)), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k double, v int")
    for descending in (False, True):
        want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
        got = {r["id"]: (r["__position"], r["s"]) for r in ranges.running(df, F.col("k"), ["id"], {"s": F.col("v")}, descending).collect()}
        total = 0
        for place, (i, _, v) in enumerate(want, 1):
            total += v
            assert got[i] == (place, total)
    assert ranges.running(df.limit(0), F.col("k"), ["id"], {}).count() == 0


def test_provenance_fixture(spark):
    edges, truth = readers.provenance_fixture(spark)
    again, _ = readers.provenance_fixture(spark)
    assert edges.collect() == again.collect() and truth.select("incident").distinct().count() == 4
    assert readers.incident_events(edges, truth).where("action = 'inject'").count() == 4


def _sets_of_slots(n, slots, kinds, seed):
    rng = random.Random(seed)
    base = [rng.choices(range(kinds), k=slots) for _ in range(4)]
    return [[rng.randrange(kinds) if rng.random() < 0.5 else v for v in rng.choice(base)] for _ in range(n)]


@pytest.mark.parametrize(("text", "mode"), [(False, "both"), (True, "both"), (False, "indicators")])
def test_retrieval_index_of_all_tiles(spark, monkeypatch, text, mode):
    """Three blocks, stripes of few rows: all pairs of a band or a word that is not common, ranked with ties by id; rows without a sketch or words."""
    monkeypatch.setattr(retrieve, "TILE", 60)
    monkeypatch.setattr(retrieve, "CELLS", 500)
    rng = random.Random(7)
    name = (lambda i: f"{i * 37 % 1000}é") if text else (lambda i: i * 37 % 1000)
    sketch = {name(i): [f"{v * 3:016x}" for v in s] if i % 29 else None for i, s in enumerate(_sets_of_slots(150, 8, 5, 5))}
    uses = {i: {f"w{rng.randrange(60)}" for _ in range(rng.randrange(4))} | {"common"} for i in sketch}
    df = spark.createDataFrame(list(sketch.items()), f"id {'string' if text else 'long'}, sketch array<string>")
    words = spark.createDataFrame([(i, w) for i, ws in uses.items() for w in ws], df.schema["id"].dataType.simpleString().join(["id ", ", w string"]))

    def same(x, y):
        return sum(p == q for p, q in zip(x, y)) if x and y else 8 * (x == y)

    def near(a, b):
        x, y = sketch[a], sketch[b]
        return bool(uses[a] & uses[b] - {"common"}) or (mode == "both" and x and y and any(x[k : k + 2] == y[k : k + 2] for k in range(0, 8, 2)))

    want = []
    for a in sketch:
        found = sorted((-same(sketch[a], sketch[b]), b) for b in sketch if b != a and near(a, b))[:5]
        want += [(a, b, round(-s / 8, 6), k + 1) for k, (s, b) in enumerate(found)]
    got = retrieve.retrieval_index(df, words, "id", "w", 4, 2, mode, 5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(want) > 300


def test_tiles_give_the_best_pairs_only(spark):
    """200 rows that all share a band are 19,900 pairs; none leaves its tile but the best of each row, without its sketches."""
    docs = retrieve._docs(spark.createDataFrame([(i, [7, 7, *range(i, i + 14)]) for i in range(200)], "id long, sketch array<long>"), "id")
    docs = docs.withColumn("words", F.array().cast("array<long>"))
    left = retrieve._tiled(docs, retrieve._ranked_pairs([(0, 1)], 16, 5), "a long, b long, same int")
    assert left.columns == ["a", "b", "same"]
    assert 200 * 5 <= left.count() <= 2 * 200 * 5


@pytest.mark.parametrize("text", [False, True])
def test_probes_of_all_tiles(spark, monkeypatch, text):
    """Three blocks, stripes of few rows, rows without a sketch: as every pair compared, and no pair twice though many share several bands."""
    monkeypatch.setattr(retrieve, "TILE", 60)
    monkeypatch.setattr(retrieve, "CELLS", 500)
    name = (lambda i: f"{i * 37 % 1000}é") if text else (lambda i: i * 37 % 1000)
    sketch = {name(i): s if i % 29 else None for i, s in enumerate(_sets_of_slots(150, 8, 6, 3))}
    df = spark.createDataFrame(list(sketch.items()), f"id {'string' if text else 'long'}, sketch array<long>")
    off = lambda a, b: [sum(p != q for p, q in zip(sketch[a][k : k + 4], sketch[b][k : k + 4])) for k in (0, 4)] if sketch[a] and sketch[b] else [4]
    exact = {(a, b) for a in sketch for b in sketch if a != b and min(off(a, b)) == 0}
    probe = {(a, b) for a in sketch for b in sketch if a != b and min(off(a, b)) <= 1}
    few = {a for a in sketch if sum(x == a for x, _ in exact) + 1 < 3}
    assert len(exact) > 100 and 10 < len(few) < 140
    assert sorted(tuple(r) for r in retrieve.probe_pairs(df, "id", 2, 4).collect()) == sorted((a, b) for a, b in probe if a < b)
    assert sorted(tuple(r) for r in retrieve.lsh_candidates(df, "id", 2, 4, 3).collect()) == sorted(exact | {p for p in probe if p[0] in few})


def test_a_wide_code_is_compared_in_full(spark, monkeypatch):
    """Bands of more slots than fit in a key: the slots beyond it count."""
    monkeypatch.setattr(retrieve, "TILE", 40)
    sets = [[i % 3] + [7] * 20 + [i % 5] for i in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sketch array<long>")
    got = {tuple(r) for r in retrieve.probe_pairs(df, "id", 1, 22).collect()}
    assert got == {(a, b) for a in range(80) for b in range(a + 1, 80) if a % 3 == b % 3 or a % 5 == b % 5}


def test_probe_pairs_are_not_shuffled(spark):
    """19,900 pairs that share many keys: only sketches are dealt out, and each pair is found once."""
    df = spark.createDataFrame([(i, [7] * 16) for i in range(200)], "id long, sketch array<long>")
    got = retrieve.probe_pairs(df, "id", 4, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert got.count() == 19_900


def test_repeated_and_missing_ids_pair_once(spark):
    df = spark.createDataFrame([(i, [7] * 8) for i in (1, 1, 2, 3, None)], "id long, sketch array<long>")
    assert sorted(tuple(r) for r in retrieve.probe_pairs(df, "id", 2, 4).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(tuple(r) for r in retrieve.lsh_candidates(df, "id", 2, 4).collect()) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
