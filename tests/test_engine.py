import glob
import os

import pytest
from pyspark.sql import functions as F

from tracelode.__main__ import answer, change, demo, demo_records, read_body, render, render_waterfall
from tracelode.api import Engine
from tracelode.operators.store import Locked
from tracelode.plans.sqlgate import Refused, json_rows
from tracelode.streaming.ingest import Conflict, session_stream, windowed_counts


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert e.ingest_records(demo_records(), "demo") == 4
    return e


def test_retry_is_idempotent(engine):
    assert engine.ingest_records(demo_records(), "demo") == 0
    assert engine.verify()["ok"]


def test_conflict_and_bad_record(engine):
    with pytest.raises(Conflict):
        engine.ingest_records([demo_records()[0] | {"raw": "other"}], "c")
    with pytest.raises(ValueError):
        engine.ingest_records([{"host": "x"}], "d")


def test_seal_search_live(engine):
    assert engine.seal() == ["batch-demo"] and engine.index() == ["batch-demo"] and engine.seal() == []
    engine.ingest_records([{"ts": 5, "host": "z", "action": "log.error", "raw": "powershell failed", "event_id": "n"}], "b2")
    got = {r["host"]: r["_source"] for r in json_rows(engine.search("powershell"))}
    assert got == {"alpha": "sealed", "beta": "sealed", "z": "live"}
    assert [r["host"] for r in json_rows(engine.search("powershell", bm25=True))][-1] == "z"
    assert engine.verify()["ok"]


def test_query_gate(engine):
    rows = json_rows(engine.query("SELECT host, count(*) AS n FROM events GROUP BY host ORDER BY host"))
    assert [r["host"] for r in rows] == ["alpha", "beta", "z"]
    for bad in ("DROP TABLE events", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "SELECT reflect('a', 'b')", "", "SET a = 1"):
        with pytest.raises(Refused):
            engine.query(bad)


def test_groups_and_routes(engine):
    assert {r["trace_id"] for r in json_rows(engine.groups())} == {"session:alpha:s1:0", "session:beta:s2:0"}
    assert "chat" in render_waterfall(answer(engine, "traces/t1", {}))
    assert render(answer(engine, "/api/services", {}))
    with pytest.raises(KeyError):
        answer(engine, "/api/nothing", {})
    assert change(engine, "/api/seal", "") == {"sealed": ["batch-b2"], "indexed": ["batch-b2"]}


def test_streams(spark, tmp_path):
    rows = [("k", i * 1_000_000) for i in (0, 10, 500, 505)]
    spark.createDataFrame(rows, "key string, us long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, us long").parquet(str(tmp_path / "in"))
    q = session_stream(stream, "key", "us", 60, 1000).writeStream.outputMode("update").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session, r.events, r.sealed) for r in spark.table("sessions").collect()}
    assert got == {(0, 2, True), (1, 2, False)}
    timed = stream.withColumn("ts", F.timestamp_micros("us"))
    q = windowed_counts(timed, "ts", "key", "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 4


def test_stream_ingest(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"ts": 1, "host": "h", "action": "a"}\n{"ts": 2, "host": "h", "action": "b"}\n')
    lines = spark.readStream.text(str(tmp_path / "in"))
    e.ingester.stream(lines, str(tmp_path / "cp")).awaitTermination()
    assert e.events().count() == 2


def records(n, host="h", start=0):
    return [{"ts": 1_700_000_000 + i, "host": host, "action": "exec", "raw": f"word{i % 7} token{i}", "event_id": f"{host}{i}"} for i in range(start, start + n)]


def test_segments_roll_and_verify(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.store.segment_rows = 10
    assert e.ingest_records(records(45), "one") == 45
    m = e.store.manifest().orderBy("seq").collect()
    assert len(m) == 5 and sum(r["count"] for r in m) == 45 and [r.seq for r in m] == list(range(5))
    assert [r.prev_root for r in m[1:]] == [r.root for r in m[:-1]]
    assert e.ingest_records(records(5, start=100), "two") == 5 and e.verify()["ok"] and e.events().count() == 50
    assert len(e.seal()) == 6 and len(e.index()) == 6 and e.verify()["ok"]
    found = e.search("token1")
    assert found.count() == 11 + 5 and any("index/trigrams" in f for f in found.inputFiles())
    assert e.search("TOKEN1").count() == 0 and e.search("to", limit=10_000).count() == 50
    # a sealed file that changes is found
    file = sorted(glob.glob(str(tmp_path / "s/sealed/*/*.parquet")))[0]
    data = bytearray(open(file, "rb").read())
    data[8] ^= 1
    crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    open(file, "wb").write(bytes(data))
    report = e.verify()
    assert not report["ok"] and len(report["bad_segments"]) == 1


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    e = Engine(spark, path)
    e.ingest_records(records(3), "one")
    monkeypatch.setattr(e.store, "_commit", lambda batch: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.ingest_records(records(4, start=10), "two")
    assert e.events().count() == 3  # what isn't entered isn't there
    monkeypatch.undo()
    assert e.ingest_records(records(4, start=10), "two") == 0 and e.events().count() == 7  # the next write recovers first
    monkeypatch.setattr(e.store, "_commit", lambda batch: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.ingest_records(records(2, start=20), "three")
    again = Engine(spark, path)  # and so does opening
    assert again.events().count() == 9 and again.ingest_records(records(2, start=20), "three") == 0 and again.verify()["ok"]


def test_one_writer_at_a_time(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "s")), Engine(spark, str(tmp_path / "s"))
    with a.store.lock():
        with pytest.raises(Locked):
            b.ingest_records(records(1), "x")
        assert a.ingest_records(records(1), "x") == 1
    assert b.ingest_records(records(1), "x") == 0


def demo_traces(n=8):
    out = []
    for i in range(n):
        raw = f"powershell -enc payload{i % 2} http://c2.example.net/a stage{i % 2} run{i % 2} exfil{i % 2}"
        out.append({"ts": 1_700_000_000 + i, "host": f"h{i}", "action": "exec", "raw": raw, "session_id": f"s{i}", "event_id": f"e{i}", "subject": f"p{i}", "object": f"f{i % 2}", "technique_ids": [f"T{i % 2}"], "indicators": {"ip": [f"203.0.113.{i % 2}"]}})
    return out


def test_links_queue_model_and_review_survive(spark, tmp_path):
    path = str(tmp_path / "s")
    e = Engine(spark, path)
    e.ingest_records(demo_traces(), "one")
    links = {(r.a, r.b): r for r in e.links().collect()}
    assert all(r.idf_shared > 0 for r in links.values() if r.shared) and any(r.shared for r in links.values())
    assert {"ann", "indicator", "lsh"} <= {s for r in links.values() for s in r.sources}
    q = e.queue(budget=60).orderBy("position").collect()
    assert [r.position for r in q] == list(range(1, len(links) + 1)) and [r.estimate for r in q] == sorted((r.estimate for r in q), reverse=True)
    assert [r["round"] for r in q] == sorted(r["round"] for r in q) and q[-1]["round"] > 0
    member = e.groups().first()
    e.review(member.trace_id, member.group_id, "rejected")
    labels = spark.createDataFrame([(a, b, int(r.shared > 0)) for (a, b), r in links.items()], "a string, b string, label int")
    e.train(labels)
    again = Engine(spark, path)
    assert len(again.ledger.records) == 2 and again.verify()["ok"]
    assert again.groups().where((F.col("trace_id") == member.trace_id) & (F.col("group_id") == member.group_id)).first().state == "rejected"
    assert {(r.a, r.b): round(r.p, 6) for r in again.links().collect()} == {(r.a, r.b): round(r.p, 6) for r in e.links().collect()} != {k: round(r.p, 6) for k, r in links.items()}
    view = again.group_view(member.group_id)
    assert view["timeline"].count() == view["members"].where("state in ('proposed', 'supported', 'confirmed')").count()


def test_attribution_and_reconstruction(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest_records(demo_traces(), "one")
    train = spark.createDataFrame([(f"actor{i % 2}", ["powershell", f"payload{i % 2}", f"stage{i % 2}", f"run{i % 2}"], [f"T{i % 2}"]) for i in range(8)], "actor string, tokens array<string>, techniques array<string>")
    out = e.attribute(train).collect()
    assert out and {r.status for r in out} <= {"attributed", "candidates", "unresolved"}
    forest, roles = e.reconstruct("f0")
    assert forest.count() >= 1 and {r.role for r in roles.collect()} == {"entry", "exit"}
    with pytest.raises(KeyError):
        e.reconstruct("nothing")


def test_tables_are_made_when_named(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest_records(records(3), "one")
    monkeypatch.setattr(e, "groups", lambda: 1 / 0)
    assert e.query("SELECT count(*) AS groups FROM events").first()[0] == 3
    with pytest.raises(ZeroDivisionError):
        e.query("SELECT * FROM memberships")
    with pytest.raises(Refused):
        e.search("word", "java_method('a', 'b') = 'c'")


def test_idle_sessions_are_sealed_by_the_watermark(spark, tmp_path):
    day = 1_700_000_000_000_000
    for i, rows in enumerate(([("a", day), ("a", day + 5_000_000), ("b", day)], [("b", day + 500_000_000)], [("b", day + 510_000_000)])):
        spark.createDataFrame(rows, "key string, us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, us long").parquet(str(tmp_path / "in"))
        q = session_stream(stream, "key", "us", 60, 10_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        q = q.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.key, r.session, r.events) for r in spark.read.parquet(str(tmp_path / "out")).where("sealed").collect()}
    assert ("a", 0, 2) in got and ("b", 0, 1) in got


def test_bodies_name_their_line():
    assert read_body('[{"a": 1}, {"a": 2}]') == [{"a": 1}, {"a": 2}] and read_body('{"a": 1}') == [{"a": 1}]
    assert read_body('{"a": 1}\n\n{"a": 2}\n') == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError, match="line 3"):
        read_body('{"a": 1}\n\n{"a": \n{"a": 4}')
    with pytest.raises(ValueError, match="line 2"):
        read_body('{"a": 1}\n7')


def test_routes_are_exact(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    assert change(e, "/api/demo", "") == {"accepted": 4} and change(e, "/api/demo/otlp", "") == {"accepted": 3}
    assert [r["model"] for r in answer(e, "/api/ai/calls", {"service": "shop"})] == ["demo-1"]
    assert answer(e, "/v1/logs", {"severity": "error"})[0]["raw"] == "[ERROR] the model did not answer"
    tree = answer(e, "/api/v1/traces/5b8aa5a2d2c872e8321cf37308d69df2", {})
    assert [(r["action"], r["depth"], r["status"]) for r in tree] == [("GET /order", 0, "ok"), ("chat", 1, "error")]
    for bad in ("/api/status/x", "/v1/status", "/api/api/status", "/x/status", "/api/spans", "/api/groups/a/b"):
        with pytest.raises(KeyError):
            answer(e, bad, {})
    with pytest.raises(KeyError):
        change(e, "/api/seal/x", "")


def test_demo_tells_what_came_of_it(spark, tmp_path):
    out = demo(Engine(spark, str(tmp_path / "s")))
    assert '"verified": true' in out and '"groups": 1' in out and "session:alpha:s1:0" in out
