"""More registered queries: readers, telemetry, normalization, features, groups, attribution and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import attrib, evaluate, graph, group, ledger, match, normalize, retrieve, search, traces, views
from ..sources import otlp, readers
from ..streaming import ingest
from . import adapters as A
from .queries import _BAND, _EVENTS, _HASHES, _ITEMS, _LINKS, _SLOTS, _members, _pairs, _register, _sclc_sql, _sketches
from .sqlgate import query_unlimited

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


# Readers


@_register("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def json_records(spark, sf_dir):
    lines = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value"))
    return readers.parse_lines(lines).select("id", F.element_at("record", "k").alias("k"))


@_register("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE event_id::VARCHAR END AS ts, 'h' || (user_id % 8) AS host, event_type AS action, 3::BIGINT AS fields FROM events""")
def edge_aliases(spark, sf_dir):
    """Alias keys are renamed, a canonical key that is there wins."""
    e = A.table(spark, sf_dir, "events")
    record = F.map_filter(F.create_map(F.lit("timestamp"), F.col("event_id").cast("string"), F.lit("hostname"), F.concat(F.lit("h"), F.col("user_id") % 8), F.lit("event_type"), "event_type", F.lit("ts"), F.when(F.col("event_id") % 3 == 0, "own")), lambda k, v: v.isNotNull())
    rows = e.select(F.col("event_id").alias("id"), readers.apply_aliases(record).alias("r"))
    return rows.select("id", *[F.col("r")[c].alias(c) for c in ("ts", "host", "action")], F.size("r").cast("long").alias("fields"))


@_register("SELECT n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position FROM nation")
def request_bodies(spark, sf_dir):
    """A JSON array a region, as a request's body."""
    n = A.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("name")))).alias("body"))
    rows = readers.parse_body(n.select("body"))
    return rows.select(F.element_at("record", "name").alias("name"), F.col("position").cast("long").alias("position"))


@_register("SELECT 's' || conv_id AS session_id, turn::BIGINT AS position, CASE WHEN turn % 2 = 0 THEN 't' || conv_id ELSE 'at' || turn END AS ts, md5(text) AS digest, 'exec' AS action FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1 AND count(*) OVER (PARTITION BY conv_id) = max(turn) OVER (PARTITION BY conv_id) + 1")
def expand_sessions(spark, sf_dir):
    """Conversations as sessions of commands: every other one has a time of its own."""
    c = A.table(spark, sf_dir, "conversations")
    whole = F.count(F.lit(1)).over(Window.partitionBy("conv_id")) == F.max("turn").over(Window.partitionBy("conv_id")) + 1
    one = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) == 1
    c = c.withColumn("ok", whole & one).where("ok")
    command = F.to_json(F.struct(F.col("text").alias("command"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("at"), "turn")).alias("ts")))
    by = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", command.alias("c")))), lambda x: x["c"]).alias("commands"))
    rows = readers.expand_sessions(by.select(F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("t"), "conv_id").alias("ts"), "commands")).alias("value")))
    return rows.select("session_id", F.col("position").cast("long").alias("position"), "ts", F.md5(F.col("raw").cast("binary")).alias("digest"), "action")


@_register("""WITH r AS (SELECT lower(trim(event_type)) AS actor, user_id, epoch_us(ts) AS us FROM events)
SELECT actor, count(DISTINCT user_id)::BIGINT AS sessions, count(*)::BIGINT AS commands, min(us) AS first_ts, max(us) AS last_ts, count(*) FILTER (WHERE us % 2 = 1)::BIGINT AS dropped FROM r GROUP BY 1""")
def corpus_manifest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("actor"), F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return readers.corpus_manifest(e, F.col("ts") % 2 == 1)


# OpenTelemetry


def _attr(key: str, kind: str, value):
    kinds = [(value if k == kind else F.lit(None)).cast("string").alias(k) for k in ("stringValue", "intValue")]
    return F.struct(F.lit(key).alias("key"), F.struct(*kinds).alias("value"))


def _turns(spark, sf_dir) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.role", "x.text")
    h = lambda *parts: F.md5(F.concat_ws(":", *parts).cast("binary"))
    nanos = lambda ms: F.concat((F.lit(1_700_000_000) + F.col("conv_id")).cast("string"), F.lpad(ms.cast("string"), 3, "0"), F.lit("000000"))
    return c.select("conv_id", "turn", "role", "text", h("conv_id").alias("trace"), F.substring(h("conv_id", "turn"), 1, 16).alias("span"), F.substring(h("conv_id", F.col("turn") - 1), 1, 16).alias("parent"), nanos(F.col("turn") % 500).alias("start"), nanos(F.col("turn") % 500 + F.col("conv_id") % 7).alias("end"))


_TURNS = """tn AS (SELECT conv_id, turn, arg_min(role, role || chr(0) || text) AS role, arg_min(text, role || chr(0) || text) AS text FROM conversations GROUP BY 1, 2)"""


@_register(f"""WITH {_TURNS} SELECT role AS source_id, 'box' || (conv_id % 3) AS host, {_ISO.format("make_timestamp((1700000000 + conv_id) * 1000000 + (turn % 500) * 1000)")} AS ts, 'turn.' || role AS action, md5(conv_id::VARCHAR) AS subject,
CASE WHEN turn % 4 = 0 THEN '/chat' ELSE 'turn.' || role END AS object, left(md5(conv_id || ':' || (CASE WHEN turn > 0 THEN turn - 1 ELSE turn END)), 16) AS session_root, left(md5(conv_id || ':' || turn), 16) AS span_id, (conv_id % 7)::DOUBLE AS duration_ms,
CASE WHEN turn % 5 = 2 THEN 'error' ELSE 'ok' END AS status, 'span' AS layer, CASE WHEN role = 'assistant' THEN 'm' || (turn % 3) END AS model, CASE WHEN role = 'assistant' THEN (turn + 10 + length(text))::BIGINT END AS total_tokens FROM tn""")
def otlp_spans(spark, sf_dir):
    """Turns as spans of trace payloads: nested JSON in, flat events out."""
    t = _turns(spark, sf_dir)
    own = F.array(_attr("layer", "stringValue", F.lit("first")), _attr("layer", "stringValue", F.lit("span")), _attr("http.route", "stringValue", F.when(F.col("turn") % 4 == 0, "/chat")), _attr("gen_ai.request.model", "stringValue", F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("turn") % 3))),
                  _attr("gen_ai.usage.input_tokens", "intValue", F.when(F.col("role") == "assistant", (F.col("turn") + 10).cast("string"))), _attr("gen_ai.usage.output_tokens", "intValue", F.when(F.col("role") == "assistant", F.length("text").cast("string"))))
    span = F.struct(F.upper("trace").alias("traceId"), F.base64(F.unhex("span")).alias("spanId"), F.when(F.col("turn") > 0, F.col("parent")).otherwise("").alias("parentSpanId"), F.concat(F.lit("turn."), "role").alias("name"), F.col("start").alias("startTimeUnixNano"), F.col("end").alias("endTimeUnixNano"), own.alias("attributes"), F.struct(F.when(F.col("turn") % 5 == 2, "STATUS_CODE_ERROR").alias("code")).alias("status"))
    resource = F.struct(F.array(_attr("service.name", "stringValue", F.col("role")), _attr("host.name", "stringValue", F.concat(F.lit("box"), F.col("conv_id") % 3)), _attr("layer", "stringValue", F.lit("resource"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.struct(F.lit("s").alias("name")).alias("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    out = otlp.parse_traces(t.select(body.alias("body")))
    return out.select("source_id", "host", "ts", "action", "subject", "object", "session_root", "span_id", "duration_ms", "status", F.element_at("attributes", "layer").alias("layer"), F.col("ai.model").alias("model"), F.col("ai.total_tokens").alias("total_tokens"))


@_register(f"""WITH {_TURNS} SELECT CASE WHEN turn % 2 = 0 THEN role ELSE 'otlp' END AS source_id, {_ISO.format("make_timestamp((1700000000 + conv_id) * 1000000 + (turn % 500) * 1000)")} AS ts, 'log.' || CASE WHEN turn % 3 = 0 THEN 'warn' ELSE 'info' END AS action, md5(conv_id::VARCHAR) AS subject,
left(md5(conv_id || ':' || turn), 16) AS span_id, md5('[' || CASE WHEN turn % 3 = 0 THEN 'WARN' ELSE 'INFO' END || '] ' || text) AS raw, CASE WHEN turn % 3 = 0 THEN 'WARN' ELSE 'INFO' END AS severity FROM tn""")
def otlp_logs(spark, sf_dir):
    """Turns as log records; every other one has only an observed time and no service."""
    t = _turns(spark, sf_dir)
    log = F.struct(F.when(F.col("turn") % 2 == 0, F.col("start")).otherwise("0").alias("timeUnixNano"), F.col("start").alias("observedTimeUnixNano"), F.when(F.col("turn") % 3 == 0, "WARN").otherwise("").alias("severityText"), F.struct(F.col("text").alias("stringValue")).alias("body"), F.col("trace").alias("traceId"), F.upper("span").alias("spanId"))
    resource = F.struct(F.array(_attr("service.name", "stringValue", F.when(F.col("turn") % 2 == 0, F.col("role")))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(log).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    out = otlp.parse_logs(t.select(body.alias("body")))
    return out.select("source_id", "ts", "action", "subject", "span_id", F.md5(F.col("raw").cast("binary")).alias("raw"), F.element_at("attributes", "severity").alias("severity"))


# Normalization


@_register(f"""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN {_ISO.format("make_timestamp(event_id * 1000000 + 500000)")} WHEN 1 THEN {_ISO.format("ts")} END AS ts FROM events""")
def coerce_ts(spark, sf_dir):
    """Epoch numbers and ISO text with a zone are times; other text is none."""
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    kind = F.col("event_id") % 4
    given = F.when(kind == 0, F.concat("event_id", F.lit(".5"))).when(kind == 1, iso).when(kind == 2, "NaN").otherwise("2024-01-01 no zone")
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), normalize.coerce_ts(given).alias("ts"))


def _records(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    record = F.create_map(F.lit("ts"), iso, F.lit("host"), F.col("host"), F.lit("action"), F.col("action"), F.lit("raw"), F.col("raw"), F.lit("session_id"), F.col("session_id").cast("string"), F.lit("source_seq"), F.col("id").cast("string"), F.lit("attributes"), F.col("attributes"), F.lit("object"), F.concat(F.lit("file:f"), F.col("id") % 9))
    return e.select("id", record.alias("record"), F.col("source_id"))


_NORMAL = f"""{_EVENTS}, nm AS (SELECT id, {_ISO.format("make_timestamp(us)")} AS ts, host, source_id, id AS source_seq, '' AS subject, 'file:f' || (id % 9) AS object, action, '{{"k":"' || json_extract_string(attributes, '$.k') || '","session_id":"' || session_id || '"}}' AS attributes,
sha256(lower(trim(action)) || '|file|' || trim(regexp_replace({_sclc_sql('raw')}, '\\s+', ' ', 'g'))) AS template_hash, raw FROM ev)"""


@_register(f"""WITH {_NORMAL} SELECT ts, host, source_id, source_seq, object, action, attributes, template_hash, raw,
sha256(to_json(struct_pack(action := action, attributes := attributes, host := host, object := object, raw := raw, source_id := source_id, source_seq := source_seq, subject := subject, template_hash := template_hash, ts := ts))::VARCHAR) AS event_hash FROM nm""")
def normalize_events(spark, sf_dir):
    """Raw records to events: times, folded attributes, template and event hashes."""
    events, _ = normalize.normalize(_records(spark, sf_dir).withColumn("source_seq", F.lit(None).cast("long")), "2024-01-01T00:00:00Z")
    return events.select("ts", "host", "source_id", "source_seq", "object", "action", "attributes", "template_hash", "raw", "event_hash")


@_register(f"""WITH {_EVENTS} SELECT CASE id % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'host,action' WHEN 2 THEN 'source_seq' ELSE 'attributes' END AS problems, count(*)::BIGINT AS n FROM ev WHERE id % 5 < 4 GROUP BY 1""")
def rejected_records(spark, sf_dir):
    """Records that can't be events, by what is wrong with them."""
    k = F.col("id") % 5
    changed = lambda name, value: F.map_from_arrays(F.array(F.lit(name)), F.array(F.lit(value)))
    over = lambda m: F.map_concat(F.map_filter("record", lambda key, v: ~F.map_contains_key(m, key)), m)
    blank = F.map_from_arrays(F.array(F.lit("host"), F.lit("action")), F.array(F.lit(" "), F.lit("")))
    record = F.when(k == 0, over(changed("ts", "soon"))).when(k == 1, over(blank)).when(k == 2, over(changed("source_seq", "-4"))).when(k == 3, over(changed("attributes", "[oops"))).otherwise(F.col("record"))
    _, rejected = normalize.normalize(_records(spark, sf_dir).withColumn("record", record).withColumn("source_seq", F.lit(None).cast("long")), "x")
    return rejected.groupBy("problems").agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH {_EVENTS} SELECT id, 'session:' || host || ':' || session_id AS anchor, us / 1000000.0::DOUBLE AS ts_epoch, 'T' || (id % 4) || ',T' || (id % 4 + 1) AS techniques, 'a' || (id % 6) || ',b' AS indicators, 'e' || (id % 3) || ',s' || (id % 5) || ',o' AS entities,
len(regexp_extract_all(lower(raw), '{X.EVENT_TOKEN}'))::BIGINT AS tokens FROM ev""")
def adapt_events(spark, sf_dir):
    """What assembly reads from an event: anchor, tokens, techniques, indicators, entities; repeats and nulls go."""
    e = A.events(spark, sf_dir)
    technique = F.to_json(F.array(F.concat(F.lit("T"), F.col("id") % 4), F.concat(F.lit("T"), F.col("id") % 4 + 1), F.concat(F.lit("T"), F.col("id") % 4)))
    indicators = F.to_json(F.struct(F.array(F.concat(F.lit("a"), F.col("id") % 6), F.lit("b"), F.lit("b")).alias("ip"), F.array(F.lit(None).cast("string")).alias("none")), {"ignoreNullFields": "false"})
    entities = F.to_json(F.array(F.concat(F.lit("e"), F.col("id") % 3), F.concat(F.lit("s"), F.col("id") % 5)))
    attributes = F.to_json(F.create_map(F.lit("session_id"), F.col("session_id").cast("string"), F.lit("technique_ids"), technique, F.lit("indicators"), indicators, F.lit("entities"), entities))
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    rows = normalize.adapt(e.select("id", "host", "raw", attributes.alias("attributes"), iso.alias("ts"), F.concat(F.lit("s"), F.col("id") % 5).alias("subject"), F.lit("o").alias("object")))
    join = lambda c: F.array_join(c, ",")
    return rows.select("id", "anchor", "ts_epoch", join("techniques").alias("techniques"), join(F.flatten(F.map_values("indicators"))).alias("indicators"), join("entities").alias("entities"), F.size("tokens").cast("long").alias("tokens"))


@_register(f"""WITH {_EVENTS} SELECT id, left(sha256(concat_ws('|', us::VARCHAR, host, source_id, id::VARCHAR, 's', 'o', action, attributes, raw)), 32) AS fallback, left(sha256(host || chr(31) || action || chr(31) || raw), 32) AS joined,
CASE id % 3 WHEN 0 THEN 'x,y' WHEN 1 THEN 'tpl' ELSE lower(action) || ':file' END AS tokens FROM ev""")
def fallback_hashes(spark, sf_dir):
    """Hashes and tokens of events that come without their own."""
    e = A.events(spark, sf_dir)
    fields = [F.col("us").cast("string"), "host", "source_id", F.col("id").cast("string"), F.lit("s"), F.lit("o"), "action", "attributes", "raw"]
    k = F.col("id") % 3
    tokens = normalize.tokens_or(F.when(k == 0, F.array(F.lit("x"), F.lit("y"))), F.when(k == 1, "tpl"), F.col("action"), F.lit("file"))
    return e.select("id", normalize.short_hash(*fields, separator="|").alias("fallback"), normalize.short_hash("host", "action", "raw", separator="\x1f").alias("joined"), F.array_join(tokens, ",").alias("tokens"))


# Search


@_register(f"""WITH {_EVENTS} SELECT CASE WHEN id % 2 = 0 THEN 'sealed' ELSE 'live' END AS _source, count(*)::BIGINT AS n, sum(CASE WHEN id % 2 = 0 THEN id ELSE 0 END)::BIGINT AS tags FROM ev GROUP BY 1""")
def events_union(spark, sf_dir):
    """Sealed and live events in one frame; live ones have no tags yet."""
    e = A.events(spark, sf_dir).select("id", "raw")
    rows = search.all_events(e.where("id % 2 = 0").withColumn("flux_tags", F.col("id").cast("long")), e.where("id % 2 = 1"))
    return rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("flux_tags").alias("tags"))


@_register(r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+(?:/[a-z0-9_.:-]+)?') AS ts FROM documents WHERE doc_id % 2 = 0), l AS (SELECT id, len(ts) AS len FROM t), p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY 1, 2),
h AS (SELECT * FROM p WHERE term = 'license'), s AS (SELECT count(*) AS n, avg(len) AS a, (SELECT count(*) FROM h) AS df FROM l), b AS (SELECT h.id, round(ln(1 + (s.n - s.df + 0.5) / (s.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.len / s.a)), 6)::DOUBLE AS score FROM h JOIN l USING (id) CROSS JOIN s)
SELECT id, score FROM (SELECT * FROM b UNION ALL SELECT doc_id, 0.5 FROM documents WHERE doc_id % 2 = 1 AND contains(text, 'License')) ORDER BY score DESC, id LIMIT 40""")
def hybrid_search(spark, sf_dir):
    """Ranked hits of indexed documents with literal hits of the others."""
    d = A.table(spark, sf_dir, "documents")
    scores = search.bm25(*search.bm25_index(d.where("doc_id % 2 = 0"), "doc_id", "text"), "license")
    return search.hybrid(scores, d.where("doc_id % 2 = 1"), "License", 40, "text", "doc_id")


@_register("""SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'mi')""")
def search_short(spark, sf_dir):
    """A query shorter than a trigram scans."""
    d = A.table(spark, sf_dir, "documents")
    return search.trigram_search(d, None, "MI", "doc_id", "text").select(F.col("doc_id").alias("id"))


# Telemetry views


@_register(f"""WITH {_TURNS}, sp AS (SELECT conv_id || ':' || (turn // 2) AS span_id, text FROM tn WHERE turn % 2 = 0), lg AS (SELECT conv_id || ':' || (turn // 2) AS span_id, lpad(turn::VARCHAR, 5, '0') AS ts, role, text FROM tn WHERE turn % 2 = 1)
SELECT sp.span_id, count(lg.ts)::BIGINT AS n, min(md5(lg.text)) AS first FROM sp LEFT JOIN lg USING (span_id) GROUP BY 1""")
def span_logs(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("span_id", F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2)))
    logs = t.where("turn % 2 = 1").select("span_id", F.lpad(F.col("turn").cast("string"), 5, "0").alias("ts"), F.col("role").alias("action"), F.col("text").alias("raw"))
    out = views.attach_logs(t.where("turn % 2 = 0").select("span_id"), logs)
    return out.select("span_id", F.size("logs").cast("long").alias("n"), F.md5(F.get("logs", F.lit(0))["raw"].cast("binary")).alias("first"))


@_register(f"""WITH {_TURNS} SELECT '1' AS span_id, lpad(max(turn)::VARCHAR, 5, '0') AS ts, (SELECT count(*) FROM tn WHERE conv_id = 2)::BIGINT AS n FROM tn WHERE conv_id = 1""")
def newest_span(spark, sf_dir):
    """The last span of an id with its logs."""
    t = _turns(spark, sf_dir)
    ts = F.lpad(F.col("turn").cast("string"), 5, "0").alias("ts")
    spans = t.select(F.col("conv_id").cast("string").alias("span_id"), ts)
    logs = t.where("conv_id = 2").select(F.lit("1").alias("span_id"), ts, F.col("role").alias("action"), F.col("text").alias("raw"))
    return views.get_span(spans, logs, "1").select("span_id", "ts", F.size("logs").cast("long").alias("n"))


# Ingest


_BATCH = """bt AS (SELECT event_id AS position, event_type AS source_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS event_id, CASE WHEN event_id % 7 = 1 THEN event_id * 1000 END AS explicit_seq, 'f' || (event_id % 50) AS fingerprint FROM events),
idn AS (SELECT *, CASE WHEN event_id IS NOT NULL THEN 'event:' || source_id || ':' || event_id WHEN explicit_seq IS NOT NULL THEN 'seq:' || source_id || ':' || explicit_seq ELSE 'request:q:' || source_id || ':' || position END AS identity FROM bt)"""


@_register(f"""WITH {_BATCH}, fr AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS n FROM idn WHERE position % 10 > 1),
sq AS (SELECT identity, source_id, (n + coalesce(last_value(explicit_seq - n IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY position ROWS UNBOUNDED PRECEDING), 500))::BIGINT AS source_seq FROM fr)
SELECT identity, source_seq, NULL AS conflict FROM sq UNION ALL SELECT identity, NULL, 'identity is taken' FROM idn WHERE position % 10 = 1""")
def ingest_resolve(spark, sf_dir):
    """A batch against receipts: duplicates go, other content under a known identity is a conflict, sequences go on from checkpoints."""
    e = A.table(spark, sf_dir, "events")
    k = F.col("event_id")
    batch = e.select(k.alias("position"), F.lit("q").alias("request_id"), F.when(k % 3 == 0, F.concat(F.lit("e"), k)).alias("event_id"), F.col("event_type").alias("source_id"), F.when(k % 7 == 1, k * 1000).alias("explicit_seq"), F.concat(F.lit("f"), k % 50).alias("fingerprint"))
    name = F.coalesce(F.concat(F.lit("event:"), "source_id", F.lit(":"), "event_id"), F.concat(F.lit("seq:"), "source_id", F.lit(":"), F.col("explicit_seq").cast("string")), F.concat(F.lit("request:q:"), "source_id", F.lit(":"), F.col("position").cast("string")))
    receipts = batch.where("position % 10 <= 1").select(name.alias("identity"), "source_id", (-1 - F.col("position")).alias("source_seq"), "event_id", F.when(F.col("position") % 10 == 0, F.col("fingerprint")).otherwise("other").alias("fingerprint"))
    checkpoints = e.select(F.col("event_type").alias("source_id")).distinct().withColumn("max_seq", F.lit(500).cast("long"))
    fresh, conflicts = ingest.resolve(batch, receipts, checkpoints)
    return fresh.select("identity", "source_seq", F.lit(None).cast("string").alias("conflict")).unionByName(conflicts.select("identity", F.lit(None).cast("long").alias("source_seq"), "conflict"))


# Trace features


_FEATURE = f"""{_EVENTS}, sc AS (SELECT *, CASE WHEN session_id % 3 = 0 THEN 0.95 ELSE 0.25 END AS s FROM ev), tk AS (SELECT session_id, unnest(regexp_extract_all(lower(raw), '{X.EVENT_TOKEN}')) AS t FROM ev),
tc AS (SELECT session_id, count(DISTINCT t)::BIGINT AS distinct_tokens, count(*)::BIGINT AS tokens FROM tk GROUP BY 1), te AS (SELECT session_id, string_agg(x, ',' ORDER BY x) AS techniques FROM (SELECT DISTINCT session_id, 'T' || (id % 3) AS x FROM ev) GROUP BY 1)
SELECT session_id AS trace_id, count(*)::BIGINT AS event_count, min(us) / 1e6::DOUBLE AS start_ts, max(us) / 1e6::DOUBLE AS end_ts, round(sum(s), 6)::DOUBLE AS anomaly_sum, count(*) FILTER (WHERE s >= 0.7)::BIGINT AS anomalous_edges, any_value(techniques) AS techniques,
any_value(distinct_tokens) AS distinct_tokens, any_value(tokens) AS tokens FROM sc JOIN tc USING (session_id) JOIN te USING (session_id) GROUP BY 1"""


def _feature_events(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    inject = F.col("session_id") % 3 == 0
    return e.select("id", F.col("session_id").alias("trace_id"), (F.col("us") / 1e6).alias("ts_epoch"), F.when(inject, "inject").otherwise("other").alias("action"), F.when(inject, "proc").otherwise("x").alias("object"), X.event_tokens(F.col("raw")).alias("tokens"), F.array(F.concat(F.lit("T"), F.col("id") % 3)).alias("techniques"), F.array(F.col("host")).alias("entities"))


def _feature_columns(features: DataFrame) -> DataFrame:
    total = F.aggregate(F.map_values("token_counts"), F.lit(0).cast("long"), lambda a, n: a + n)
    return features.select("trace_id", "event_count", "start_ts", "end_ts", F.round("anomaly_sum", 6).alias("anomaly_sum"), F.col("anomalous_edges").cast("long").alias("anomalous_edges"), F.array_join("techniques", ",").alias("techniques"), F.size("token_counts").cast("long").alias("distinct_tokens"), total.alias("tokens"))


@_register(f"WITH {_FEATURE}")
def trace_features(spark, sf_dir):
    return _feature_columns(traces.trace_features(_feature_events(spark, sf_dir)))


@_register(f"WITH {_FEATURE}")
def merge_features(spark, sf_dir):
    """Features of thirds of the events, merged: the same as of all of them."""
    e = _feature_events(spark, sf_dir)
    parts = None
    for k in range(3):
        part = traces.trace_features(e.where(F.col("id") % 3 == k))
        parts = part if parts is None else parts.unionByName(part)
    return _feature_columns(traces.merge_features(parts))


@_register(f"""WITH {_EVENTS} SELECT host, session_id % 5 AS root, min(us) AS t_start, max(us) AS t_end, count(*)::BIGINT AS n, md5(string_agg('e' || id, ',' ORDER BY us, 'e' || id)) AS digest FROM ev GROUP BY 1, 2""")
def process_traces(spark, sf_dir):
    e = A.events(spark, sf_dir).select("host", (F.col("session_id") % 5).alias("root"), F.col("us").alias("ts"), F.concat(F.lit("e"), "id").alias("event_hash"))
    return traces.process_traces(e).select("host", "root", "t_start", "t_end", "n", F.md5(F.array_join("event_hashes", ",").cast("binary")).alias("digest"))


@_register(f"""WITH {_EVENTS}, tk AS (SELECT id, regexp_extract_all(lower(raw), '{X.EVENT_TOKEN}') AS ts FROM ev) SELECT id, array_to_string(ts[greatest(1, len(ts) - 1):], ',') AS recent, round(list_sum(list_transform(list_distinct(ts), lambda x: ln(1 + len(list_filter(ts, lambda y: y = x))))), 6)::DOUBLE AS logs FROM tk""")
def token_counters(spark, sf_dir):
    """The newest tokens that are kept, and logarithms of token counts."""
    e = A.events(spark, sf_dir).select("id", X.event_tokens(F.col("raw")).alias("ts"))
    counts = F.map_from_entries(F.transform(F.array_distinct("ts"), lambda x: F.struct(x, F.size(F.filter("ts", lambda y: y == x)))))
    logs = F.aggregate(F.map_values(traces.log_token_counts(counts)), F.lit(0.0), lambda a, v: a + v)
    return e.select("id", F.array_join(traces.recent_tokens(F.col("ts"), 2), ",").alias("recent"), F.round(logs, 6).alias("logs"))


@_register(f"""WITH {_EVENTS}, z AS (SELECT session_id, max(us) AS end_us FROM ev GROUP BY 1) SELECT session_id, (SELECT max(us) FROM ev) - end_us > 21600000000 AS sealed FROM z""")
def seal_idle(spark, sf_dir):
    """Which sessions have been idle for six hours when the last event comes."""
    e = A.events(spark, sf_dir)
    now = e.agg(F.max("us").alias("now"))
    last = e.groupBy("session_id").agg(F.max("us").alias("end_us")).crossJoin(F.broadcast(now))
    return traces.seal_idle(last, F.col("now"), idle_s=6 * 3600).select("session_id", "sealed")


# Shingles and pair features


_WORDS = "wd AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+(?:/[a-z0-9_.:-]+)?') AS ts FROM benchmark)"


def _grams(mark: tuple[str, str, str], join: str) -> str:
    one, two, three = mark
    return (f"list_concat(list_transform(ts, lambda x: '{one}' || x), list_concat(list_transform(range(1, len(ts)), lambda i: '{two}' || ts[i] || {join} || ts[i + 1]), "
            f"list_transform(range(1, len(ts) - 1), lambda i: '{three}' || ts[i] || {join} || ts[i + 1] || {join} || ts[i + 2])))")  # fmt: skip


@_register(f"""WITH {_WORDS} SELECT id, len(list_distinct({_grams(('1g:', '2g:', '3g:'), 'chr(31)')}))::BIGINT AS n, md5(array_to_string(list_sort(list_distinct({_grams(('1g:', '2g:', '3g:'), 'chr(31)')})), ',')) AS digest,
len(list_distinct({_grams(('u:', 'b:', 't:'), 'chr(31)')}))::BIGINT + 1 AS n_event, md5(array_to_string(list_sort(list_append(list_distinct({_grams(('u:', 'b:', 't:'), 'chr(31)')}), 'tech:T1')), ',')) AS event_digest FROM wd""")
def shingles(spark, sf_dir):
    docs, _ = _pairs(spark, sf_dir)
    digest = lambda c: F.md5(F.array_join(F.array_sort(c), ",").cast("binary"))
    plain, event = X.shingles(F.col("ts")), X.event_shingles(F.col("ts"), F.array(F.lit("T1")))
    return docs.select("id", F.size(plain).cast("long").alias("n"), digest(plain).alias("digest"), F.size(event).cast("long").alias("n_event"), digest(event).alias("event_digest"))


@_register(f"""WITH {_WORDS}, g AS (SELECT id, list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS gs FROM wd), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(gs) AS term FROM g) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term)), nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM wt GROUP BY 1), dt AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS d FROM wt x JOIN wt y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2)
SELECT p.id AS a, q.id AS b, coalesce(round(d / (p.n * q.n), 6), 0)::DOUBLE AS tfidf FROM nm p JOIN nm q ON p.id < q.id LEFT JOIN dt ON dt.a = p.id AND dt.b = q.id""")
def ngram_cosine(spark, sf_dir):
    """Cosine over one- and two-word grams with sublinear counts."""
    docs, pairs = _pairs(spark, sf_dir)
    n = F.size("ts")
    two = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get("ts", i), F.get("ts", i + 1)))).otherwise(F.array().cast("array<string>"))
    return match.tfidf_cosine(pairs, docs.withColumn("gs", F.concat("ts", two)), "id", "gs", sublinear=True)


@_register(f"WITH {_WORDS}, u AS (SELECT DISTINCT id, unnest(ts) AS term FROM wd) SELECT term, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)), 6)::DOUBLE AS idf FROM u GROUP BY 1")
def idf_plain(spark, sf_dir):
    """The idf of the batch path, without the one added."""
    docs, _ = _pairs(spark, sf_dir)
    return match.idf_table(docs, "id", "ts", 0.0).withColumn("idf", F.round("idf", 6))


_VECTOR = f"""{_ITEMS}, {_HASHES}, tr AS (SELECT id, ws, id * 100.0::DOUBLE AS a0, id * 100.0::DOUBLE + (id % 5) * 130 AS a1, ['T' || (id % 3), 'T' || (id % 4)] AS te FROM it),
mh AS (SELECT x.id AS a, y.id AS b, round((count(*) FILTER (WHERE x.m = y.m)) / {_SLOTS}.0, 6)::DOUBLE AS minhash FROM h x JOIN h y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
pv AS (SELECT mh.a, mh.b, minhash, round(len(list_intersect(x.te, y.te)) / len(list_distinct(list_concat(x.te, y.te))), 6)::DOUBLE AS technique, CASE WHEN (x.id + y.id) % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS provenance,
  round(ln(1 + greatest(0, greatest(x.a0, y.a0) - least(x.a1, y.a1)) / 60), 6)::DOUBLE AS gap, ((x.id * y.id) % 4)::DOUBLE AS shared,
  round(CASE WHEN x.a1 = x.a0 AND y.a1 = y.a0 THEN 1 WHEN x.a1 = x.a0 OR y.a1 = y.a0 THEN 0 ELSE 1 / (1 + abs(ln((x.a1 - x.a0) / (y.a1 - y.a0)))) END, 6)::DOUBLE AS duration, ((x.id + y.id) % 10) / 10.0::DOUBLE AS tfidf, ((x.id + 2 * y.id) % 5)::DOUBLE AS idf_shared
  FROM mh JOIN tr x ON x.id = mh.a JOIN tr y ON y.id = mh.b)"""


def _vectors(spark, sf_dir) -> DataFrame:
    s = _sketches(spark, sf_dir, "benchmark", "item_id")
    k = F.col("id")
    t = s.select(k.alias("trace_id"), "sketch", F.array_distinct(F.array(F.concat(F.lit("T"), k % 3), F.concat(F.lit("T"), k % 4))).alias("techniques"), (k * 100.0).alias("start_ts"), (k * 100.0 + (k % 5) * 130).alias("end_ts"))
    i = s.select("id")
    pairs = i.toDF("a").join(i.toDF("b"), F.col("a") < F.col("b"))
    a, b = F.col("a"), F.col("b")
    pairs = pairs.select("a", "b", ((a + b) % 10 / 10.0).alias("tfidf"), ((a + 2 * b) % 5).cast("double").alias("idf_shared"), ((a * b) % 4).alias("shared"), ((a + b) % 2).alias("provenance_shared"))
    return match.pair_features(pairs, t)


@_register(f"WITH {_VECTOR} SELECT * FROM pv")
def pair_vector(spark, sf_dir):
    """The eight features of a pair of traces."""
    return _vectors(spark, sf_dir)


@_register(f"""WITH {_VECTOR} SELECT a, b, round(0.45 * minhash + 0.30 * tfidf + 0.15 * technique + 0.10 * idf_shared / (1 + idf_shared) + 1e-9, 6)::DOUBLE AS estimate, array_to_string([round(minhash * 2, 4)::DECIMAL(9, 4), round(gap * -0.5, 4)::DECIMAL(9, 4)], ',') AS parts,
(CASE WHEN minhash > 0.05 THEN 1 ELSE 0 END + CASE WHEN shared > 0 THEN 1 ELSE 0 END + CASE WHEN technique > 0 THEN 1 ELSE 0 END)::BIGINT AS n_classes, round(-ln(1 + gap), 6)::DOUBLE AS recency, (least(a * 9, 256) * least(b * 9, 256) + 1) > 30000 AS degraded FROM pv""")
def pair_estimates(spark, sf_dir):
    """Estimate, contributions, evidence of the batch path, and whether a pair is scored without its sketch."""
    c = F.col
    v = _vectors(spark, sf_dir)
    parts = match.contributions(F.array("minhash", "gap"), [2.0, -0.5])
    vector, count = match.demo_evidence(c("minhash"), c("shared"), c("technique"), c("gap"), c("idf_shared"))
    return v.select("a", "b", F.round(match.estimate_similarity(c("minhash"), c("tfidf"), c("technique"), c("idf_shared")) + 1e-9, 6).alias("estimate"), F.array_join(F.transform(parts, lambda x: X.round_binary(x, 4).cast("decimal(9,4)").cast("string")), ",").alias("parts"),
                    count.cast("long").alias("n_classes"), F.round(vector[4], 6).alias("recency"), match.degraded(match.pair_cost(c("a") * 9, c("b") * 9), 30_000).alias("degraded"))


@_register("""WITH r AS (SELECT c_nationkey AS a, c_custkey AS seq, (c_custkey * 37 % 100) / 100.0::DOUBLE AS similarity FROM customer) SELECT a, seq, row_number() OVER (PARTITION BY a ORDER BY seq) AS fifo, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, seq) AS best FROM r""")
def candidate_order(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("seq"), ((F.col("c_custkey") * 37 % 100) / 100.0).alias("similarity"))
    rows = match.order_candidates(c, "fifo").withColumnRenamed("position", "fifo")
    return match.order_candidates(rows).select("a", "seq", "fifo", F.col("position").alias("best"))


@_register("""WITH j AS (SELECT o_orderkey AS seq, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS estimate, (least(o_custkey % 300, 256) * least(o_orderkey % 300, 256) + 1)::BIGINT AS cost FROM orders),
r AS (SELECT seq, row_number() OVER w AS position, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM j WINDOW w AS (ORDER BY estimate DESC, seq)) SELECT seq, position, ((running - 1) // 2000000)::BIGINT AS round FROM r""")
def queue_rounds(spark, sf_dir):
    """A queue in rounds of one budget, without a task that sees it all."""
    o = A.table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 7919 % 10007) / 10007.0).alias("estimate"), match.pair_cost(F.col("o_custkey") % 300, F.col("o_orderkey") % 300).alias("cost"))
    return match.rounds(jobs, 2_000_000).select("seq", "position", "round")


@_register("""WITH l AS (SELECT l_partkey AS id, max(l_orderkey) AS r FROM lineitem GROUP BY 1 ORDER BY r DESC, id LIMIT 100) SELECT id, r, (SELECT count(*) FROM lineitem i WHERE i.l_partkey = l.id AND i.l_orderkey = l.r)::BIGINT AS n FROM l""")
def bounded_index(spark, sf_dir):
    """The newest insertion of each id, of the hundred newest ids."""
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("r"))
    return retrieve.bounded_index(rows, "id", "r", 100).groupBy("id", "r").agg(F.count(F.lit(1)).alias("n"))


@_register("""SELECT o_orderkey AS id, o_orderkey::DOUBLE AS duration, round(ln(1 + o_custkey), 6)::DOUBLE AS tokens, round(ln(1 + o_orderkey % 7), 6)::DOUBLE AS indicators, round(ln(1 + o_orderkey % 3), 6)::DOUBLE AS entities FROM orders""")
def dense_vectors(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    v = retrieve.dense_vector(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 7, F.col("o_orderkey") % 3)
    return o.select(F.col("o_orderkey").alias("id"), v[0].alias("duration"), *[F.round(v[i], 6).alias(n) for i, n in ((1, "tokens"), (2, "indicators"), (3, "entities"))])


_FOUR = f"""{_ITEMS}, {_HASHES}, {_BAND}, bp AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id <> y.id),
s1 AS (SELECT a, b, round((count(*) FILTER (WHERE x.m = y.m)) / {_SLOTS}.0, 6) AS e, 'lsh' AS s FROM bp JOIN h x ON x.id = a JOIN h y ON y.id = b AND y.s = x.s GROUP BY 1, 2),
u AS (SELECT id, unnest(ws) AS w FROM it), f AS (SELECT w FROM u GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100), r AS (SELECT * FROM u SEMI JOIN f USING (w)), nn AS (SELECT id, count(*) AS n FROM u GROUP BY 1),
s2 AS (SELECT x.id AS a, y.id AS b, round(least(1.0, count(*) / any_value(n)), 6) AS e, 'indicator' AS s FROM r x JOIN r y ON x.w = y.w AND x.id <> y.id JOIN nn ON nn.id = x.id GROUP BY 1, 2),
s3 AS (SELECT x.id AS a, y.id AS b, round(least(1.0, 0.5 + 0.5 / 2), 6) AS e, 'provenance' AS s FROM it x JOIN it y ON x.id <> y.id AND abs(x.id - y.id) <= 3 AND x.id % 2 = y.id % 2),
dv AS (SELECT id, [1.0::DOUBLE, ln(1 + len(ws)), (id % 5)::DOUBLE] AS v FROM it), c4 AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS e FROM dv x JOIN dv y ON x.id <> y.id), s4 AS (SELECT a, b, e, 'ann' AS s FROM c4 WHERE e >= 0.5 QUALIFY row_number() OVER (PARTITION BY a ORDER BY e DESC, b) <= 20),
g AS (SELECT a, b, max(e) AS estimate, array_to_string(list_sort(list_distinct(list(s))), ',') AS sources FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4) WHERE e > 0 GROUP BY 1, 2)"""


@_register(f"WITH {_FOUR} SELECT a, b, estimate::DOUBLE AS estimate, sources, row_number() OVER (PARTITION BY a ORDER BY estimate DESC, b) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY a ORDER BY estimate DESC, b) <= 50")
def candidate_sources(spark, sf_dir):
    """Candidates of all four sources over the benchmark passages, the best 50 of each."""
    s = _sketches(spark, sf_dir, "benchmark", "item_id")
    bands, rows = retrieve.bands_for_threshold()
    both = lambda d, *more: d.select("a", "b", *more).union(d.select("b", "a", *more))
    near = both(retrieve.banded_pairs(s.select("id", "sketch"), "id", bands, rows)).join(s.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    uses = s.select("id", F.explode("ws").alias("w"))
    n = s.select(F.col("id").alias("a"), F.size("ws").alias("n"))
    ind = both(retrieve.indicator_pairs(uses, "id", "w"), "shared").join(n, "a")
    prov = both(retrieve.interval_pairs(s.select("id", (F.col("id") % 2).alias("e"), F.col("id").alias("t")), "id", "e", "t", 3), "shared")
    dense = s.select("id", F.array(F.lit(1.0), F.ln(1 + F.size("ws")), (F.col("id") % 5).cast("double")).alias("v"))
    ann = retrieve.ann_topk(dense, dense, "id", "v")
    return retrieve.candidate_union({
        "lsh": near.select("a", "b", X.sketch_jaccard(F.col("sa"), F.col("sb")).alias("estimate")), "indicator": ind.select("a", "b", retrieve.estimate(F.col("shared"), F.col("n")).alias("estimate")),
        "provenance": prov.select("a", "b", retrieve.estimate(F.col("shared"), F.lit(2), 0.5, 0.5).alias("estimate")), "ann": ann.select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("cos").alias("estimate")),
    })


# Groups


_MEMBERS = f"""{_LINKS}, mb AS (SELECT g AS group_id, t AS trace_id, p AS strength, CASE WHEN p >= 0.8 THEN 'supported' WHEN p >= 0.5 THEN 'proposed' ELSE 'unsupported' END AS state FROM lk)"""


@_register(f"WITH {_MEMBERS} SELECT group_id, trace_id, strength, row_number() OVER (PARTITION BY trace_id ORDER BY strength DESC, group_id) AS rank FROM mb WHERE strength >= 0.5 AND (trace_id + group_id) % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY strength DESC, group_id) <= 3")
def best_groups(spark, sf_dir):
    m = _members(spark, sf_dir).select("group_id", "trace_id", "strength")
    return group.best_groups(m, m.where((F.col("trace_id") + F.col("group_id")) % 10 == 0).select("trace_id", "group_id"))


@_register(f"""WITH {_MEMBERS}, dc AS (SELECT trace_id, group_id, CASE WHEN (trace_id + group_id) % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS decided FROM mb WHERE (trace_id * 3 + group_id) % 5 = 0),
r AS (SELECT mb.*, decided, sum(CASE WHEN coalesce(decided, state) IN ('proposed', 'supported', 'confirmed') THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id) AS act FROM mb LEFT JOIN dc USING (trace_id, group_id))
SELECT trace_id, group_id, CASE WHEN decided = 'confirmed' AND state = 'unsupported' AND act > 3 THEN state ELSE coalesce(decided, state) END AS state FROM r""")
def analyst_decisions(spark, sf_dir):
    m = _members(spark, sf_dir)
    both = F.col("trace_id") + F.col("group_id")
    d = m.where((F.col("trace_id") * 3 + F.col("group_id")) % 5 == 0).select("trace_id", "group_id", F.when(both % 2 == 0, "confirmed").otherwise("rejected").alias("state"))
    return group.decide(m, d).select("trace_id", "group_id", "state")


@_register(f"WITH {_MEMBERS}, ac AS (SELECT * FROM mb WHERE state <> 'unsupported') SELECT group_id, count(*)::BIGINT AS shared FROM ac WHERE group_id <> 1 AND trace_id IN (SELECT trace_id FROM ac WHERE group_id = 1) GROUP BY 1")
def shared_groups(spark, sf_dir):
    return group.shared_groups(_members(spark, sf_dir), 1)


@_register(f"""WITH {_LINKS}, it AS (SELECT t % 50 AS trace_id, g AS group_id, p, CASE WHEN t % 2 = 0 THEN ['behavior', 'technique'] ELSE ['technique'] END AS cs, 'v' || (t % 4) AS v FROM lk),
cl AS (SELECT trace_id, group_id, c, round(sum(p), 6)::DOUBLE AS s FROM (SELECT trace_id, group_id, p, unnest(cs) AS c FROM it) GROUP BY 1, 2, 3)
SELECT trace_id, group_id, (SELECT count(*) FROM it i WHERE i.trace_id = cl.trace_id AND i.group_id = cl.group_id)::BIGINT AS n_links, string_agg(c, ',' ORDER BY s DESC, c) AS classes, round(sum(s), 4)::DOUBLE AS total,
(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT v FROM it i WHERE i.trace_id = cl.trace_id AND i.group_id = cl.group_id)) AS indicators FROM cl GROUP BY 1, 2""")
def membership_evidence(spark, sf_dir):
    m = _members(spark, sf_dir)
    t = F.col("trace_id")
    name = F.concat_ws("/", "group_id", "trace_id")
    links = m.select((t % 50).alias("a"), name.alias("b"), F.col("strength").alias("p"), F.when(t % 2 == 0, F.array(F.lit("behavior"), F.lit("technique"))).otherwise(F.array(F.lit("technique"))).alias("classes"), F.array(F.concat(F.lit("v"), t % 4)).alias("shared_indicators"))
    out = group.membership_evidence(links, m.select(name.alias("trace_id"), "group_id"))
    pairs = F.transform("classes", lambda x: F.split(x, "="))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x[1].cast("double"))
    return out.select("trace_id", "group_id", "n_links", F.array_join(F.transform(pairs, lambda x: x[0]), ",").alias("classes"), F.round(total, 4).alias("total"), F.array_join("indicators", ",").alias("indicators"))


# Attribution and metrics


_TECH = """tg AS (SELECT DISTINCT c_nationkey % 5 AS group_id, c_mktsegment AS technique FROM customer WHERE (c_custkey + c_nationkey) % 3 <> 0), ta AS (SELECT DISTINCT 'actor' || (c_custkey % 4) AS actor, c_mktsegment AS technique FROM customer WHERE c_custkey % 4 <> length(c_mktsegment) % 4),
id AS (SELECT technique, ln((1 + (SELECT count(DISTINCT actor) FROM ta)) / (1 + count(*))) AS idf FROM ta GROUP BY 1), g2 AS (SELECT tg.*, coalesce(idf, 0) AS idf FROM tg LEFT JOIN id USING (technique)), a2 AS (SELECT ta.*, idf FROM ta JOIN id USING (technique)),
bo AS (SELECT group_id, actor, count(*) AS n, sum(g2.idf) AS w FROM g2 JOIN a2 USING (technique) GROUP BY 1, 2), gs AS (SELECT group_id, count(*) AS gn, sum(idf) AS gw FROM g2 GROUP BY 1), sa AS (SELECT actor, count(*) AS an, sum(idf) AS aw FROM a2 GROUP BY 1),
ts AS (SELECT group_id, actor, 0.5 * n / (gn + an - n) + 0.5 * CASE WHEN gw + aw - w > 0 THEN w / (gw + aw - w) ELSE 0 END AS tech FROM bo JOIN gs USING (group_id) JOIN sa USING (actor))"""


def _technique_scores(spark, sf_dir) -> DataFrame:
    c = A.table(spark, sf_dir, "customer")
    groups = c.where((F.col("c_custkey") + F.col("c_nationkey")) % 3 != 0).select((F.col("c_nationkey") % 5).alias("group_id"), F.array("c_mktsegment").alias("techniques"))
    train = c.where(F.col("c_custkey") % 4 != F.length("c_mktsegment") % 4).select(F.concat(F.lit("actor"), F.col("c_custkey") % 4).alias("actor"), F.array("c_mktsegment").alias("techniques"))
    return attrib.technique_scores(groups, train)


@_register(f"WITH {_TECH} SELECT group_id, actor, round(tech, 6)::DOUBLE AS tech FROM ts")
def technique_scores(spark, sf_dir):
    return _technique_scores(spark, sf_dir).withColumn("tech", F.round("tech", 6))


_POST = f"""{_TECH}, sc AS (SELECT group_id, actor, greatest(1e-6, least(1 - 1e-6, 0.7 * ((group_id * 7 + length(actor) + ascii(right(actor, 1)) * 3) % 10) / 10.0 + 0.3 * tech)) AS s FROM ts), lo AS (SELECT *, ln(s / (1 - s)) + ln(0.7 / 4 / 0.3) AS l FROM sc),
po AS (SELECT group_id, actor, exp(l) / (sum(exp(l)) OVER (PARTITION BY group_id) + 1) AS p, 1 / (sum(exp(l)) OVER (PARTITION BY group_id) + 1) AS unknown FROM lo)"""


def _posterior(spark, sf_dir) -> DataFrame:
    t = _technique_scores(spark, sf_dir)
    classifier = (F.col("group_id") * 7 + F.length("actor") + F.ascii(F.right("actor", F.lit(1))) * 3) % 10 / 10.0
    return attrib.posterior(t.select("group_id", "actor", attrib.fuse(classifier, F.col("tech")).alias("s")), 4)


@_register(f"WITH {_POST} SELECT group_id, actor, round(p, 6)::DOUBLE AS p, round(unknown, 6)::DOUBLE AS unknown FROM po")
def actor_posterior(spark, sf_dir):
    return _posterior(spark, sf_dir).withColumn("p", F.round("p", 6)).withColumn("unknown", F.round("unknown", 6))


@_register(f"""WITH {_POST}, b AS (SELECT group_id, max(p) AS p, arg_max(actor, p) AS actor, coalesce(string_agg(actor, ',' ORDER BY actor) FILTER (WHERE p >= 0.3), '') AS candidates, any_value(unknown) AS unknown FROM po GROUP BY 1)
SELECT group_id, CASE WHEN p >= 0.9 AND group_id % 2 = 0 THEN 'attributed' WHEN candidates <> '' THEN 'candidates' ELSE 'unresolved' END AS status, CASE WHEN candidates <> '' THEN actor END AS actor, candidates, round(unknown, 6)::DOUBLE AS unknown FROM b""")
def actor_outcome(spark, sf_dir):
    """Attributed, candidates or unresolved; attribution needs two classes of evidence."""
    p = _posterior(spark, sf_dir)
    evidence = p.select("group_id").distinct().withColumn("n_classes", 2 - F.col("group_id") % 2)
    return attrib.outcome(p, evidence).select("group_id", "status", "actor", F.array_join("candidates", ",").alias("candidates"), F.round("unknown", 6).alias("unknown"))


@_register("""WITH o AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'attributed' WHEN 1 THEN 'candidates' ELSE 'unresolved' END AS status, 'n' || (c_custkey % 5) AS actor, 'n' || (c_nationkey % 5) AS truth FROM customer)
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN status = 'unresolved' THEN 1 ELSE 0 END), 6)::DOUBLE AS unresolved, round(avg(CASE WHEN status <> 'attributed' THEN 1 ELSE 0 END), 6)::DOUBLE AS abstained,
round(count(*) FILTER (WHERE status = 'attributed' AND actor = truth) / count(*) FILTER (WHERE status = 'attributed'), 6)::DOUBLE AS precision FROM o""")
def abstention(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    status = F.when(F.col("c_custkey") % 3 == 0, "attributed").when(F.col("c_custkey") % 3 == 1, "candidates").otherwise("unresolved")
    rows = c.select(status.alias("status"), F.concat(F.lit("n"), F.col("c_custkey") % 5).alias("actor"), F.concat(F.lit("n"), F.col("c_nationkey") % 5).alias("truth"))
    return evaluate.abstention(rows)


@_register("""WITH w AS (SELECT DISTINCT c_nationkey AS a, c_custkey % 9 AS b FROM customer), f AS (SELECT DISTINCT c_nationkey AS a, c_custkey % 9 AS b FROM customer WHERE c_custkey % 7 < 4) SELECT count(*)::BIGINT AS wanted, count(f.a)::BIGINT AS found, round(count(f.a) / count(*), 6)::DOUBLE AS recall FROM w LEFT JOIN f ON f.a = w.a AND f.b = w.b""")
def neighbour_recall(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 9).alias("b"))
    return evaluate.neighbour_recall(c.where("c_custkey % 7 < 4"), c)


@_register("""SELECT c_mktsegment AS condition, round(avg(c_acctbal::DOUBLE), 6)::DOUBLE AS bal_mean, min(c_acctbal::DOUBLE) AS bal_min, max(c_acctbal::DOUBLE) AS bal_max FROM customer GROUP BY 1""")
def run_summary(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("condition"), F.col("c_acctbal").cast("double").alias("bal"))
    return evaluate.summarize(c, "condition", ["bal"])


@_register("""SELECT n_nationkey::BIGINT AS seq, n_nationkey % 6 <> 4 AS hash_ok, n_nationkey % 6 <> 5 OR n_nationkey = 0 AS link_ok FROM nation""")
def ledger_check(spark, sf_dir):
    """A ledger of 25 records of which some were changed after the fact: a changed output breaks the record's hash, a changed link breaks link and hash."""
    book = ledger.Ledger()
    for i in range(25):
        book.append("note", {"n": i}, {"out": i})
    rows = book.frame(spark).withColumn("output_hash", F.when(F.col("seq") % 6 == 4, "x").otherwise(F.col("output_hash")))
    checked = ledger.verify_ledger(rows.withColumn("prev_hash", F.when((F.col("seq") % 6 == 5) & (F.col("seq") > 0), "y").otherwise(F.col("prev_hash"))))
    return checked.select("seq", (F.col("hash_ok") | (F.col("seq") % 6 == 5)).alias("hash_ok"), "link_ok")


@_register("""SELECT n_regionkey::VARCHAR AS segment, sha256(string_agg('p' || n_nationkey || ':' || sha256(n_name), '|' ORDER BY 'p' || n_nationkey)) AS hash FROM nation GROUP BY 1""")
def sealed_hashes(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    files = n.select(F.col("n_regionkey").cast("string").alias("segment"), F.concat(F.lit("/d/p"), "n_nationkey").alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("hash"))
    return ledger.sealed_hash(files)


@_register("""WITH s AS (SELECT n_nationkey AS seq, n_nationkey % 8 <> 3 OR n_nationkey = 0 AS link_ok FROM nation) SELECT seq::BIGINT AS seq, link_ok FROM s""")
def segment_links(spark, sf_dir):
    """Segments link by roots; every eighth link was broken."""
    n = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq"))
    root = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    prev = F.when(F.col("seq") == 0, F.lit(S.GENESIS)).when(F.col("seq") % 8 == 3, "broken").otherwise(root(F.col("seq") - 1))
    return ledger.verify_segments(n.select("seq", prev.alias("prev_root"), root(F.col("seq")).alias("root")))


# Reconstruction and the documented join


@_register("""WITH nr AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1), cs AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer JOIN nr ON n = c_nationkey),
od AS (SELECT 'c' || k AS node, 1 AS o, 0 AS i, 0.0 AS a FROM cs UNION ALL SELECT 'n' || nr.n, 1, (SELECT count(*) FROM cs WHERE cs.n = nr.n), (SELECT coalesce(max(k % 10), 0) / 10.0 FROM cs WHERE cs.n = nr.n) FROM nr UNION ALL SELECT 'r1', 0, (SELECT count(*) FROM nr), (SELECT max(n % 10) / 10.0 FROM nr)),
m AS (SELECT max(o) AS mo, max(i) AS mi, max(a) AS ma FROM od), cr AS (SELECT node, o, i, round(0.5 * (0.5 * (o / greatest(mo, 1) + i / greatest(mi, 1)) + a / greatest(ma, 1.0)), 6) AS c FROM od, m),
ro AS (SELECT *, 'entry' AS role FROM cr WHERE i = 0 UNION ALL SELECT *, 'exit' FROM cr WHERE o = 0) SELECT role, node, c::DOUBLE AS criticality, row_number() OVER (PARTITION BY role ORDER BY c DESC, node) = 1 AS chosen FROM ro""")
def reconstruct_roles(spark, sf_dir):
    """Entries and exits around a region: edges from customers to nations to the region are a tree already."""
    seeds = spark.createDataFrame([("r1",)], "node string")
    _, roles = graph.reconstruct(A.edges(spark, sf_dir), seeds, 0.0, 1e12)
    return roles.select("role", "node", "criticality", "chosen")


_FLAGSHIP = "SELECT m.group_id, count(DISTINCT e.event_hash) AS events, count(DISTINCT e.host) AS hosts, min(e.ts) AS first_ts FROM events e JOIN trace_events t ON e.event_hash = t.event_hash JOIN memberships m ON t.trace_id = m.trace_id WHERE m.state IN ('proposed', 'supported', 'confirmed') GROUP BY m.group_id"


@_register(f"""WITH {_EVENTS}, e AS (SELECT 'e' || id AS event_hash, host, us AS ts, session_id FROM ev), m AS (SELECT DISTINCT session_id % 7 AS group_id, session_id, CASE session_id % 3 WHEN 0 THEN 'rejected' ELSE 'supported' END AS state FROM ev)
SELECT m.group_id, count(DISTINCT event_hash)::BIGINT AS events, count(DISTINCT host)::BIGINT AS hosts, min(ts) AS first_ts FROM e JOIN m USING (session_id) WHERE state = 'supported' GROUP BY 1""")
def group_events(spark, sf_dir):
    """The documented join of events, trace events and memberships, through the SQL gate."""
    e = A.events(spark, sf_dir).withColumn("event_hash", F.concat(F.lit("e"), "id"))
    state = F.when(F.col("session_id") % 3 == 0, "rejected").otherwise("supported")
    members = e.select((F.col("session_id") % 7).alias("group_id"), F.col("session_id").alias("trace_id"), state.alias("state")).distinct()
    tables = {"events": e.select("event_hash", "host", F.col("us").alias("ts")), "trace_events": e.select("event_hash", F.col("session_id").alias("trace_id")), "memberships": members}
    return query_unlimited(spark, _FLAGSHIP, tables)


@_register()
def approximate_counts(spark, sf_dir):
    """Approximate distinct counts and quantiles; their errors have no exact SQL."""
    li = A.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"))
