"""Registered queries of the engine with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import attrib, evaluate, graph, group, ledger, match, normalize, retrieve, search, traces, views
from ..operators.graph import cut
from ..sources import otlp, readers
from . import adapters as A
from .sqlgate import query_unlimited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views of the test tables that the SQL builds on.
_EVENTS = """ev AS (SELECT event_id AS id, 'h' || (user_id % 8) AS host, event_type AS source_id, event_id AS source_seq, user_id AS session_id, event_type AS action,
  props AS attributes, epoch_us(ts) AS us, concat_ws(' ', event_type, user_id::VARCHAR, value::DECIMAL(12,2)::VARCHAR, props) AS raw, value FROM events)"""
_SPANS = """sp AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, role AS service, 'turn.' || role AS action,
  turn * 1000.0::DOUBLE AS start_ms, length(text)::DOUBLE AS duration_ms, CASE WHEN length(text) % 7 = 0 THEN 'error' ELSE 'ok' END AS status, text FROM conversations)"""
_USES = """us AS (SELECT l_orderkey AS trace_id, l_partkey AS indicator, l_suppkey AS entity, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::BIGINT AS day FROM lineitem)"""
_EDGES = """ed AS (SELECT src, dst, action, (k * 60)::BIGINT AS ts, (k % 10) / 10.0::DOUBLE AS anomaly FROM (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, c_mktsegment AS action, c_custkey AS k FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', n_nationkey FROM nation))"""


def _register(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


def _sql_words(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# Scalars


_TAGS_SQL = f"""SELECT doc_id, (CASE WHEN {_sql_words('t', S.ERROR_WORDS)} THEN 1 ELSE 0 END + CASE WHEN {_sql_words('t', S.ATTACK_WORDS)} THEN 2 ELSE 0 END
  + CASE WHEN {_sql_words('a', S.NETWORK_ACTIONS)} THEN 4 ELSE 0 END + CASE WHEN {_sql_words('a', S.FILE_ACTIONS)} THEN 8 ELSE 0 END
  + CASE WHEN {_sql_words('a', S.AUTH_WORDS)} OR {_sql_words('t', S.AUTH_WORDS)} THEN 16 ELSE 0 END)::BIGINT AS flux_tags
FROM (SELECT doc_id, lower(text) AS t, lower(source) AS a FROM documents)"""


@_register(_TAGS_SQL)
def flux_tags_documents(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.flux_tags(F.col("source"), F.col("text"), F.create_map().cast("map<string,string>")).alias("flux_tags"))


def _sclc_sql(column: str) -> str:
    out = column
    for mark, pattern in X.SCLC:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        body = pattern.removeprefix("(?i)").replace("'", "''")
        out = f"regexp_replace({out}, '{body}', '{mark}', '{flags}')"
    return out


@_register(f"SELECT page_id, md5({_sclc_sql('html')}) AS digest, {_sclc_sql('url')} AS url FROM pages")
def sclc_normalize(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(X.normalize_sclc(F.col("html")).cast("binary")).alias("digest"), X.normalize_sclc(F.col("url")).alias("url"))


@_register(rf"WITH {_EVENTS} SELECT id, sha256(lower(trim(action)) || '|entity|' || trim(regexp_replace({_sclc_sql('raw')}, '\s+', ' ', 'g'))) AS template_hash FROM ev")
def template_hash(spark, sf_dir):
    return A.events(spark, sf_dir).select("id", X.template_hash(F.col("action"), F.lit("entity"), F.col("raw")).alias("template_hash"))


@_register(rf"""WITH {_EVENTS} SELECT id, 'session:' || host || ':' || session_id AS anchor, array_to_string(regexp_extract_all(lower(raw), '{X.EVENT_TOKEN}'), ' ') AS tokens FROM ev""")
def anchor_tokens(spark, sf_dir):
    e = A.events(spark, sf_dir)
    attrs = F.create_map(F.lit("session_id"), F.col("session_id").cast("string"))
    return e.select("id", normalize.anchor(F.col("host"), attrs, F.lit("")).alias("anchor"), F.array_join(X.event_tokens(F.col("raw")), " ").alias("tokens"))


@_register(f"""WITH {_EVENTS}, c AS (SELECT id, unnest(string_split(raw, '')) AS ch FROM ev), n AS (SELECT id, ch, count(*) AS k FROM c GROUP BY 1, 2),
t AS (SELECT *, sum(k) OVER (PARTITION BY id) AS s FROM n) SELECT id, round(-sum(k / s * log2(k / s)), 6) AS entropy FROM t GROUP BY id""")
def byte_entropy_ascii(spark, sf_dir):
    return A.events(spark, sf_dir).select("id", F.round(X.ascii_entropy(F.col("raw")), 6).alias("entropy"))


@_register()
def compression_deviation(spark, sf_dir):
    rows = A.events(spark, sf_dir).select("id", X.compression_deviation("raw").alias("d"))
    return rows.select("id", F.round("d.entropy", 6).alias("entropy"), F.round("d.ratio", 6).alias("ratio"), F.col("d.anomalous").alias("anomalous"))


_EDGE_SQL = "CASE " + " ".join(f"WHEN a = '{a}' AND kind = '{k}' THEN {v}" for (a, k), v in S.EDGE_SCORES.items()) + f" ELSE {S.EDGE_DEFAULT} END"


@_register(f"""SELECT n_nationkey::BIGINT AS id, {_EDGE_SQL}::DOUBLE AS score FROM (SELECT n_nationkey, ['connect','write','read','exec','modify'][n_nationkey % 5 + 1] AS a,
  CASE WHEN contains(o, 'raw_socket') THEN 'raw_socket' WHEN contains(o, 'sock') OR contains(o, ':') OR contains(o, 'http') OR contains(o, 'ip') THEN 'socket'
  WHEN contains(o, 'proc') OR contains(o, 'pid') THEN 'process' WHEN contains(o, 'mem') OR contains(o, 'shm') THEN 'memory' WHEN contains(o, 'reg') THEN 'registry' ELSE 'file' END AS kind
  FROM (SELECT n_nationkey, ['sock1','memory','/etc/x','proc/1','reg key','raw_socket'][n_nationkey % 6 + 1] AS o FROM nation))""")
def edge_scores(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("n_nationkey") % m + 1).cast("int"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), normalize.edge_score(pick(("connect", "write", "read", "exec", "modify"), 5), pick(("sock1", "memory", "/etc/x", "proc/1", "reg key", "raw_socket"), 6)).alias("score"))


@_register("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN left(md5(event_id::VARCHAR), 16) WHEN event_id % 3 = 1 THEN left(md5(event_id::VARCHAR), 16) ELSE 'other-' || event_id END AS span_id FROM events")
def otlp_ids(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    h = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 16)
    given = F.when(F.col("event_id") % 3 == 0, F.upper(h)).when(F.col("event_id") % 3 == 1, F.base64(F.unhex(h))).otherwise(F.concat(F.lit("Other-"), "event_id"))
    return e.select(F.col("event_id").alias("id"), otlp.normalize_id(given, 8).alias("span_id"))


# Search


@_register(f"""WITH {_EVENTS}, t AS (SELECT *, CASE WHEN contains(lower(raw), 'error') OR contains(lower(raw), 'err') THEN 1 ELSE 0 END + CASE WHEN contains(lower(raw), 'login') OR contains(lower(raw), 'su') THEN 16 ELSE 0 END AS m FROM ev)
SELECT id, raw FROM t WHERE contains(raw, '"k": 7') AND m & 17 <> 0 AND value > 20""")
def search_substring_mask(spark, sf_dir):
    e = A.events(spark, sf_dir).withColumn("flux_tags", X.flux_tags(F.col("action"), F.col("raw"), F.create_map().cast("map<string,string>")))
    return search.search(e, '"k": 7', "value > 20", S.ERROR | S.AUTH, None).select("id", "raw")


@_register("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE contains(lower(text), 'thereis') OR contains(lower(text), 'license')")
def search_trigram(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    grams = search.trigram_index(d, "doc_id", "text")
    postings = cut(grams.where(F.col("tri").isin(*search.grams_of("thereis"), *search.grams_of("license"))), "postings")  # one pass for both searches
    one = search.trigram_search(d, postings, "Thereis", "doc_id", "text")
    two = search.trigram_search(d, postings, "LICENSE", "doc_id", "text")
    return one.unionByName(two).dropDuplicates(["doc_id"]).select("doc_id", F.length("text").cast("long").alias("n"))


_BM25_SQL = r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+(?:/[a-z0-9_.:-]+)?') AS ts FROM documents),
l AS (SELECT id, len(ts) AS len FROM t), p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY 1, 2),
h AS (SELECT * FROM p WHERE term IN ('license', 'version', 'apache')), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS a FROM l)
SELECT h.id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.len / s.a))), 6)::DOUBLE AS score
FROM h JOIN d USING (term) JOIN l USING (id) CROSS JOIN s GROUP BY 1"""


@_register(_BM25_SQL)
def search_bm25(spark, sf_dir):
    postings, lengths = search.bm25_index(A.table(spark, sf_dir, "documents"), "doc_id", "text")
    return search.bm25(postings, lengths, "apache license version")


# Telemetry views


@_register(f"""WITH {_EVENTS} SELECT source_id AS service, count(*)::BIGINT AS events, count(*) FILTER (WHERE attributes LIKE '%"k": 1}}')::BIGINT AS errors, count(*) FILTER (WHERE value > 100)::BIGINT AS ai_calls FROM ev GROUP BY 1""")
def services_summary(spark, sf_dir):
    status = F.when(F.col("attributes").endswith('"k": 1}'), "error")
    out = views.services(A.events(spark, sf_dir), status=status, ai=F.col("value") > 100)
    return out.select("service", *[F.col(c).cast("long").alias(c) for c in ("events", "errors", "ai_calls")])


@_register(f"""WITH {_SPANS} SELECT trace_id, arg_min(service, start_ms) AS service, arg_min(action, start_ms) AS root, min(start_ms) AS start_ms,
round(greatest(arg_min(duration_ms, start_ms), max(start_ms) - min(start_ms) + arg_max(duration_ms, start_ms)), 2) AS duration_ms, count(*)::BIGINT AS spans,
count(*) FILTER (WHERE status = 'error')::BIGINT AS errors, CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'error' ELSE 'ok' END AS status,
array_to_string(list_sort(list_distinct(list(service))), ',') AS services FROM sp GROUP BY 1""")
def trace_summary(spark, sf_dir):
    out = views.trace_summary(A.spans(spark, sf_dir))
    return out.withColumn("spans", F.col("spans").cast("long")).withColumn("errors", F.col("errors").cast("long"))


@_register(f"""WITH RECURSIVE {_SPANS}, r AS (SELECT trace_id, span_id, 0 AS depth FROM sp WHERE parent_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, r.depth + 1 FROM sp s JOIN r ON s.trace_id = r.trace_id AND s.parent_id = r.span_id),
b AS (SELECT trace_id, min(start_ms) AS t0, max(start_ms + duration_ms) AS t1 FROM sp GROUP BY 1),
w AS (SELECT sp.trace_id, row_number() OVER (PARTITION BY sp.trace_id ORDER BY sp.span_id) AS position, r.depth, sp.span_id, least(99.0, round((start_ms - t0) / greatest(t1 - t0, 1e-9) * 100, 2)) AS o,
  greatest(1.0, round(duration_ms / greatest(t1 - t0, 1e-9) * 100, 2)) AS wd FROM sp JOIN r ON r.trace_id = sp.trace_id AND r.span_id = sp.span_id JOIN b ON b.trace_id = sp.trace_id)
SELECT trace_id, position::BIGINT AS position, depth::BIGINT AS depth, span_id, o::DOUBLE AS offset_pct, least(wd, 100 - o + 1)::DOUBLE AS width_pct FROM w""")
def trace_waterfall(spark, sf_dir):
    return views.waterfall(A.spans(spark, sf_dir))


@_register(f"""WITH {_SPANS} SELECT trace_id * 1000 + span_id AS id, service, 'model-' || (span_id % 3) AS model, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS tokens, start_ms AS ts FROM sp WHERE service = 'assistant' AND span_id % 3 = 1
ORDER BY ts DESC, id LIMIT 50""")
def ai_calls(spark, sf_dir):
    s = A.spans(spark, sf_dir)
    calls = s.select((F.col("trace_id") * 1000 + F.col("span_id")).alias("id"), "service", F.concat(F.lit("model-"), F.col("span_id") % 3).alias("model"), F.regexp_count("text", F.lit(r"[^\s]+")).cast("long").alias("tokens"), F.col("start_ms").alias("ts"))
    return views.ai_calls(calls, "assistant", "MODEL-1", 50)


@_register(f"""WITH {_EVENTS} SELECT id, source_id AS service, 'log.' || action AS action, us AS ts, CASE WHEN value > 50 THEN 'ERROR' ELSE 'INFO' END AS severity FROM ev WHERE source_id = 'error' AND value > 50 ORDER BY ts DESC, id LIMIT 100""")
def logs_filter(spark, sf_dir):
    e = A.events(spark, sf_dir)
    rows = e.select("id", F.col("source_id").alias("service"), F.concat(F.lit("log."), "action").alias("action"), F.col("us").alias("ts"), F.when(F.col("value") > 50, "ERROR").otherwise("INFO").alias("severity"))
    return views.logs(rows, service="error", severity="error", limit=100)


@_register(f"WITH {_EVENTS} SELECT source_id, max(source_seq) AS max_seq FROM ev GROUP BY 1")
def source_checkpoints(spark, sf_dir):
    return views.checkpoints(A.events(spark, sf_dir))


# Sessions and windows


@_register(f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY us, id))
SELECT id, session_id, sum(n) OVER (PARTITION BY session_id ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g""")
def sessionize_idle(spark, sf_dir):
    return traces.sessionize_idle(A.events(spark, sf_dir), "session_id", "us", "id", 6 * 3600).select("id", "session_id", "session")


@_register(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT id, session_id, us, row_number() OVER (PARTITION BY session_id ORDER BY us, id) AS k FROM ev),
r AS (SELECT id, session_id, us, k, us AS start, 0::BIGINT AS session FROM o WHERE k = 1 UNION ALL
  SELECT o.id, o.session_id, o.us, o.k, CASE WHEN o.us - r.us > 21600000000 OR o.us - r.start > 86400000000 THEN o.us ELSE r.start END, r.session + CASE WHEN o.us - r.us > 21600000000 OR o.us - r.start > 86400000000 THEN 1 ELSE 0 END
  FROM r JOIN o ON o.session_id = r.session_id AND o.k = r.k + 1) SELECT id, session_id, session FROM r""")
def sessionize_idle_max(spark, sf_dir):
    return traces.sessionize(A.events(spark, sf_dir), "session_id", "us", "id", 6 * 3600, 86400).select("id", "session_id", "session")


@_register(f"WITH {_EVENTS} SELECT (us // 900000000)::BIGINT AS win, action, count(*)::BIGINT AS n FROM ev GROUP BY 1, 2")
def tumbling_15m(spark, sf_dir):
    return A.events(spark, sf_dir).groupBy(traces.window_id(F.col("us") / 1e6).alias("win"), "action").agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH {_EVENTS} SELECT (us // 300000000 - k) * 300 AS start_s, count(*)::BIGINT AS n FROM ev, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1""")
def sliding_window(spark, sf_dir):
    e = A.events(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    rows = e.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_seconds("w.start").alias("start_s"), "n")


@_register(f"""WITH {_EVENTS}, d AS (SELECT *, row_number() OVER (PARTITION BY session_id, action, attributes ORDER BY id) AS k FROM ev) SELECT id, session_id, action FROM d WHERE k = 1""")
def dedupe_identity(spark, sf_dir):
    w = Window.partitionBy("session_id", "action", "attributes").orderBy("id")
    return A.events(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "session_id", "action")


# Sketches and candidates; the sketched sets are the distinct words of the documents


_ITEMS = "it AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+(?:/[a-z0-9_.:-]+)?')) AS ws FROM benchmark)"
_SLOTS = S.SKETCH_SLOTS
_BANDS, _ROWS = retrieve.bands_for_threshold()
_HASHES = f"""h AS (SELECT id, b * 4 + j AS s, min(substr(d, j * 16 + 1, 16)) AS m FROM (SELECT id, b, sha256(b || ':' || w) AS d FROM (SELECT id, unnest(ws) AS w FROM it), (SELECT unnest(range({_SLOTS // 4})) AS b)), (SELECT unnest(range(4)) AS j) GROUP BY id, b, j)"""
_SK = f"""it AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+(?:/[a-z0-9_.:-]+)?')) AS ws FROM documents), {_HASHES}"""
_BAND = f"k AS (SELECT id, s // {_ROWS} AS band, string_agg(m, ':' ORDER BY s) AS key FROM h GROUP BY 1, 2)"


def _words(spark, sf_dir, table: str, id_col: str) -> DataFrame:
    # few bytes are much work: texts are dealt to a set number of tasks, however few files hold them
    texts = A.table(spark, sf_dir, table).select(F.col(id_col).alias("id"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return texts.select("id", F.array_distinct(X.tokenize(F.col("text"))).alias("ws"))


def _sketches(spark, sf_dir, table: str = "documents", id_col: str = "doc_id") -> DataFrame:
    words = _words(spark, sf_dir, table, id_col).where(F.size("ws") > 0)
    return words.select("id", "ws", X.known_minhash(F.col("ws"), _SLOTS).alias("sketch"))


@_register(f"WITH {_SK} SELECT id, md5(array_to_string(list(m ORDER BY s), ',')) AS sketch FROM h GROUP BY id")
def minhash_signature(spark, sf_dir):
    """A digest of each document's 128 slots."""
    return _sketches(spark, sf_dir).select("id", F.md5(F.array_join("sketch", ",").cast("binary")).alias("sketch"))


@_register(f"""WITH {_SK}, {_BAND}, c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id < y.id)
SELECT a, b, (count(*) FILTER (WHERE x.m = y.m)) / {_SLOTS}.0::DOUBLE AS minhash FROM c JOIN h x ON x.id = a JOIN h y ON y.id = b AND y.s = x.s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE x.m = y.m) >= {_SLOTS // 2}""")
def minhash_jaccard_pairs(spark, sf_dir):
    """Pairs that share a band and at least half of their slots."""
    return retrieve.similar_pairs(_sketches(spark, sf_dir).select("id", "sketch"), "id", _BANDS, _ROWS, 0.5)


@_register(f"""WITH {_SK}, {_BAND} SELECT x.id AS a, y.id AS b, count(*)::BIGINT AS matched FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id < y.id GROUP BY 1, 2""")
def lsh_candidates(spark, sf_dir):
    return retrieve.banded_pairs(_sketches(spark, sf_dir).select("id", "sketch"), "id", _BANDS, _ROWS)


_PROBES = f"""n AS (SELECT h.id, k.band, e.hole, string_agg(h.m, ':' ORDER BY h.s) FILTER (WHERE h.s % {_ROWS} <> e.hole) AS key FROM k JOIN h ON h.id = k.id AND h.s // {_ROWS} = k.band, (SELECT unnest(range({_ROWS})) AS hole) e GROUP BY 1, 2, 3)"""


@_register(f"WITH {_SK}, {_BAND}, {_PROBES} SELECT DISTINCT x.id AS a, y.id AS b FROM n x JOIN n y ON x.band = y.band AND x.hole = y.hole AND x.key = y.key AND x.id < y.id")
def lsh_multiprobe(spark, sf_dir):
    return retrieve.probe_pairs(_sketches(spark, sf_dir).select("id", "sketch"), "id", _BANDS, _ROWS)


@_register(f"""WITH {_SK}, {_BAND}, {_PROBES}, ex AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id <> y.id),
few AS (SELECT it.id FROM it LEFT JOIN ex ON ex.a = it.id WHERE len(ws) > 0 GROUP BY 1 HAVING count(ex.b) + 1 < {S.PROBE_BELOW}),
pr AS (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT * FROM n SEMI JOIN few USING (id)) x JOIN n y ON x.band = y.band AND x.hole = y.hole AND x.key = y.key AND x.id <> y.id)
SELECT a, b FROM ex UNION SELECT a, b FROM pr""")
def lsh_retrieve(spark, sf_dir):
    """Exact hits, and probes for documents with fewer than five."""
    return retrieve.lsh_candidates(_sketches(spark, sf_dir).select("id", "sketch"), "id", _BANDS, _ROWS)


_INDICATOR_PAIRS = f"""{_USES}, u AS (SELECT DISTINCT trace_id, indicator FROM us), n AS (SELECT count(DISTINCT trace_id) AS n FROM u), f AS (SELECT indicator FROM u GROUP BY 1 HAVING count(*) <= greatest(30, 0.001 * (SELECT n FROM n))),
r AS (SELECT * FROM u SEMI JOIN f USING (indicator)), ip AS (SELECT x.trace_id AS a, y.trace_id AS b, count(*)::BIGINT AS shared FROM r x JOIN r y ON x.indicator = y.indicator AND x.trace_id < y.trace_id GROUP BY 1, 2)"""


@_register(f"WITH {_INDICATOR_PAIRS} SELECT * FROM ip WHERE shared >= 2")
def indicator_candidates(spark, sf_dir):
    return retrieve.indicator_pairs(A.uses(spark, sf_dir), "trace_id", "indicator", common_floor=30).where("shared >= 2")


@_register(f"""WITH {_USES}, u AS (SELECT DISTINCT trace_id, indicator FROM us) SELECT indicator, count(*)::BIGINT AS df, round(ln(((SELECT count(DISTINCT trace_id) FROM u) + 1) / (count(*) + 1)) + 1, 6)::DOUBLE AS idf FROM u GROUP BY 1""")
def indicator_idf(spark, sf_dir):
    return retrieve.indicator_idf(A.uses(spark, sf_dir), "trace_id", "indicator").withColumn("idf", F.round("idf", 6))


@_register(f"""WITH {_USES}, u AS (SELECT DISTINCT trace_id, entity, day FROM us) SELECT least(x.trace_id, y.trace_id) AS a, greatest(x.trace_id, y.trace_id) AS b, count(DISTINCT x.entity)::BIGINT AS shared
FROM u x JOIN u y ON x.entity = y.entity AND x.trace_id < y.trace_id AND abs(x.day - y.day) <= 2 GROUP BY 1, 2 HAVING count(DISTINCT x.entity) >= 2""")
def provenance_interval_join(spark, sf_dir):
    return retrieve.interval_pairs(A.uses(spark, sf_dir), "trace_id", "entity", "day", 2).where("shared >= 2")


@_register("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS cos FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, id) AS rank FROM p WHERE cos >= 0.2) SELECT query, id, cos, rank::BIGINT AS rank FROM r WHERE rank <= 20""")
def ann_topk(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    return retrieve.ann_topk(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 20, 0.2)


def _union_sources(spark, sf_dir):
    u = A.uses(spark, sf_dir)
    ind = retrieve.indicator_pairs(u, "trace_id", "indicator", common_floor=30)
    prov = retrieve.interval_pairs(u, "trace_id", "entity", "day", 2)
    # each pair is made once and turned: a union with the mirror image would make all pairs twice
    ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = lambda d: d.select(ends.alias("e"), "shared").select("e.*", "shared")
    n = u.groupBy(F.col("trace_id").alias("a")).agg(F.countDistinct("indicator").alias("ni"), F.countDistinct("entity").alias("ne"))
    return {
        "indicator": both(ind).join(n, "a").select("a", "b", retrieve.estimate(F.col("shared"), F.col("ni")).alias("estimate")),
        "provenance": both(prov).join(n, "a").select("a", "b", retrieve.estimate(F.col("shared"), F.col("ne"), 0.5, 0.5).alias("estimate")),
    }


_UNION_SQL = f"""WITH {_INDICATOR_PAIRS}, u2 AS (SELECT DISTINCT trace_id, entity, day FROM us), pp AS (SELECT x.trace_id AS a, y.trace_id AS b, count(DISTINCT x.entity) AS shared FROM u2 x JOIN u2 y ON x.entity = y.entity AND x.trace_id < y.trace_id AND abs(x.day - y.day) <= 2 GROUP BY 1, 2),
nn AS (SELECT trace_id AS a, count(DISTINCT indicator) AS ni, count(DISTINCT entity) AS ne FROM us GROUP BY 1),
al AS (SELECT a, b, round(least(1.0, shared / greatest(ni, 1)), 6) AS e, 'indicator' AS s FROM (SELECT a, b, shared FROM ip UNION ALL SELECT b, a, shared FROM ip) JOIN nn USING (a)
  UNION ALL SELECT a, b, round(least(1.0, 0.5 + 0.5 * shared / greatest(ne, 1)), 6), 'provenance' FROM (SELECT a, b, shared FROM pp UNION ALL SELECT b, a, shared FROM pp) JOIN nn USING (a)),
g AS (SELECT a, b, max(e) AS estimate, array_to_string(list_sort(list_distinct(list(s))), ',') AS sources FROM al WHERE e > 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY estimate DESC, b) AS rank FROM g) SELECT a, b, estimate::DOUBLE AS estimate, sources, rank::BIGINT AS rank FROM k WHERE rank <= 50"""


@_register(_UNION_SQL)
def candidate_union_cap(spark, sf_dir):
    return retrieve.candidate_union(_union_sources(spark, sf_dir))


# Pairs


_PAIRS_SQL = f"""{_ITEMS}, w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+(?:/[a-z0-9_.:-]+)?') AS ts FROM (SELECT item_id AS id, text FROM benchmark)), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM w) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), wt AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term)), nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM wt GROUP BY 1),
pr AS (SELECT x.id AS a, y.id AS b FROM it x JOIN it y ON x.id < y.id),
tc AS (SELECT pr.a, pr.b, round(coalesce(sum(x.w * y.w) / any_value(na.n * nb.n), 0), 6)::DOUBLE AS tfidf FROM pr JOIN nm na ON na.id = pr.a JOIN nm nb ON nb.id = pr.b LEFT JOIN wt x ON x.id = pr.a LEFT JOIN wt y ON y.id = pr.b AND y.term = x.term GROUP BY 1, 2)"""


def _pairs(spark, sf_dir):
    docs = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.tokenize(F.col("text")).alias("ts"))
    i = docs.select("id")
    return docs, i.select(F.col("id").alias("a")).join(i.select(F.col("id").alias("b")), F.col("a") < F.col("b"))


@_register(f"WITH {_PAIRS_SQL} SELECT a, b, tfidf FROM tc")
def tfidf_cosine(spark, sf_dir):
    docs, pairs = _pairs(spark, sf_dir)
    return match.tfidf_cosine(pairs, docs, "id", "ts")


_FEATS = f"""{_PAIRS_SQL}, {_HASHES}, mh AS (SELECT x.id AS a, y.id AS b, (count(*) FILTER (WHERE x.m = y.m)) / {_SLOTS}.0::DOUBLE AS mh FROM h x JOIN h y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
ft AS (SELECT tc.a, tc.b, mh, tfidf, len(list_intersect(x.ws, y.ws))::BIGINT AS shared, round(len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))), 6)::DOUBLE AS technique
  FROM tc JOIN mh USING (a, b) JOIN it x ON x.id = tc.a JOIN it y ON y.id = tc.b)"""


def _features(spark, sf_dir) -> DataFrame:
    docs, pairs = _pairs(spark, sf_dir)
    s = _sketches(spark, sf_dir, "benchmark", "item_id")
    rows = match.tfidf_cosine(pairs, docs, "id", "ts").join(s.toDF("a", "wa", "sa"), "a").join(s.toDF("b", "wb", "sb"), "b")
    return rows.select("a", "b", X.sketch_jaccard(F.col("sa"), F.col("sb")).alias("mh"), "tfidf", F.size(F.array_intersect("wa", "wb")).cast("long").alias("shared"), F.round(X.jaccard(F.col("wa"), F.col("wb")), 6).alias("technique"))


@_register(f"WITH {_FEATS} SELECT * FROM ft")
def pair_features(spark, sf_dir):
    return _features(spark, sf_dir)


@_register(f"WITH {_FEATS} SELECT a, b, round(least(1.0, 0.45 * mh + 0.30 * tfidf + 0.15 * least(1.0, shared) + 0.10 * technique), 6)::DOUBLE AS score FROM ft")
def baseline_score(spark, sf_dir):
    c = F.col
    return _features(spark, sf_dir).select("a", "b", F.round(match.baseline_score(c("mh"), c("tfidf"), c("shared"), c("technique")), 6).alias("score"))


@_register(f"""WITH {_FEATS} SELECT a, b, concat_ws(',', CASE WHEN mh >= 0.4 THEN 'behavior' END, CASE WHEN tfidf >= 0.5 THEN 'execution' END, CASE WHEN shared > 0 THEN 'infrastructure' END, CASE WHEN technique > 0 THEN 'technique' END) AS classes FROM ft""")
def evidence_classes(spark, sf_dir):
    c = F.col
    return _features(spark, sf_dir).select("a", "b", F.array_join(match.evidence_classes(c("mh"), c("tfidf"), c("shared"), c("technique"), F.lit(0)), ",").alias("classes"))


_JOBS = "jb AS (SELECT o_orderkey AS seq, o_custkey AS a, o_totalprice AS estimate, (least(o_custkey % 300, 256) * least(o_orderkey % 300, 256) + 1)::BIGINT AS cost FROM orders)"


def _jobs(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("a"), F.col("o_totalprice").alias("estimate"), match.pair_cost(F.col("o_custkey") % 300, F.col("o_orderkey") % 300).alias("cost"))


@_register(f"""WITH {_JOBS}, r AS (SELECT *, row_number() OVER w AS position, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM jb WINDOW w AS (ORDER BY estimate DESC, seq)) SELECT seq, cost, position::BIGINT AS position, running::BIGINT AS running FROM r WHERE running <= 2000000 OR position = 1""")
def budget_queue(spark, sf_dir):
    return match.budget_round(_jobs(spark, sf_dir), 2_000_000).select("seq", "cost", "position", "running")


@_register(f"""WITH {_JOBS}, r AS (SELECT a, seq, row_number() OVER (PARTITION BY a ORDER BY estimate DESC, seq) AS rank FROM jb) SELECT a, seq, rank::BIGINT AS rank FROM r ORDER BY rank, a LIMIT 400""")
def budget_round_robin(spark, sf_dir):
    w = Window.partitionBy("a").orderBy(F.col("estimate").desc(), "seq")
    ranked = _jobs(spark, sf_dir).select("a", "seq", F.row_number().over(w).cast("long").alias("rank"))
    return match.round_robin(ranked, 400)


# Groups


_LINKS = "lk AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS t, round((l_partkey * 7919 + l_suppkey * 104729) % 1000 / 1000.0, 3)::DOUBLE AS p FROM lineitem)"


def _members(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    p = F.round(((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1000) / 1000.0, 3)
    return li.select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("trace_id"), p.alias("strength")).distinct().withColumn("state", F.when(F.col("strength") >= 0.8, "supported").when(F.col("strength") >= 0.5, "proposed").otherwise("unsupported"))


@_register(f"""WITH {_LINKS}, r AS (SELECT t, p, row_number() OVER (PARTITION BY t ORDER BY p DESC, g) AS k FROM lk) SELECT t AS trace_id, round(avg(p), 6)::DOUBLE AS strength FROM r WHERE k <= 3 GROUP BY 1""")
def membership_top3(spark, sf_dir):
    m = _members(spark, sf_dir)
    return m.groupBy("trace_id").agg(F.round(group.top_mean(F.collect_list("strength")), 6).alias("strength"))


@_register(f"""WITH {_LINKS}, m AS (SELECT g, t FROM lk WHERE p >= 0.95) SELECT x.g AS group_a, y.g AS group_b, count(*)::BIGINT AS shared, string_agg(x.t::VARCHAR, ',' ORDER BY x.t::VARCHAR) AS members FROM m x JOIN m y ON x.t = y.t AND x.g < y.g GROUP BY 1, 2""")
def merge_proposals(spark, sf_dir):
    return group.merge_proposals(_members(spark, sf_dir), 0.95)


@_register(f"""WITH {_LINKS}, sp AS (SELECT l_partkey AS t, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1) SELECT g AS group_id, row_number() OVER (PARTITION BY g ORDER BY s, t)::BIGINT AS position, t AS trace_id, epoch_us(s) AS start_ts, epoch_us(e) AS end_ts FROM lk JOIN sp USING (t) WHERE p >= 0.5""")
def group_timeline(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    spans = li.groupBy(F.col("l_partkey").alias("trace_id")).agg(F.min("us").alias("start_ts"), F.max("us").alias("end_ts"))
    return group.group_timeline(_members(spark, sf_dir), spans)


@_register()
def grouping_fold(spark, sf_dir):
    """Groups folded from links between customers of one nation and segment, in order of their keys."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("t"), "c_custkey").alias("t"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("s"))
    w = Window.partitionBy("s").orderBy("k")
    rows = c.withColumn("b", F.lead("t").over(w)).where("b is not null")
    links = rows.select(F.col("t").alias("a"), "b", ((F.col("k") * 37 % 50) / 100.0 + 0.5).alias("p"), (F.col("k") % 3 + 1).alias("n_classes"), F.col("k").alias("seq"))
    return group.fold_groups(links)


# Graphs


@_register(f"WITH {_EDGES}, c AS (SELECT action, count(*) AS n FROM ed GROUP BY 1), r AS (SELECT ed.*, round(1.0::DOUBLE / n, 9) AS rarity, ts // 900 AS win FROM ed JOIN c USING (action)) SELECT src, dst, ts, rarity::DOUBLE AS rarity, win::BIGINT AS win, row_number() OVER (PARTITION BY win ORDER BY rarity DESC, ts, src, dst)::BIGINT AS place FROM r")
def edge_rarity(spark, sf_dir):
    rows = graph.edge_rarity(A.edges(spark, sf_dir))
    return rows.select("src", "dst", "ts", "rarity", F.col("window").alias("win"), "place")


@_register(f"""WITH {_EDGES}, nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), o AS (SELECT src AS node, count(*) AS o FROM ed GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i, max(anomaly) AS a FROM ed GROUP BY 1),
m AS (SELECT (SELECT max(o) FROM o) AS mo, (SELECT max(i) FROM i) AS mi, (SELECT max(a) FROM i) AS ma) SELECT node, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree, coalesce(a, 0)::DOUBLE AS anomaly,
round(0.5 * (0.5 * (coalesce(o, 0) / mo + coalesce(i, 0) / mi) + coalesce(a, 0) / greatest(ma, 1.0)), 6)::DOUBLE AS criticality FROM nd LEFT JOIN o USING (node) LEFT JOIN i USING (node) CROSS JOIN m""")
def criticality(spark, sf_dir):
    out = graph.criticality(A.edges(spark, sf_dir))
    return out.withColumn("out_degree", F.col("out_degree").cast("long")).withColumn("in_degree", F.col("in_degree").cast("long"))


@_register(f"""WITH RECURSIVE {_EDGES}, nr AS (SELECT DISTINCT src, dst FROM ed WHERE abs(ts - 3000) <= 6000), bi AS (SELECT src AS x, dst AS y FROM nr UNION SELECT dst, src FROM nr),
r AS (SELECT 'c10' AS node, 0 AS depth UNION SELECT bi.y, r.depth + 1 FROM r JOIN bi ON bi.x = r.node WHERE r.depth < 8) SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1""")
def reachability(spark, sf_dir):
    seeds = spark.createDataFrame([("c10",)], "node string")
    return graph.reachable(A.edges(spark, sf_dir), seeds, 3000.0, 6000.0)


@_register(f"""WITH RECURSIVE {_EDGES}, bi AS (SELECT src AS x, dst AS y FROM ed UNION SELECT dst, src FROM ed), r(node, seen) AS (SELECT x, x FROM bi UNION SELECT bi.y, r.seen FROM r JOIN bi ON bi.x = r.node)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def graph_components(spark, sf_dir):
    return graph.components(A.edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


_LOOPS = """lp AS (SELECT 'n' || (o_custkey % 12) AS src, 'n' || (o_orderkey % 12) AS dst, o_orderkey AS ts FROM orders WHERE o_custkey % 12 <> o_orderkey % 12
  QUALIFY row_number() OVER (PARTITION BY least(o_custkey % 12, o_orderkey % 12), greatest(o_custkey % 12, o_orderkey % 12) ORDER BY o_orderkey) = 1)"""


@_register(f"""WITH RECURSIVE {_LOOPS}, r(ts, x, y) AS (SELECT ts, src, dst FROM lp UNION SELECT ts, dst, src FROM lp),
p(s, node, far) AS (SELECT DISTINCT x, x, -1::BIGINT FROM r UNION SELECT p.s, r.y, greatest(p.far, r.ts) FROM p JOIN r ON r.x = p.node WHERE greatest(p.far, r.ts) < (SELECT max(ts) FROM lp)),
least_far AS (SELECT s, node, min(far) AS far FROM p GROUP BY 1, 2)
SELECT src, dst, ts FROM lp WHERE NOT EXISTS (SELECT 1 FROM least_far f WHERE f.s = lp.src AND f.node = lp.dst AND f.far < lp.ts)""")
def kruskal_forest(spark, sf_dir):
    """The first order between each two of 12 nodes: an edge is in the forest unless earlier ones already join its ends."""
    o = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).alias("x"), (F.col("o_orderkey") % 12).alias("y"), F.col("o_orderkey").alias("ts")).where("x <> y")
    first = o.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.min_by(F.struct("x", "y", "ts"), "ts").alias("e")).select("e.*")
    return graph.spanning_forest(first.select(F.concat(F.lit("n"), "x").alias("src"), F.concat(F.lit("n"), "y").alias("dst"), "ts"))


@_register("""WITH RECURSIVE p AS (SELECT c_custkey AS pid, c_custkey // 3 AS parent FROM customer), r AS (SELECT pid, pid AS root, parent FROM p UNION ALL SELECT r.pid, p.pid, p.parent FROM r JOIN p ON p.pid = r.parent WHERE r.parent <> 0 AND r.parent % 11 <> 0),
t AS (SELECT pid, arg_min(root, root) AS root FROM r GROUP BY 1) SELECT pid, root FROM t""")
def session_roots(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    procs = c.select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 3).alias("parent"), F.when(F.col("c_custkey") % 11 == 0, "service").otherwise("app").alias("image"))
    return traces.session_roots(procs, ["service"])


# Splits and metrics


@_register("""WITH g AS (SELECT user_id, min(epoch_us(ts)) AS first_ts FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first_ts, user_id::VARCHAR) AS position, count(*) OVER () AS n FROM g),
s AS (SELECT *, greatest(1, round_even(0.15 * n, 0)) AS nt FROM r) SELECT user_id, first_ts, position::BIGINT AS position, CASE WHEN position > n - nt THEN 'test' WHEN position > n - nt - greatest(1, round_even(0.15 * n, 0)) THEN 'val' ELSE 'train' END AS split FROM s""")
def time_forward_split(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return evaluate.time_forward_split(e, "user_id", "us")


@_register("""WITH a AS (SELECT DISTINCT source AS actor FROM documents), r AS (SELECT actor, row_number() OVER (ORDER BY sha256(sha256('open-set:42') || actor), actor) AS k, count(*) OVER () AS n FROM a),
h AS (SELECT *, greatest(1, round_even(0.2 * n, 0)) AS hold FROM r) SELECT actor, CASE WHEN k <= floor(hold / 2) THEN 'val' WHEN k <= hold THEN 'test' ELSE 'train' END AS split FROM h""")
def open_set_split(spark, sf_dir):
    return evaluate.open_set_split(A.table(spark, sf_dir, "documents"), "source")


_SCORED = "sc AS (SELECT d.doc_id, l.quality AS y, (d.n_chars % 97) / 97.0::DOUBLE AS p FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("p"))
    return d.join(A.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@_register(f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM sc) SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6)::DOUBLE AS auc FROM r""")
def auc_rank(spark, sf_dir):
    return evaluate.auc(_scored(spark, sf_dir), "p", "y")


@_register(f"""WITH {_SCORED}, b AS (SELECT least(greatest(ceil(p * 10), 1), 10)::BIGINT AS bin, p, y FROM sc)
SELECT bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_p, round(avg(y::DOUBLE), 6) AS mean_y, round(abs(avg(p) - avg(y::DOUBLE)), 6) AS gap FROM b GROUP BY 1""")
def ece_bins(spark, sf_dir):
    return evaluate.calibration_bins(_scored(spark, sf_dir), "p", "y")


@_register(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM sc) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall FROM c""")
def precision_recall(spark, sf_dir):
    return evaluate.precision_recall(_scored(spark, sf_dir), F.col("p") >= 0.5, F.col("y") == 1)


@_register("""WITH ev AS (SELECT DISTINCT o_custkey AS t, o_orderkey % 500 AS n FROM orders), inc AS (SELECT DISTINCT (l_suppkey % 5)::BIGINT AS incident, l_orderkey % 500 AS n FROM lineitem WHERE l_partkey % 40 = 0),
sz AS (SELECT t, count(*) AS s FROM ev GROUP BY 1), h AS (SELECT incident, t, count(*) AS h FROM ev JOIN inc USING (n) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY h DESC, t) AS k FROM h),
x AS (SELECT b.incident, b.t, b.h, sz.s FROM b JOIN sz USING (t) WHERE k <= 3), cv AS (SELECT x.incident, count(DISTINCT ev.n) AS c FROM x JOIN ev USING (t) JOIN inc ON inc.incident = x.incident AND inc.n = ev.n GROUP BY 1),
pu AS (SELECT incident, sum(h) AS h, sum(s) AS s FROM x GROUP BY 1), tt AS (SELECT incident, count(*) AS t FROM inc GROUP BY 1)
SELECT incident, round(c / t, 6)::DOUBLE AS covered, round(h / s, 6)::DOUBLE AS purity, (c / t >= 0.8 AND h / s >= 0.5) AS passed FROM tt JOIN cv USING (incident) JOIN pu USING (incident)""")
def boundary_gate(spark, sf_dir):
    e = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trace_id"), (F.col("o_orderkey") % 500).alias("node"))
    inc = A.table(spark, sf_dir, "lineitem").where("l_partkey % 40 = 0").select((F.col("l_suppkey") % 5).alias("incident"), (F.col("l_orderkey") % 500).alias("node"))
    return evaluate.boundary_gate(e, inc)


# Chains


@_register(f"WITH {_EVENTS} SELECT source_id, count(*)::BIGINT AS count, true AS ok FROM ev GROUP BY 1")
def chain_verify(spark, sf_dir):
    rows = A.events(spark, sf_dir).select("source_id", "id", "raw")
    chained = ledger.chain_rows(rows, "source_id", "id", "raw")
    return ledger.verify_chain(chained, "source_id", "id", "raw").select("source_id", "count", "ok")


@_register(f"""WITH {_EVENTS}, k AS (SELECT id, source_id, raw, sha256('{S.GENESIS}|' || raw) AS first FROM ev) SELECT source_id, arg_min(first, id) AS first_hash FROM k GROUP BY 1""")
def chain_first_hash(spark, sf_dir):
    rows = A.events(spark, sf_dir).select("source_id", "id", "raw")
    chained = ledger.chain_rows(rows, "source_id", "id", "raw")
    return chained.groupBy("source_id").agg(F.min_by("record_hash", "id").alias("first_hash"))

# Operators of the batch path


@_register(f"WITH {_PAIRS_SQL} SELECT pr.a, pr.b, round(coalesce(sum(CASE WHEN y.term IS NOT NULL THEN ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1 END), 0), 6)::DOUBLE AS idf_shared FROM pr LEFT JOIN tf x ON x.id = pr.a LEFT JOIN tf y ON y.id = pr.b AND y.term = x.term LEFT JOIN df ON df.term = x.term GROUP BY 1, 2")
def idf_shared(spark, sf_dir):
    docs, pairs = _pairs(spark, sf_dir)
    uses = docs.select("id", F.explode("ts").alias("term")).distinct()
    return match.idf_shared(pairs, uses, match.idf_table(docs, "id", "ts"), "id", "term")


@_register(f"WITH {_JOBS}, d AS (SELECT n, count(*) AS d FROM (SELECT 'c' || a AS n FROM jb UNION ALL SELECT 'o' || (seq % 50) FROM jb) GROUP BY 1) SELECT seq, round(estimate / sqrt(x.d * y.d), 6)::DOUBLE AS priority FROM jb JOIN d x ON x.n = 'c' || a JOIN d y ON y.n = 'o' || (seq % 50)")
def degree_priority(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("seq", F.concat(F.lit("c"), "a").alias("a"), F.concat(F.lit("o"), F.col("seq") % 50).alias("b"), "estimate")
    return match.degree_priority(jobs).select("seq", "priority")


@_register("""WITH e AS (SELECT o_orderkey, 'c' || o_custkey AS src_id, 's' || (o_orderkey % 100) AS dst_id FROM orders), t AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0 UNION SELECT 's7')
SELECT DISTINCT * FROM e WHERE src_id IN (SELECT node_id FROM t) OR dst_id IN (SELECT node_id FROM t)""")
def incident_events(spark, sf_dir):
    e = A.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 100).alias("dst_id"))
    truth = A.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id")).union(spark.createDataFrame([("s7",)], "node_id string"))
    return readers.incident_events(e, truth)


@_register("""SELECT o_orderkey, 'c' || o_custkey AS src_id, 's' || (o_orderkey % 200) AS dst_id, CASE WHEN c_custkey IS NULL THEN NULL ELSE 'customer' END AS src_type, coalesce(c_name, 'c' || o_custkey) AS src_name,
CASE WHEN s_suppkey IS NULL THEN NULL ELSE 'supplier' END AS dst_type, coalesce(s_name, 's' || (o_orderkey % 200)) AS dst_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 200""")
def edge_nodes(spark, sf_dir):
    e = A.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 200).alias("dst_id"))
    c = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.lit("customer").alias("node_type"), F.col("c_name").alias("name"))
    s = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"), F.col("s_name").alias("name"))
    return readers.load_edges(e, c.union(s))


@_register("""WITH r AS (SELECT CASE WHEN contains(source, '1') THEN 'sf' ELSE source END AS actor, doc_id AS session_id, text AS command, doc_id AS ts FROM documents WHERE source <> 'src2'),
k AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY session_id) AS rk FROM r WHERE len(string_split_regex(trim(command, ' '), '\\s+')) <= 256) SELECT actor, session_id, 0::BIGINT AS seq FROM k WHERE actor <> 'sf' OR rk <= 20""")
def load_corpus(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("actor"), F.col("doc_id").alias("session_id"), F.col("text").alias("command"), F.col("doc_id").alias("ts"))
    return readers.load_corpus(d, 256, "sf", ("1",), 20, "src2").select("actor", "session_id", "seq")


@_register(f"""WITH {_SCORED}, t AS (SELECT DISTINCT p AS threshold FROM sc), a AS (SELECT threshold, count(*) FILTER (WHERE (p >= threshold) = (y = 1)) / count(*) AS accuracy FROM t, sc GROUP BY 1) SELECT threshold, accuracy::DOUBLE AS accuracy FROM a ORDER BY accuracy DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    return match.best_threshold(_scored(spark, sf_dir), "p", "y")


@_register(f"""WITH {_LINKS}, n AS (SELECT g, count(*) AS n FROM lk GROUP BY 1), i AS (SELECT g AS group_id, 'x' || (t % 50) AS trace_id, list_sort(list(p), 'DESC') AS ps FROM lk GROUP BY 1, 2),
j AS (SELECT trace_id, group_id, round(list_sum(ps[1:3]) / least(3, n), 6)::DOUBLE AS strength FROM i JOIN n ON g = group_id), k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY strength DESC, group_id) AS rk FROM j WHERE strength >= 0.5)
SELECT trace_id, group_id, strength FROM k WHERE rk <= 3""")
def batch_assign(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("member", F.concat_ws("/", "group_id", "trace_id"))
    links = m.select(F.concat(F.lit("x"), F.col("trace_id") % 50).alias("a"), F.col("member").alias("b"), F.col("strength").alias("p"))
    return group.batch_assign(links, m.select(F.col("member").alias("trace_id"), "group_id"))


@_register(f"""WITH {_LINKS}, i AS (SELECT g AS group_id, t % 50 AS trace_id, count(*)::BIGINT AS n_links, list_sort(list(p), 'DESC') AS ps FROM lk GROUP BY 1, 2) SELECT group_id, trace_id, round(list_sum(ps[1:3]) / least(3, len(ps)), 6)::DOUBLE AS strength, n_links FROM i""")
def membership_strength(spark, sf_dir):
    m = _members(spark, sf_dir)
    links = m.select((F.col("trace_id") % 50).alias("a"), F.concat_ws("/", "group_id", "trace_id").alias("b"), F.col("strength").alias("p"))
    members = m.select(F.concat_ws("/", "group_id", "trace_id").alias("trace_id"), "group_id")
    return group.membership_strength(links, members).select("group_id", "trace_id", "strength", "n_links")


@_register(f"""WITH {_SK}, {_BAND}, c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id < y.id),
u AS (SELECT id, unnest(ws) AS w FROM it), f AS (SELECT w FROM u GROUP BY 1 HAVING count(*) BETWEEN 2 AND greatest({S.COMMON_FLOOR}, {S.COMMON_SHARE} * (SELECT count(DISTINCT id) FROM u))), rr AS (SELECT * FROM u SEMI JOIN f USING (w)),
z AS (SELECT a, b FROM c UNION SELECT x.id, y.id FROM rr x JOIN rr y ON x.w = y.w AND x.id < y.id), q AS (SELECT a, b, round((count(*) FILTER (WHERE x.m = y.m)) / {_SLOTS}.0, 6)::DOUBLE AS similarity FROM z JOIN h x ON x.id = a JOIN h y ON y.id = b AND y.s = x.s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM (SELECT * FROM q UNION ALL SELECT b, a, similarity FROM q)) SELECT a, b, similarity, rank::BIGINT AS rank FROM r WHERE rank <= {S.CANDIDATE_CAP}""")
def retrieval_index(spark, sf_dir):
    """Neighbours of documents by bands and by shared words that are not common."""
    s = _sketches(spark, sf_dir)
    s = cut(s.withColumn("sketch", retrieve.packed(s)), "sketches")
    return retrieve.retrieval_index(s.select("id", "sketch"), s.select("id", F.explode("ws").alias("w")), "id", "w", _BANDS, _ROWS)


@_register("""SELECT n_regionkey::BIGINT AS seq, n_nationkey::BIGINT AS id, string_agg(n_name, ' ') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS path FROM nation""")
def running_path(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0)
    return n.select(F.col("n_regionkey").cast("long").alias("seq"), F.col("n_nationkey").cast("long").alias("id"), F.array_join(F.collect_list("n_name").over(w), " ").alias("path"))


@_register(f"""WITH {_EVENTS} SELECT source_id AS key, id, row_number() OVER (PARTITION BY source_id ORDER BY us DESC, id) - 1 AS age FROM ev QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY us DESC, id) <= 20""")
def newest_per_source(spark, sf_dir):
    w = Window.partitionBy("source_id").orderBy(F.col("us").desc(), "id")
    e = A.events(spark, sf_dir).withColumn("age", (F.row_number().over(w) - 1).cast("long"))
    return e.where("age < 20").select(F.col("source_id").alias("key"), "id", "age")


@_register(f"""WITH {_EVENTS} SELECT id, (us * 1000)::BIGINT AS nanos FROM ev""")
def nanos(spark, sf_dir):
    e = A.events(spark, sf_dir)
    given = F.when(F.col("id") % 2 == 0, (F.col("us") * 1000).cast("string")).otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return e.select("id", readers.to_nanos(given).alias("nanos"))


@_register(f"""WITH {_EVENTS}, s AS (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n, CASE WHEN id % 50 = 0 THEN id * 10 END AS ex FROM ev),
b AS (SELECT *, last_value(ex - n IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS base FROM s) SELECT source_id, id, (n + coalesce(base, -1))::BIGINT AS source_seq FROM b""")
def stamp_sequence(spark, sf_dir):
    e = A.events(spark, sf_dir).select("source_id", F.col("id").alias("position"), F.when(F.col("id") % 50 == 0, F.col("id") * 10).alias("explicit_seq"))
    return readers.stamp_sequence(e).select("source_id", F.col("position").alias("id"), "source_seq")


# The SQL surface, on the star tables


def _both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark, sf_dir, text=spark_sql):
        return query_unlimited(spark, text, {t: A.table(spark, sf_dir, t) for t in TABLES if t in text})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = duck_sql or spark_sql


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_DAY = "cast(cast(l_shipdate as date) as varchar(10))"

_both("sql_flagship", """SELECT n_name AS host, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
_both("join_inner", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_both("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
_both("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000")
_both("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
_both("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
_both("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
_both("join_cross", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
_both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND a.n_nationkey + b.n_nationkey > 10")
_both("join_lateral", "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0) x")
_both("agg_groupby", """SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS sum_qty, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS sum_price, count(*) AS n,
min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
_both("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
_both("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
_both("agg_gsets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_both("agg_distinct_filter", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderstatus")
_both("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_both("win_rank", """SELECT o_orderkey, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS bigint) AS rk, cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS bigint) AS dr FROM orders""")
_both("win_frame", """SELECT o_orderkey, cast(sum(cast(o_totalprice AS decimal(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS double) AS s FROM orders""")
_both("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_both("win_ntile", "SELECT c_custkey, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bigint) AS q FROM customer")
_both("setop_union", "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer UNION ALL SELECT r_regionkey FROM region")
_both("setop_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
_both("setop_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_both("setop_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_both("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_both("topk_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rn FROM orders) t WHERE rn <= 3")
_both("json_props", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events", "SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
_both("pivot_status", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
_both("cte_recursive", "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 50) SELECT n, s FROM t")
_both("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
_both("subquery_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
_both("func_string", "SELECT p_partkey, upper(p_name) AS u, substring(p_type, 1, 4) AS s4, cast(length(p_brand) AS bigint) AS n, replace(p_type, ' ', '_') AS r, split_part(p_type, ' ', 1) AS w, lpad(cast(p_size AS varchar(10)), 4, '0') AS pad, reverse(p_brand) AS rev FROM part")
_both("func_regex", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#') AS r, p_type RLIKE '^[A-Z]+ ' AS m, regexp_extract(p_brand, '([0-9]+)', 1) AS d FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r, regexp_matches(p_type, '^[A-Z]+ ') AS m, regexp_extract(p_brand, '([0-9]+)', 1) AS d FROM part")
_both("func_date", "SELECT o_orderkey, cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, cast(quarter(o_orderdate) AS bigint) AS q, cast(datediff(cast(o_orderdate AS date), date '1990-01-01') AS bigint) AS days, cast(date_trunc('MONTH', o_orderdate) AS date) = cast(o_orderdate AS date) AS first FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS days, date_trunc('month', o_orderdate)::DATE = o_orderdate::DATE AS first FROM orders")
_both("func_math", "SELECT o_orderkey, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, o_orderkey % 7 AS m, abs(o_custkey - 500) AS a, pow(2, o_orderkey % 10) AS p, greatest(o_orderkey, o_custkey) AS g FROM orders", "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS f, ceil(o_totalprice)::BIGINT AS c, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, o_orderkey % 7 AS m, abs(o_custkey - 500) AS a, pow(2, o_orderkey % 10) AS p, greatest(o_orderkey, o_custkey) AS g FROM orders")
_both("func_array", "SELECT vec_id, round(cast(element_at(embedding, 1) AS double), 6) AS x, cast(size(embedding) AS bigint) AS n, cast(size(filter(embedding, v -> v > 0)) AS bigint) AS pos, round(cast(array_max(embedding) AS double), 6) AS top FROM embeddings", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, len(embedding)::BIGINT AS n, len(list_filter(embedding, lambda v: v > 0))::BIGINT AS pos, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
_both("func_map", "SELECT event_id, map('t', event_type, 'p', props)['t'] AS t, cast(size(map_keys(map('t', event_type, 'p', props))) AS bigint) AS n FROM events", "SELECT event_id, event_type AS t, 2::BIGINT AS n FROM events")
_both("func_conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer")


@_register("""SELECT e.event_id, o.o_orderkey FROM events e ASOF JOIN (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON e.ts - INTERVAL 25 YEAR >= o.o_orderdate""")
def asof_join(spark, sf_dir):
    """Latest order at or before each event, 25 years earlier: union, then the last order by range of time.

    Rows are cut in days; a day's window starts from the last order before it, so no window holds
    more than a day.
    """
    o = A.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    e = A.table(spark, sf_dir, "events").select((F.col("ts").cast("timestamp") - F.expr("INTERVAL 25 YEAR")).alias("at"), "event_id")
    rows = o.select("at", "o_orderkey", F.lit(None).cast("long").alias("event_id")).unionByName(e.select("at", F.lit(None).cast("long").alias("o_orderkey"), "event_id"))
    rows = rows.withColumn("day", F.col("at").cast("date"))
    days = rows.groupBy("day").agg(F.max_by("o_orderkey", F.when(F.col("o_orderkey").isNotNull(), F.col("at"))).alias("newest"))
    before = F.last("newest", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy("day").orderBy("at", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(days.select("day", before.alias("carried")), "day")
    rows = rows.withColumn("o_orderkey", F.coalesce(F.last("o_orderkey", ignorenulls=True).over(w), "carried"))
    return rows.where("event_id is not null and o_orderkey is not null").select("event_id", "o_orderkey")
