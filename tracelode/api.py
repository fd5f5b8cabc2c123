"""One object over a store: ingest, seal, search, SQL, traces, groups, views, verification."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import text as X
from .operators import attrib, graph, group, ledger, match, normalize, retrieve, search, traces, views
from .operators.graph import cut
from .operators.store import Store
from .plans import sqlgate
from .sources import otlp, readers
from .streaming.ingest import Ingest


class Engine:
    """A data folder and a session. Reads are DataFrames; writes go through ``Ingest``.

    Opening recovers whole batches that a crash kept out of the manifest, and loads the ledger, the
    analysts' decisions and the trained model that were stored. Links and groups are stored as
    projections of the log's version and the model; they are worked out when one of them changes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self.ingester = Ingest(spark, self.store)
        self.store.recover()
        stored = self.store.load("ledger")
        self.ledger = ledger.Ledger([] if stored is None else [r.asDict() for r in stored.orderBy("seq").collect()])
        self.decisions = self.store.load("decisions")

    def _record(self, *args, **options) -> None:
        self.ledger.append(*args, **options)
        self.store.save("ledger", self.ledger.frame(self.spark))

    def _labels(self) -> DataFrame | None:
        return self.store.load("labels")

    def _projection(self, name: str, build) -> DataFrame:
        """A stored table of this version of the log and the model, built if it isn't there."""
        trained = sum(r["kind"] == "train" for r in self.ledger.records)
        version = f"{self.store.version():010d}-{trained:06d}"
        found = self.store.load(name, version)
        return self.store.save(name, build(), version) if found is None else found

    # Writing

    def ingest_records(self, records: list[dict], batch_id: str, source_id: str = "api") -> int:
        lines = self.spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "position long, value string")
        return self.ingester.write(readers.parse_lines(lines, source_id), batch_id)

    def ingest_path(self, path: str, batch_id: str, source_id: str = "generic", kind: str = "jsonl") -> int:
        if kind == "sessions":
            rows = readers.expand_sessions(self.spark.read.text(path, wholetext=path.endswith(".json")))
            record = F.map_filter(F.create_map(*[x for c in ("session_id", "host", "ts", "action", "raw") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
            return self.ingester.write(rows.select(record.alias("record"), F.lit(source_id).alias("source_id"), "position"), batch_id)
        rows = readers.read_edges(self.spark, path) if kind == "edges" else readers.read_jsonl(self.spark, path, source_id)
        return self.ingester.write(rows.select("record", "source_id", "position"), batch_id)

    def ingest_otlp(self, body: str, batch_id: str, kind: str = "traces") -> int:
        payload = self.spark.createDataFrame([(body,)], "body string")
        rows = otlp.parse_traces(payload) if kind == "traces" else otlp.parse_logs(payload)
        names = [c for c in ("source_id", "host", "ts", "action", "subject", "object", "session_id", "session_root", "raw") if c in rows.columns]
        fields = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))], F.lit("attributes"), F.to_json("attributes"))
        rows = rows.select(F.map_filter(fields, lambda k, v: v.isNotNull()).alias("record"), "source_id", F.monotonically_increasing_id().alias("position"))
        return self.ingester.write(rows, batch_id)

    def seal(self) -> list[str]:
        return self.store.seal()

    def index(self) -> list[str]:
        return self.store.index()

    # Events

    def events(self) -> DataFrame:
        done = self.store.manifest("sealed")
        if done.isEmpty():
            return search.all_events(self.store.log().select("segment", *S.EVENT_COLUMNS))
        return search.all_events(self.store.sealed(), self.store.live())

    def search(self, query: str, where: str | None = None, mask: int | None = None, limit: int = 1000, bm25: bool = False) -> DataFrame:
        """Literal search through trigram postings, or ranked search; what isn't indexed yet is scanned."""
        indexed = self.store.manifest("index").select(F.col("name").alias("segment"))
        if indexed.isEmpty():
            if not bm25:
                return search.search(self.events(), query, where, mask, limit)
            scores = self.spark.createDataFrame([], "id string, score double")
        elif not bm25:
            events = self.events()
            known = events.join(F.broadcast(indexed), "segment", "left_semi")
            found = search.trigram_search(known, self.store.postings("trigrams"), query, "event_hash", "raw")
            rest = events.join(F.broadcast(indexed), "segment", "left_anti")
            return search.search(found.select(*events.columns).unionByName(rest), query, where, mask, limit)
        else:
            scores = search.bm25(self.store.postings("terms"), self.store.postings("lengths"), query)
        rest = self.events().join(F.broadcast(indexed), "segment", "left_anti")
        best = search.hybrid(scores, rest, query, limit)
        rows = self.events().join(best.select(F.col("id").alias("event_hash"), F.col("score").alias("_score")), "event_hash")
        if where is not None:
            rows = rows.withColumn("ts", F.to_timestamp("ts")).where(F.expr(sqlgate.check_filter(self.spark, where)))
        return rows.orderBy(F.col("_score").desc(), "event_hash")

    # Traces and groups

    def traced(self) -> DataFrame:
        """Events with their trace: anchors cut at idle gaps and at the longest duration."""
        rows = normalize.adapt(self.events()).withColumn("us", (F.col("ts_epoch") * 1e6).cast("long"))
        rows = traces.sessionize(rows, "anchor", "us", "event_hash")
        return rows.withColumn("trace_id", F.concat_ws(":", "anchor", F.col("session").cast("string")))

    def traces(self) -> DataFrame:
        return traces.trace_features(self.traced())

    def candidates(self, events: DataFrame, t: DataFrame) -> dict[str, DataFrame]:
        """Directed candidates ``a, b, estimate`` by source: sketches with probes, indicators, entities in time, dense vectors."""
        uses, touches = self._uses(events), events.select("trace_id", F.explode("entities").alias("entity"), "ts_epoch")
        ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = lambda d: d.select(ends.alias("e"), "shared").select("e.*", "shared")
        sizes = t.select(F.col("trace_id").alias("a"), F.coalesce(F.size("entities"), F.lit(0)).alias("entities")).join(uses.groupBy(F.col("trace_id").alias("a")).agg(F.count(F.lit(1)).alias("uses")), "a", "left")
        near = lambda d, size, *line: both(d).join(sizes, "a").select("a", "b", retrieve.estimate(F.col("shared"), F.coalesce(size, F.lit(0)), *line).alias("estimate"))
        sketches = t.where("sketch is not null").select("trace_id", "sketch")
        bands, rows = retrieve.bands_for_threshold()
        lsh = retrieve.lsh_candidates(sketches, "trace_id", bands, rows).join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
        vector = retrieve.dense_vector(F.col("end_ts") - F.col("start_ts"), F.coalesce(F.size("token_counts"), F.lit(0)), F.coalesce("uses", F.lit(0)), F.coalesce(F.size("entities"), F.lit(0)))
        dense = t.join(sizes.select(F.col("a").alias("trace_id"), "uses"), "trace_id").select("trace_id", vector.alias("v"))
        ann = retrieve.ann_topk(dense, dense, "trace_id", "v")
        return {
            "lsh": lsh.select("a", "b", X.sketch_jaccard(F.col("sa"), F.col("sb")).alias("estimate")),
            "indicator": near(retrieve.indicator_pairs(uses, "trace_id", "indicator"), F.col("uses")),
            "provenance": near(retrieve.interval_pairs(touches, "trace_id", "entity", "ts_epoch"), F.col("entities"), 0.5, 0.5),
            "ann": ann.select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("cos").alias("estimate")),
        }

    @staticmethod
    def _uses(events: DataFrame) -> DataFrame:
        return events.select("trace_id", F.explode(F.flatten(F.map_values("indicators"))).alias("indicator")).distinct()

    def links(self) -> DataFrame:
        """Scored pairs of traces, as stored for this version of the log and the model."""
        return self._projection("links", self._links)

    def _links(self) -> DataFrame:
        """Candidates of four sources, 50 a trace, in a queue by estimate, scored in rounds of one budget each."""
        events = cut(self.traced().select("trace_id", "ts_epoch", "action", "object", "tokens", "techniques", "indicators", "entities"), "traced")
        t = cut(traces.trace_features(events), "traces")
        capped = cut(retrieve.candidate_union(self.candidates(events, t)), "candidates")
        pairs = capped.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("estimate").alias("estimate"), F.array_distinct(F.flatten(F.collect_list(F.split("sources", ",")))).alias("sources"))
        size = t.select("trace_id", F.coalesce(F.size("token_counts"), F.lit(0)).alias("n"))
        pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").withColumn("cost", match.pair_cost(F.col("na"), F.col("nb"))).drop("na", "nb")
        uses, touches = self._uses(events), events.select("trace_id", F.explode("entities").alias("entity"), "ts_epoch")
        shared = retrieve.indicator_pairs(uses, "trace_id", "indicator")
        near = retrieve.interval_pairs(touches, "trace_id", "entity", "ts_epoch").withColumnRenamed("shared", "provenance_shared")
        pairs = pairs.join(shared, ["a", "b"], "left").join(near, ["a", "b"], "left").na.fill(0, ["shared", "provenance_shared"])
        docs = events.select("trace_id", F.explode("tokens").alias("x")).groupBy("trace_id").agg(F.collect_list("x").alias("terms"))
        pairs = pairs.join(match.tfidf_cosine(pairs.select("a", "b"), docs, "trace_id", "terms"), ["a", "b"])
        idf = retrieve.rare_values(uses, "trace_id", "indicator").join(retrieve.indicator_idf(uses, "trace_id", "indicator"), "indicator").select(F.col("indicator").alias("term"), "idf")
        pairs = pairs.join(match.idf_shared(pairs.select("a", "b"), uses, idf, "trace_id", "indicator"), ["a", "b"])
        f = match.pair_features(pairs, t.withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>"))))
        f = f.join(pairs.select("a", "b", "estimate", "sources", "cost"), ["a", "b"])
        c = F.col
        classes = match.evidence_classes(c("minhash"), c("tfidf"), c("shared"), c("technique"), c("provenance"))
        out = f.select("*", F.round(match.baseline_score(c("minhash"), c("tfidf"), c("shared"), c("technique")), 6).alias("p"), classes.alias("classes"))
        labels = self._labels()
        if labels is not None:
            out = cut(out, "scored")
            _, _, score = match.fit_pair_model(out.join(labels, ["a", "b"]))
            out = score(out.drop("p")).select(*out.columns)
        return out

    def queue(self, budget: int = S.ROUND_BUDGET) -> DataFrame:
        """Links in the order they are worked off: best estimate first, numbered by rounds of one budget."""
        jobs = self.links().select("a", "b", "estimate", "cost", F.concat_ws("|", "a", "b").alias("seq"))
        return match.rounds(jobs, budget)

    def groups(self) -> DataFrame:
        """Memberships, with the analysts' decisions laid over them."""
        folded = self._projection("groups", self._groups)
        return folded if self.decisions is None else group.decide(folded, self.decisions).drop("refused")

    def _groups(self) -> DataFrame:
        links = self.links().where(F.col("p") >= S.TAU_MEMBER).withColumn("n_classes", F.size("classes"))
        return group.fold_groups(links.select("a", "b", "p", "n_classes", F.lit(0).cast("long").alias("seq")))

    def train(self, labelled: DataFrame) -> DataFrame:
        """Fit the pair model on ``a, b, label``, score all links with it and group every trace anew; recorded in the ledger."""
        rows = self.links().join(labelled, ["a", "b"])
        lr, _, _ = match.fit_pair_model(rows)
        self.store.save("labels", labelled.select("a", "b", F.col("label").cast("int").alias("label")))
        self._record("train", {"rows": labelled.count()}, {"coef": list(lr.coefficients)}, model=match.decision_context(lr.coefficients, lr.intercept))
        self.groups()
        return self.links()

    def review(self, trace_id: str, group_id: str, state: str) -> DataFrame:
        """An analyst's decision over the folded memberships; stored, and recorded in the ledger."""
        if state not in ("confirmed", "rejected"):
            raise ValueError("confirmed or rejected is expected")
        row = self.spark.createDataFrame([(trace_id, group_id, state)], "trace_id string, group_id string, state string")
        if self.decisions is not None:
            row = self.decisions.where((F.col("trace_id") != trace_id) | (F.col("group_id") != group_id)).union(row)
        laid = group.decide(self._projection("groups", self._groups), row)
        if laid.where((F.col("trace_id") == trace_id) & (F.col("group_id") == group_id) & F.col("refused")).count():
            raise ValueError(f"{trace_id} is in {S.MAX_MEMBERSHIPS} groups already")
        self.decisions = self.store.save("decisions", row)
        self._record("review", {"trace_id": trace_id, "group_id": group_id}, {"state": state})
        return self.groups()

    def group_view(self, group_id: str) -> dict[str, DataFrame]:
        """A group's members, their spans of time in order, and the groups it shares members with."""
        members = self.groups()
        own = members.where(F.col("group_id") == group_id)
        spans = self.traces().select("trace_id", "start_ts", "end_ts")
        return {"members": own, "timeline": group.group_timeline(own, spans), "shared": group.shared_groups(members, group_id)}

    def attribute(self, train: DataFrame) -> DataFrame:
        """Outcome of each active group against actors (``actor, tokens, techniques`` rows): text model and techniques fused."""
        t = self.traces()
        members = group.active(self.groups()).select("group_id", "trace_id").join(t, "trace_id")
        words = members.select("group_id", F.explode(F.map_keys("token_counts")).alias("w")).groupBy("group_id").agg(F.array_sort(F.collect_list("w")).alias("tokens"))
        technique = members.select("group_id", F.explode("techniques").alias("x")).groupBy("group_id").agg(F.collect_set("x").alias("techniques"))
        _, probabilities = attrib.fit_text_model(train)
        p = probabilities(words)
        tech = attrib.technique_scores(technique, train)
        scores = p.join(tech, ["group_id", "actor"], "left").select("group_id", "actor", attrib.fuse(F.col("p"), F.coalesce("tech", F.lit(0.0))).alias("s"))
        return attrib.outcome(attrib.posterior(scores, train.select("actor").distinct().count()))

    def reconstruct(self, seed: str, horizon: float = S.HORIZON_SECONDS) -> tuple[DataFrame, DataFrame]:
        """The provenance around an entity: forest edges below the best entry, and nodes with their role."""
        rows = normalize.adapt(self.events())
        edges = rows.where("subject <> '' and object <> ''").select(F.col("subject").alias("src"), F.col("object").alias("dst"), "action", F.col("ts_epoch").alias("ts"), normalize.edge_score(F.col("action"), F.col("object")).alias("anomaly"))
        edges = cut(edges, "edges")
        seeds = self.spark.createDataFrame([(seed,)], "node string")
        anchor = edges.where((F.col("src") == seed) | (F.col("dst") == seed)).agg(F.max("ts")).first()[0]
        if anchor is None:
            raise KeyError(seed)
        return graph.reconstruct(edges, seeds, anchor, horizon)

    # SQL and views

    def tables(self) -> dict:
        """The named tables that SQL sees, each made when it is asked for."""

        def sizes() -> DataFrame:
            return self.groups().groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count")).select("group_id", F.lit(1).alias("version"), "member_count")

        def spans() -> DataFrame:
            return self.traced().groupBy("trace_id", "anchor").agg(F.min("ts_epoch").alias("start_ts"), F.max("ts_epoch").alias("end_ts"), F.count(F.lit(1)).alias("event_count"))

        return {
            "events": lambda: self.events().select(*S.EVENT_COLUMNS).withColumn("ts", F.to_timestamp("ts")), "traces": spans, "trace_events": lambda: self.traced().select("trace_id", "event_hash"),
            "groups": sizes, "memberships": self.groups, "decisions": lambda: self.ledger.frame(self.spark), "source_checkpoints": lambda: views.checkpoints(self.events()),
        }

    def query(self, sql: str, limit: int = 1000) -> DataFrame:
        known = self.tables()
        return sqlgate.query_tables(self.spark, sql, {k: known[k]() for k in sqlgate.tables_of(self.spark, sql, known)}, limit)

    def _attributes(self) -> DataFrame:
        return self.events().withColumn("attrs", F.from_json("attributes", "map<string,string>"))

    def _attr(self, name: str):
        return F.try_element_at("attrs", F.lit(name))

    def services(self) -> DataFrame:
        return views.services(self._attributes(), status=self._attr("status"), ai=X.has_tags(F.col("flux_tags"), S.AI))

    def spans(self) -> DataFrame:
        rows = self._attributes()
        ms = F.unix_micros(F.to_timestamp("ts")) / 1000.0
        return rows.select(
            F.coalesce(self._attr("trace_id"), "subject").alias("trace_id"), F.coalesce(self._attr("span_id"), "event_hash").alias("span_id"), self._attr("parent_span_id").alias("parent_id"),
            F.col("source_id").alias("service"), "action", ms.alias("start_ms"), F.coalesce(self._attr("duration_ms").try_cast("double"), F.lit(0.0)).alias("duration_ms"), F.coalesce(self._attr("status"), F.lit("ok")).alias("status"), "ts", "raw",
        )

    def trace_summaries(self, service: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
        return views.trace_summary(self.spans().where("trace_id <> ''"), service, status, limit)

    def trace_tree(self, trace_id: str) -> DataFrame:
        spans = self.spans().where(F.col("trace_id") == trace_id)
        return views.waterfall(spans.where(~F.col("action").startswith("log."))).join(spans.select("span_id", "service", "action", "start_ms", "duration_ms", "status").dropDuplicates(["span_id"]), "span_id").orderBy("position")

    def logs(self, **filters) -> DataFrame:
        rows = self._attributes().select(F.col("event_hash").alias("id"), F.col("source_id").alias("service"), "action", "ts", "raw", F.coalesce(self._attr("trace_id"), "subject").alias("trace_id"), self._attr("span_id").alias("span_id"), F.coalesce(self._attr("severity"), F.regexp_extract("action", r"^log\.(.*)$", 1)).alias("severity"))
        return views.logs(rows, **filters)

    def span(self, span_id: str) -> DataFrame:
        logs = self._attributes().where(F.col("action").startswith("log.")).select(self._attr("span_id").alias("span_id"), "ts", "action", "raw")
        return views.get_span(self.spans().where(~F.col("action").startswith("log.")), logs, span_id)

    def ai_calls(self, service: str | None = None, model: str | None = None, limit: int = 100) -> DataFrame:
        rows = self._attributes().withColumn("ai", otlp.ai_metadata(F.col("attrs"))).where("ai is not null")
        return views.ai_calls(rows.select(F.col("event_hash").alias("id"), F.col("source_id").alias("service"), "ts", "ai.*"), service, model, limit)

    def status(self) -> dict:
        return self.store.status() | {"ledger": len(self.ledger.records), "head": self.ledger.head}

    def verify(self) -> dict:
        """Chains, roots and links of the log, hashes of sealed files, and the ledger with its stored copy."""
        rows = self.store.verify().collect()
        bad = ledger.verify_ledger(self.ledger.frame(self.spark)).where("not (hash_ok and link_ok and seq_ok)").count() if self.ledger.records else 0
        stored = self.store.load("ledger")
        head = S.GENESIS if stored is None else stored.agg(F.max_by("record_hash", "seq")).first()[0]
        links = ledger.verify_segments(self.store.manifest()).where("not link_ok").count()
        return {"segments": len(rows), "ok": all(r.ok for r in rows) and not bad and not links and head == self.ledger.head, "bad_segments": [r.segment for r in rows if not r.ok], "bad_records": bad, "bad_links": links}

    def export_ledger(self, path: str) -> str:
        """The ledger as JSON lines; returns its head."""
        return self.ledger.export(self.spark, path)
