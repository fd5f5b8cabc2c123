"""Telemetry read models: services, trace summaries, waterfalls, AI calls, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def services(events: DataFrame, source: str = "source_id", status: Column | None = None, ai: Column | None = None) -> DataFrame:
    """``service, events, errors, ai_calls`` by events, then name."""
    status = F.lit(None).cast("string") if status is None else status
    ai = F.lit(False) if ai is None else ai
    error = (F.lower(F.coalesce(status, F.lit(""))) == "error") | F.col("action").startswith("log.error")
    rows = events.groupBy(F.col(source).alias("service")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(error, 1).otherwise(0)).alias("errors"), F.sum(F.when(ai, 1).otherwise(0)).alias("ai_calls"))
    return rows.orderBy(F.col("events").desc(), "service")


def trace_summary(spans: DataFrame, service: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """One row a trace from spans ``trace_id, span_id, parent_id, service, action, start_ms, duration_ms, status``.

    ``log.*`` rows count only where a trace has nothing else. The root is the first span without a
    parent. Filters apply to whole traces.
    """
    is_log = F.col("action").startswith("log.")
    only_logs = F.min(F.when(is_log, 1).otherwise(0)).over(Window.partitionBy("trace_id")) == 1
    rows = spans.withColumn("__only", only_logs).where(F.col("__only") | ~is_log)
    order = F.struct("start_ms", "span_id")
    by = rows.groupBy("trace_id").agg(
        F.min("start_ms").alias("start_ms"), F.count(F.lit(1)).alias("spans"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"),
        F.min_by("duration_ms", order).alias("first_duration"), F.max_by("duration_ms", order).alias("last_duration"), F.max("start_ms").alias("last_start"),
        F.min_by(F.struct("service", "action"), F.when(F.col("parent_id").isNull(), order)).alias("root"), F.min_by(F.struct("service", "action"), order).alias("first"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"),
    )
    root = F.coalesce("root", "first")
    duration = F.round(F.greatest("first_duration", F.col("last_start") - F.col("start_ms") + F.col("last_duration")), 2)
    out = by.select("trace_id", root["service"].alias("service"), root["action"].alias("root"), "start_ms", duration.alias("duration_ms"), "spans", "errors", F.when(F.col("errors") > 0, "error").otherwise("ok").alias("status"), "services")
    if service is not None:
        out = out.where(F.array_contains(F.split("services", ","), service))
    if status is not None:
        out = out.where(F.col("status") == status)
    out = out.orderBy(F.col("start_ms").desc(), "trace_id")
    return out if limit is None else out.limit(limit)


def waterfall(spans: DataFrame) -> DataFrame:
    """Spans of each trace in depth-first order: ``trace_id, position, depth, span_id, offset_pct, width_pct``.

    Children are ordered by start; a span whose parent is missing is a root, and so are the spans of
    a cycle of parents and below it. A span's place is its path of ranks from the root; paths double
    in length each round, all traces at once, so a trace of any depth takes as many rounds as its
    number of spans has bits.
    """
    rows = spans.dropDuplicates(["trace_id", "span_id"]).select("trace_id", "span_id", "parent_id", "start_ms", "duration_ms")
    known = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(1).alias("known"))
    rows = rows.join(known, ["trace_id", "parent_id"], "left").withColumn("parent_id", F.when((F.col("known") == 1) & (F.col("parent_id") != F.col("span_id")), F.col("parent_id"))).drop("known")
    rank = F.row_number().over(Window.partitionBy("trace_id", "parent_id").orderBy("start_ms", "span_id"))
    rows = cut(rows.withColumn("key", F.lpad(rank.cast("string"), 9, "0")), "spans")
    most = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    at = rows.select("trace_id", "span_id", F.col("parent_id").alias("above"), F.col("key").alias("path"), F.lit(0).alias("depth"))
    for round_ in range(int(most).bit_length()):
        up = at.select("trace_id", F.col("span_id").alias("above"), F.col("above").alias("further"), F.col("path").alias("head"), F.col("depth").alias("more"))
        climbed = F.col("above").isNotNull()
        at = at.join(up, ["trace_id", "above"], "left").select(
            "trace_id", "span_id", F.col("further").alias("above"), F.when(climbed, F.concat_ws("/", "head", "path")).otherwise(F.col("path")).alias("path"),
            F.when(climbed, F.col("depth") + F.col("more") + 1).otherwise(F.col("depth")).alias("depth"),
        )
        if round_ % 3 == 2:
            at = cut(at, "paths")
    # what still has a span above is on a cycle or below one
    rooted = F.col("above").isNull()
    placed = at.join(rows.select("trace_id", "span_id", "key", "start_ms", "duration_ms"), ["trace_id", "span_id"])
    placed = placed.withColumn("depth", F.when(rooted, F.col("depth")).otherwise(0)).withColumn("path", F.when(rooted, F.col("path")).otherwise(F.concat(F.lit("~"), "key", F.col("span_id").cast("string"))))
    w = Window.partitionBy("trace_id")
    t0, t1 = F.min("start_ms").over(w), F.max(F.col("start_ms") + F.col("duration_ms")).over(w)
    total = F.greatest(t1 - t0, F.lit(1e-9))
    offset = F.least(F.lit(99.0), F.round((F.col("start_ms") - t0) / total * 100, 2))
    width = F.greatest(F.lit(1.0), F.round(F.col("duration_ms") / total * 100, 2))
    position = F.row_number().over(w.orderBy("path"))
    return placed.select("trace_id", position.cast("long").alias("position"), F.col("depth").cast("long").alias("depth"), "span_id", offset.alias("offset_pct"), F.least(width, 100 - offset + 1).alias("width_pct"))


def attach_logs(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Spans with their logs (time, action, raw) in order, an empty array without any."""
    by = logs.groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("ts", "action", "raw"))).alias("logs"))
    return spans.join(by, "span_id", "left").withColumn("logs", F.coalesce("logs", F.array().cast("array<struct<ts:string,action:string,raw:string>>")))


def get_span(spans: DataFrame, logs: DataFrame, span_id: str) -> DataFrame:
    """The last span of an id with its logs."""
    one = spans.where(F.col("span_id") == span_id).orderBy(F.col("ts").desc()).limit(1)
    return attach_logs(one, logs.where(F.col("span_id") == span_id))


def ai_calls(calls: DataFrame, service: str | None = None, model: str | None = None, limit: int = 100, ts: str = "ts") -> DataFrame:
    """AI calls of a service and of models whose name holds a text, newest first, ties by id."""
    if service is not None:
        calls = calls.where(F.col("service") == service)
    if model is not None:
        calls = calls.where(F.contains(F.lower("model"), F.lit(model.lower())))
    return calls.orderBy(F.col(ts).desc(), "id").limit(limit)


def logs(events: DataFrame, service: str | None = None, trace_id=None, span_id=None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """``log.*`` events by service, trace, span and severity, newest first, ties by id."""
    rows = events.where(F.col("action").startswith("log."))
    for column, value in (("service", service), ("trace_id", trace_id), ("span_id", span_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if severity is not None:
        rows = rows.where(F.lower("severity") == severity.lower())
    return rows.orderBy(F.col("ts").desc(), "id").limit(limit)


def checkpoints(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id").agg(F.max("source_seq").alias("max_seq"))
