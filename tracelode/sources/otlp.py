"""OpenTelemetry traces and logs in JSON, flattened with nested schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AI_ALIASES

_VALUE = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRS}>"
TRACES = (
    f"struct<resourceSpans:array<struct<{_RESOURCE},scopeSpans:array<struct<scope:struct<name:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,"
    f"name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string,message:string>>>>>>>>"
)
LOGS = (
    f"struct<resourceLogs:array<struct<{_RESOURCE},scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,"
    f"severityText:string,body:{_VALUE},attributes:{_ATTRS},traceId:string,spanId:string>>>>>>>"
)


def normalize_id(value: Column, nbytes: int) -> Column:
    """Hex of the exact length, lower-cased; else base64 of the exact length as hex; else the text, lower-cased."""
    decoded = F.try_to_binary(value, F.lit("base64"))
    return F.when(value.rlike(f"^[0-9a-fA-F]{{{2 * nbytes}}}$"), F.lower(value)).when(F.octet_length(decoded) == nbytes, F.lower(F.hex(decoded))).otherwise(F.lower(value))


def any_value(value: Column) -> Column:
    """A tagged value as text: scalars as written, arrays and lists as their JSON."""
    return F.coalesce(*[value[f] for f in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")])


def attribute_map(items: Column) -> Column:
    """Key-value list to a map; the last of repeated keys wins, null values go."""
    items = F.filter(F.coalesce(items, F.array().cast(_ATTRS)), lambda x: x["key"].isNotNull() & any_value(x["value"]).isNotNull())
    keys = F.transform(items, lambda x: x["key"])
    last = F.filter(items, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), x["key"]))
    return F.map_from_arrays(F.transform(last, lambda x: x["key"]), F.transform(last, lambda x: any_value(x["value"])))


def merge_maps(*maps: Column) -> Column:
    """Maps laid over each other, later ones winning."""
    out = maps[0]
    for m in maps[1:]:
        out = _over(out, m)
    return out


def _over(below: Column, above: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def nanos_to_timestamp(value: Column) -> Column:
    """Nanoseconds, as a number or text, to a time; ISO text passes."""
    return F.coalesce(F.timestamp_micros(F.floor(value.try_cast("decimal(20,0)") / 1000).cast("long")), F.try_to_timestamp(value))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _get(attrs: Column, names) -> Column:
    return F.coalesce(*[F.try_element_at(attrs, F.lit(n)) for n in names])


def first_truthy(attrs: Column, names) -> Column:
    """The first value under these names that is neither empty, zero nor false."""

    def value(n: str) -> Column:
        v = F.try_element_at(attrs, F.lit(n))
        return F.when(v.isNotNull() & ~F.lower(v).isin("", "0", "0.0", "false"), v)

    return F.coalesce(*[value(n) for n in names])


def ai_metadata(attrs: Column) -> Column:
    """Struct of an AI call's provider, model, previews and token counts; null where no attribute tells of one."""
    got = {k: first_truthy(attrs, names) for k, names in AI_ALIASES.items()}
    count = lambda k: F.coalesce(got[k].try_cast("double").cast("long"), F.lit(0).cast("long"))
    preview = lambda c: F.when(F.length(c) > 120, F.concat(F.substring(c, 1, 120), F.lit("..."))).otherwise(c)
    total = F.coalesce(got["total_tokens"].try_cast("double").cast("long"), count("input_tokens") + count("output_tokens"))
    any_ = F.coalesce(*[got[k] for k in ("provider", "model", "prompt", "completion", "input_tokens", "output_tokens")]).isNotNull()
    body = F.struct(got["provider"].alias("provider"), got["model"].alias("model"), preview(got["prompt"]).alias("prompt"), preview(got["completion"]).alias("completion"), count("input_tokens").alias("input_tokens"), count("output_tokens").alias("output_tokens"), total.alias("total_tokens"))
    return F.when(any_, body)


def _host(attrs: Column) -> Column:
    return F.coalesce(_get(attrs, ("host.name", "host.id", "service.instance.id")), F.lit("localhost"))


def parse_traces(payloads: DataFrame) -> DataFrame:
    """Spans of trace payloads (column ``body``) as events: resource, span and derived attributes merged in that order."""
    rows = payloads.select(F.from_json("body", TRACES).alias("p")).select(F.explode("p.resourceSpans").alias("r"))
    rows = rows.select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s"))
    rows = rows.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("span"))
    trace, span, parent = normalize_id(F.col("span.traceId"), 16), normalize_id(F.col("span.spanId"), 8), normalize_id(F.col("span.parentSpanId"), 8)
    start, end = (F.col(f"span.{c}").try_cast("decimal(20,0)") for c in ("startTimeUnixNano", "endTimeUnixNano"))
    duration = F.greatest(F.lit(0.0), (end - start).cast("double") / 1e6)
    own = attribute_map(F.col("span.attributes"))
    rows = rows.select("resource", "scope", own.alias("own"), trace.alias("trace_id"), span.alias("span_id"), F.when(F.col("span.parentSpanId") != "", parent).alias("parent_span_id"), F.col("span.name").alias("name"), nanos_to_timestamp(F.col("span.startTimeUnixNano")).alias("ts"), F.coalesce(duration, F.lit(0.0)).alias("duration_ms"), F.when(F.col("span.status.code").isin("2", "STATUS_CODE_ERROR"), "error").otherwise("ok").alias("status"))
    derived = F.map_filter(F.create_map(F.lit("trace_id"), F.col("trace_id"), F.lit("span_id"), F.col("span_id"), F.lit("parent_span_id"), F.col("parent_span_id"), F.lit("duration_ms"), F.col("duration_ms").cast("string"), F.lit("status"), F.col("status")), lambda k, v: v.isNotNull())
    attrs = merge_maps(F.col("resource"), F.col("own"), derived)
    rows = rows.withColumn("attributes", attrs)
    return rows.select(
        F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("otlp")).alias("source_id"), _host(F.col("attributes")).alias("host"), iso(F.col("ts")).alias("ts"),
        F.col("name").alias("action"), F.col("trace_id").alias("subject"), F.coalesce(_get(F.col("attributes"), ("http.target", "http.route", "db.system", "rpc.method")), F.col("name")).alias("object"),
        F.col("trace_id").alias("session_id"), F.coalesce("parent_span_id", "span_id").alias("session_root"), "span_id", "parent_span_id", "duration_ms", "status", "attributes", ai_metadata(F.col("attributes")).alias("ai"),
    )


def parse_logs(payloads: DataFrame) -> DataFrame:
    """Log records (column ``body``) as ``log.<severity>`` events; the observed time stands in for a missing one."""
    rows = payloads.select(F.from_json("body", LOGS).alias("p")).select(F.explode("p.resourceLogs").alias("r"))
    rows = rows.select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    rows = rows.select("resource", F.explode("s.logRecords").alias("log"))
    severity = F.lower(F.coalesce(F.nullif(F.col("log.severityText"), F.lit("")), F.lit("info")))
    trace, span = normalize_id(F.col("log.traceId"), 16), normalize_id(F.col("log.spanId"), 8)
    time = F.when(F.coalesce(F.col("log.timeUnixNano"), F.lit("0")) != "0", F.col("log.timeUnixNano")).otherwise(F.col("log.observedTimeUnixNano"))
    derived = F.map_filter(F.create_map(F.lit("trace_id"), trace, F.lit("span_id"), span, F.lit("severity"), F.upper(severity)), lambda k, v: v.isNotNull())
    attrs = merge_maps(F.col("resource"), attribute_map(F.col("log.attributes")), derived)
    body = any_value(F.col("log.body"))
    return rows.select(
        F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("otlp")).alias("source_id"), _host(attrs).alias("host"), iso(nanos_to_timestamp(time)).alias("ts"),
        F.concat(F.lit("log."), severity).alias("action"), trace.alias("subject"), trace.alias("session_id"), span.alias("span_id"),
        F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.coalesce(body, F.lit(""))).alias("raw"), attrs.alias("attributes"),
    )
