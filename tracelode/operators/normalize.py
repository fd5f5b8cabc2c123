"""Raw records to events: one projection, with the reasons of rejected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X

# Top-level fields that are folded into the attributes.
FOLDED = ("session_id", "beacon_id", "session_root", "root_pid", "tokens", "technique_ids", "techniques", "indicators", "entities", "event_id")
RESERVED = "_ingest"


def coerce_ts(value: Column) -> Column:
    """Finite epoch numbers to ISO in UTC; ISO text with a zone as it is; null for anything else."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    epoch = F.date_format(F.timestamp_micros(F.round(F.when(finite, number) * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    zoned = value.rlike(r"(Z|z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(value).isNotNull()
    return F.when(number.isNotNull(), F.when(finite, epoch)).when(zoned, value)


def _get(name: str) -> Column:
    return F.try_element_at(F.col("record"), F.lit(name))


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(_get(name)) == "", F.lit(True))


def problems() -> Column:
    """Why a record can't be an event: names of missing or bad fields, comma-joined; empty if it can."""
    seq = _get("source_seq")
    number = seq.try_cast("decimal(38,0)")
    bad_seq = seq.isNotNull() & (number.isNull() | (number < 0) | (number >= F.lit("9223372036854775808").cast("decimal(38,0)")) | ~seq.rlike(r"^\d+$"))
    attributes = _get("attributes")
    bad_attributes = attributes.isNotNull() & F.from_json(attributes, "map<string,string>").isNull()
    checks = {
        "record": F.col("record").isNull(), "ts": F.coalesce(coerce_ts(_get("ts")).isNull(), F.lit(True)), "host": _blank("host"), "action": _blank("action"),
        "source_seq": F.coalesce(bad_seq, F.lit(False)), "attributes": F.coalesce(bad_attributes, F.lit(False)),
    }
    return F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in checks.items()])


def attributes_of() -> Column:
    """Given attributes with the folded top-level fields, as a map of text."""
    given = F.coalesce(F.from_json(_get("attributes"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    folded = F.map_filter("record", lambda k, v: k.isin(*FOLDED) & v.isNotNull())
    return F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(folded, k)), folded)


def event_hash() -> Column:
    """sha2 over the canonical fields; the time of ingest and the tags are not part of it."""
    names = ("ts", "host", "source_id", "source_seq", "subject", "object", "action", "attributes", "template_hash", "raw")
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def short_hash(*fields, separator: str) -> Column:
    """32 hex digits of sha256 over fields joined by a separator, nulls empty: the hash of an event that comes without one."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields]).cast("binary"), 256), 1, 32)


def tokens_or(tokens: Column, template: Column, action: Column, klass: Column) -> Column:
    """Given tokens; else the template's hash; else action and object class."""
    return F.coalesce(tokens, F.when(template.isNotNull(), F.array(template)), F.array(F.concat_ws(":", F.lower(action), klass)))


def content_fingerprint() -> Column:
    """An event without its hash, sequence and ingest time, and without reserved attributes."""
    attributes = F.map_filter(F.from_json("attributes", "map<string,string>"), lambda k, v: k != RESERVED)
    names = ("ts", "host", "source_id", "subject", "object", "action", "template_hash", "raw", "flux_tags")
    return F.sha2(F.to_json(F.struct(X.canonical_map(attributes).alias("attributes"), *names), {"ignoreNullFields": "false"}).cast("binary"), 256)


def normalize(records: DataFrame, ingest_ts: str, deviation: bool = True) -> tuple[DataFrame, DataFrame]:
    """``records`` (``record`` map, ``source_id``, ``source_seq``) to events and rejected records with reasons.

    Entropy and compression are taken of the raw text, or of the dumped record where there is none.
    """
    rows = records.withColumn("problems", problems())
    rejected = rows.where("problems <> ''").select("record", "source_id", "problems")
    rows = rows.where("problems = ''")
    dumped = lambda c: F.coalesce(c, F.lit(""))
    seq = F.coalesce(_get("source_seq").cast("long"), F.col("source_seq") if "source_seq" in records.columns else F.lit(None).cast("long"))
    raw = F.coalesce(F.nullif(_get("raw"), F.lit("")), X.canonical_map(F.col("record")))
    template = F.coalesce(F.nullif(_get("template"), F.lit("")), F.nullif(_get("raw"), F.lit("")), F.concat_ws(" ", _get("action"), _get("object")))
    klass = F.coalesce(_get("object_class"), F.when(_get("object").contains(":"), F.substring_index(_get("object"), ":", 1)), F.lit("entity"))
    rows = rows.select(
        coerce_ts(_get("ts")).alias("ts"), F.lit(ingest_ts).alias("ingest_ts"), _get("host").alias("host"), F.coalesce(_get("source_id"), "source_id").alias("source_id"), seq.alias("source_seq"),
        dumped(_get("subject")).alias("subject"), dumped(_get("object")).alias("object"), _get("action").alias("action"), attributes_of().alias("attrs"),
        X.template_hash(_get("action"), klass, template).alias("template_hash"), raw.alias("raw"), dumped(_get("raw")).alias("given_raw"),
    )
    anomaly = F.lit(False)
    if deviation:
        rows = rows.withColumn("deviation", X.compression_deviation("raw"))
        anomaly = F.col("deviation.anomalous")
        known = F.coalesce(F.try_element_at("attrs", F.lit("anomaly_score")).try_cast("double"), F.lit(0.0))
        stamp = F.map_from_arrays(
            F.array(F.lit("anomaly_score"), F.lit("byte_entropy"), F.lit("compression_ratio")),
            F.array(F.greatest(known, F.lit(S.ANOMALY_SCORE)).cast("string"), F.round("deviation.entropy", 3).cast("string"), F.round("deviation.ratio", 3).cast("string")),
        )
        stamped = F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key(stamp, k)), stamp)
        rows = rows.withColumn("attrs", F.when(anomaly, stamped).otherwise(F.col("attrs")))
    rows = rows.withColumn("flux_tags", X.flux_tags(F.col("action"), F.col("given_raw"), F.col("attrs"), anomaly))
    rows = rows.withColumn("attributes", X.canonical_map(F.col("attrs")))
    return rows.withColumn("event_hash", event_hash()).select(*S.EVENT_COLUMNS), rejected


def adapt(events: DataFrame) -> DataFrame:
    """Events to what assembly needs: epoch seconds, anchor, tokens, techniques, indicators, entities."""
    rows = events.withColumn("attrs", F.from_json("attributes", "map<string,string>"))
    strings = lambda k: F.from_json(F.try_element_at("attrs", F.lit(k)), "array<string>")
    one = lambda k: F.when(F.try_element_at("attrs", F.lit(k)).isNotNull(), F.array(F.try_element_at("attrs", F.lit(k))))
    empty = F.array().cast("array<string>")
    techniques = F.coalesce(strings("technique_ids"), strings("techniques"), one("technique_ids"), one("techniques"), empty)
    indicators = F.coalesce(F.from_json(F.try_element_at("attrs", F.lit("indicators")), "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    return rows.select(
        "*", (F.unix_micros(F.to_timestamp("ts")) / 1e6).alias("ts_epoch"), anchor(F.col("host"), F.col("attrs"), F.col("subject")).alias("anchor"),
        F.coalesce(strings("tokens"), X.event_tokens(F.col("raw"))).alias("tokens"), F.array_distinct(techniques).alias("techniques"),
        F.map_filter(F.transform_values(indicators, lambda k, v: F.array_compact(F.array_distinct(v))), lambda k, v: F.size(v) > 0).alias("indicators"),
        F.array_distinct(F.array_compact(F.concat(F.coalesce(strings("entities"), empty), F.array(F.nullif(F.col("subject"), F.lit("")), F.nullif(F.col("object"), F.lit("")))))).alias("entities"),
    )


def anchor(host: Column, attributes: Column, subject: Column) -> Column:
    """Trace key: session, then beacon, then session root, then root process, then the subject's process."""
    get = lambda k: F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit(""))
    session = F.coalesce(get("session_id"), get("beacon_id"))
    root = F.coalesce(get("session_root"), get("root_pid"))
    process = F.coalesce(F.get_json_object(subject, "$.id"), F.get_json_object(subject, "$.pid"), get("process_id"), get("pid"), F.nullif(subject, F.lit("")), F.lit("default"))
    return F.when(session.isNotNull(), F.concat_ws(":", F.lit("session"), host, session)).otherwise(F.concat_ws(":", F.lit("host"), host, F.coalesce(root, process)))


def edge_score(action: Column, target: Column) -> Column:
    """Anomaly of an edge of a process: the object's type by substring, then a lookup of twelve rows."""
    o, a = F.lower(F.coalesce(target, F.lit(""))), F.lower(F.coalesce(action, F.lit("")))
    has = lambda *words: X.contains_any(o, words)
    kind = F.when(has("raw_socket"), "raw_socket").when(has("sock", ":", "http", "ip"), "socket").when(has("proc", "pid"), "process").when(has("mem", "shm"), "memory").when(has("reg"), "registry").otherwise("file")
    out = F.lit(S.EDGE_DEFAULT)
    for (act, of), score in S.EDGE_SCORES.items():
        out = F.when((a == act) & (kind == of), F.lit(score)).otherwise(out)
    return out
