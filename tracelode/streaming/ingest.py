"""Idempotent ingest of micro-batches, and sessions as streaming state."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.graph import cut, spent
from ..operators.normalize import content_fingerprint, normalize
from ..operators.store import Store

RECEIPTS = "identity string, source_id string, source_seq long, event_id string, fingerprint string"


class Conflict(ValueError):
    """An identity or sequence that is taken by other content."""


def resolve(batch: DataFrame, receipts: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch against what is stored: (rows to write with their sequence, conflicts with reasons).

    ``batch``: position, request_id, event_id, source_id, explicit_seq, fingerprint. Identity is the
    event id, else source and explicit sequence, else the request and position, else the content.
    Equal content under a known identity is a duplicate and goes; other content is a conflict.
    Missing sequences go on from the source's checkpoint in order of position.
    """
    identity = F.coalesce(
        F.concat(F.lit("event:"), "source_id", F.lit(":"), "event_id"), F.concat(F.lit("seq:"), "source_id", F.lit(":"), F.col("explicit_seq").cast("string")),
        F.concat(F.lit("request:"), "request_id", F.lit(":"), "source_id", F.lit(":"), F.col("position").cast("string")), F.concat(F.lit("content:"), "fingerprint"),
    )
    rows = batch.withColumn("identity", identity)
    first = F.row_number().over(Window.partitionBy("identity").orderBy("position"))
    head = F.first("fingerprint").over(Window.partitionBy("identity").orderBy("position"))
    rows = rows.withColumn("place", first).withColumn("head", head)
    known = receipts.select("identity", F.col("fingerprint").alias("known"))
    rows = rows.join(known, "identity", "left")
    clash = F.when(F.col("known").isNotNull() & (F.col("known") != F.col("fingerprint")), F.lit("identity is taken")).when(F.col("head") != F.col("fingerprint"), F.lit("identity twice in the batch"))
    rows = rows.withColumn("conflict", clash)
    fresh = rows.where("known is null and place = 1 and conflict is null")
    last = checkpoints.select("source_id", "max_seq")
    fresh = fresh.join(last, "source_id", "left")
    w = Window.partitionBy("source_id").orderBy("position")
    base = F.last(F.when(F.col("explicit_seq").isNotNull(), F.col("explicit_seq") - F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fresh = fresh.withColumn("n", F.row_number().over(w)).withColumn("source_seq", (F.col("n") + F.coalesce(base, F.col("max_seq"), F.lit(-1))).cast("long"))
    taken = receipts.select("source_id", "source_seq", F.col("fingerprint").alias("holder"))
    fresh = fresh.join(taken, ["source_id", "source_seq"], "left").withColumn("conflict", F.when(F.col("holder").isNotNull() & (F.col("holder") != F.col("fingerprint")), F.lit("sequence is taken")))
    twice = F.count(F.lit(1)).over(Window.partitionBy("source_id", "source_seq"))
    fresh = fresh.withColumn("conflict", F.when(twice > 1, F.lit("sequence twice in the batch")).otherwise(F.col("conflict"))).where("holder is null or conflict is not null")
    conflicts = rows.where("conflict is not null").select("position", "identity", "conflict").unionByName(fresh.where("conflict is not null").select("position", "identity", "conflict"))
    return fresh.where("conflict is null").select("position", "identity", "source_id", "source_seq", "event_id", "fingerprint"), conflicts


class Ingest:
    """Batches of raw records into a store, each exactly once. A batch is checked whole before it is written.

    Receipts are written before the events, and count from the moment the batch is in the manifest, so
    a crash at any place leaves a batch that is either whole or not there. After a failed write the
    next one recovers the store first.
    """

    def __init__(self, spark: SparkSession, store: Store) -> None:
        self.spark, self.store, self.failed = spark, store, False

    def receipts(self) -> DataFrame:
        """Receipts of batches in the manifest."""
        if not self.store._exists("receipts"):  # noqa: SLF001
            return self.spark.createDataFrame([], RECEIPTS)
        rows = self.spark.read.schema(RECEIPTS + ", batch string").parquet(f"{self.store.path}/receipts")
        return rows.join(F.broadcast(self.store.manifest().select("batch").distinct()), "batch", "left_semi").drop("batch")

    def write(self, records: DataFrame, batch_id: str, ingest_ts: str = "1970-01-01T00:00:00Z") -> int:
        """``records``: record, source_id, position. Returns the number of new events; a retried batch adds none."""
        if self.failed:
            self.store.recover()
            self.failed = False
        events, rejected = normalize(records.withColumn("source_seq", F.lit(None).cast("long")), ingest_ts)
        bad = rejected.limit(1).collect()
        if bad:
            raise ValueError(f"bad record: {bad[0].problems}")
        keyed = events.withColumn("fingerprint", content_fingerprint()).withColumn("attrs", F.from_json("attributes", "map<string,string>"))
        order = Window.partitionBy("source_id").orderBy("ts", "event_hash")
        keyed = keyed.withColumn("position", F.row_number().over(order).cast("long")).withColumn("event_id", F.try_element_at("attrs", F.lit("event_id")))
        keyed = cut(keyed.drop("attrs"), "keyed")
        batch = keyed.select("position", F.lit(batch_id).alias("request_id"), "event_id", "source_id", F.col("source_seq").alias("explicit_seq"), "fingerprint")
        with self.store.lock():
            seen = self.receipts()
            fresh, conflicts = resolve(batch, seen, seen.groupBy("source_id").agg(F.max("source_seq").alias("max_seq")))
            clash = conflicts.limit(1).collect()
            if clash:
                raise Conflict(f"{clash[0].conflict}: {clash[0].identity}")
            fresh = cut(fresh, "fresh")
            n = fresh.count()
            if n:
                name = "batch-" + (batch_id if re.fullmatch(r"[\w.-]+", batch_id) else hashlib.sha256(batch_id.encode()).hexdigest())
                self.failed = True
                fresh.select("identity", "source_id", "source_seq", "event_id", "fingerprint").write.mode("overwrite").parquet(f"{self.store.path}/receipts/batch={name}")
                rows = keyed.drop("source_seq", "fingerprint", "event_id").join(fresh.select("source_id", "position", "source_seq"), ["source_id", "position"])
                self.store.append(rows, name, n)
                self.failed = False
            spent(keyed, fresh)
        return n

    def stream(self, lines: DataFrame, checkpoint: str, source_id: str = "stream"):
        """A stream of JSON lines (column ``value``) into the store; a replayed micro-batch is written once."""
        from ..sources.readers import parse_lines

        def each(df: DataFrame, epoch: int) -> None:
            rows = df.where(F.trim("value") != "").withColumn("position", F.monotonically_increasing_id())
            if not rows.isEmpty():
                self.write(parse_lines(rows, source_id), f"{source_id}-{epoch}")

        return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("last", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("n", T.LongType())])
OUT = "key string, session long, start_us long, end_us long, events long, sealed boolean"


def session_stream(events: DataFrame, key: str, micros: str, idle_s: int = S.IDLE_SECONDS, max_s: int = S.MAX_TRACE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Sessions as state per key: one row for each session a micro-batch closes or extends.

    Events of a micro-batch are taken in order of time. One that is older than the open session joins
    it and widens its start; a sealed session never opens again. A session that stays idle is sealed
    by a timer of event time: when the watermark, ``late`` behind the newest event, passes its end by
    the idle gap.
    """
    idle, most = idle_s * 1_000_000, max_s * 1_000_000

    def fold(k, frames, state):
        start, last, idx, n = state.get if state.exists else (None, None, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], idx, start, last, n, True))
            state.update((None, last, idx + 1, 0))
        else:
            times = sorted(t for pdf in frames for t in pdf["us"].tolist())
            for t in times:
                if start is not None and (t - last > idle or t - min(start, t) > most):
                    out.append((k[0], idx, start, last, n, True))
                    start, idx, n = None, idx + 1, 0
                if start is None:
                    start = last = t
                start, last, n = min(start, t), max(last, t), n + 1
            state.update((start, last, idx, n))
            state.setTimeoutTimestamp(max((last + idle) // 1000 + 1, state.getCurrentWatermarkMs()) + 1)
            out.append((k[0], idx, start, last, n, False))
        yield pd.DataFrame(out, columns=["key", "session", "start_us", "end_us", "events", "sealed"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(micros).alias("us"), F.timestamp_micros(F.col(micros) + 1000).alias("at"))
    rows = rows.withWatermark("at", late)  # a millisecond on, as the first watermark is the epoch and what isn't after it counts as late
    return rows.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "update", "EventTimeTimeout")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "15 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and key with a watermark; ``slide`` makes windows overlap."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
