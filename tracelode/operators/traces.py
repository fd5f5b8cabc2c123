"""Sessions, trace features and sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from .graph import cut, spent
from .normalize import edge_score


def sessionize_idle(events: DataFrame, key: str, micros: str, order: str, idle_s: int = S.IDLE_SECONDS) -> DataFrame:
    """Adds ``session``: a new one after a gap over ``idle_s``. Windows only, by key."""
    w = Window.partitionBy(key).orderBy(micros, order)
    gap = F.col(micros) - F.lag(micros).over(w)
    start = F.when(gap > idle_s * 1_000_000, 1).otherwise(0)
    return events.withColumn("__new", start).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def sessionize(events: DataFrame, key: str, micros: str, order: str, idle_s: int = S.IDLE_SECONDS, max_s: int = S.MAX_TRACE_SECONDS) -> DataFrame:
    """Adds ``session``: a new one after a gap over ``idle_s`` or when the session would pass ``max_s``.

    The length limit depends on where the last session began, so it is a fold; it runs per run of
    events without an idle gap, which windows find first: a key's events are never gathered whole,
    only those of one run, as (time, order) pairs.
    """
    runs = sessionize_idle(events, key, micros, order, idle_s).withColumnRenamed("session", "__run")
    w = Window.partitionBy(key, "__run").orderBy(micros, order)
    span = Window.partitionBy(key, "__run")
    runs = runs.withColumn("__long", F.max(micros).over(span) - F.min(micros).over(span) > max_s * 1_000_000)
    runs = runs.withColumn("__pos", F.row_number().over(w))
    limit = F.lit(max_s * 1_000_000)
    state = F.struct(F.lit(None).cast("long").alias("start"), F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"))

    def step(s: Column, t: Column) -> Column:
        cut = s["start"].isNull() | (t - s["start"] > limit)
        return F.struct(F.when(cut, t).otherwise(s["start"]).alias("start"), F.when(cut & s["start"].isNotNull(), F.concat(s["cuts"], F.array(s["i"] + 1))).otherwise(s["cuts"]).alias("cuts"), (s["i"] + 1).alias("i"))

    cuts = runs.where("__long").groupBy(key, "__run").agg(F.array_sort(F.collect_list(micros)).alias("times"))
    cuts = cuts.select(key, "__run", F.aggregate("times", state, step, lambda s: s["cuts"]).alias("cuts"))
    # cut positions are ordinal; runs without one are joined to nothing
    rows = runs.join(cuts, [key, "__run"], "left")
    part = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("__pos"))), F.lit(0))
    rows = rows.withColumn("__part", part)
    place = Window.partitionBy(key).orderBy(micros, order)
    changed = (F.lag("__run").over(place) != F.col("__run")) | (F.lag("__part").over(place) != F.col("__part"))
    rows = rows.withColumn("__new", F.when(changed, 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("__new").over(place.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.drop("__run", "__long", "__pos", "cuts", "__part", "__new")


def seal_idle(sessions: DataFrame, now: Column, last: str = "end_us", idle_s: int = S.IDLE_SECONDS) -> DataFrame:
    """Adds ``sealed``: whether a session has been idle for longer than ``idle_s`` at a time in microseconds."""
    return sessions.withColumn("sealed", now - F.col(last) > F.lit(idle_s * 1_000_000))


def trace_features(events: DataFrame, trace: str = "trace_id") -> DataFrame:
    """One row a trace: counts, spans of time, sets and the sketch. Every part merges.

    Counters are maps built from partial counts, the sketch is 128 minima: each (trace, slot) is a
    group, so traces of any length are aggregated without being gathered.
    """
    base = events.groupBy(trace).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts_epoch").alias("start_ts"), F.max("ts_epoch").alias("end_ts"),
        F.sum(edge_score(F.col("action"), F.col("object"))).alias("anomaly_sum"), F.sum(F.when(edge_score(F.col("action"), F.col("object")) >= S.EDGE_ANOMALOUS, 1).otherwise(0)).alias("anomalous_edges"),
    )
    for name in ("techniques", "entities"):
        sets = events.select(trace, F.explode(name).alias("v")).distinct().groupBy(trace).agg(F.array_sort(F.collect_list("v")).alias(name))
        base = base.join(sets, trace, "left")
    counts = events.select(trace, F.explode("tokens").alias("t")).groupBy(trace, "t").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(trace).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("token_counts"))
    return base.join(counts, trace, "left").join(trace_sketch(events, trace), trace, "left")


def trace_sketch(events: DataFrame, trace: str = "trace_id", slots: int = S.SKETCH_SLOTS) -> DataFrame:
    """``trace, sketch``: minima over the distinct shingles of a trace's events."""
    sh = events.select(trace, F.explode(X.event_shingles(F.col("tokens"), F.col("techniques"))).alias("s")).distinct()
    minima = sh.groupBy(trace).agg(*[F.min(X.slot_hash(i, F.col("s"))).alias(f"m{i}") for i in range(slots)])
    return minima.select(trace, F.array(*[F.col(f"m{i}") for i in range(slots)]).alias("sketch"))


def merge_features(parts: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Partial feature rows of a trace to one: sums, least and greatest, unions, slot-wise minima."""
    base = parts.groupBy(trace).agg(F.sum("event_count").alias("event_count"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("anomaly_sum").alias("anomaly_sum"), F.sum("anomalous_edges").alias("anomalous_edges"))
    for name in ("techniques", "entities"):
        base = base.join(parts.select(trace, F.explode(name).alias("v")).distinct().groupBy(trace).agg(F.array_sort(F.collect_list("v")).alias(name)), trace, "left")
    counts = parts.select(trace, F.explode("token_counts").alias("t", "n")).groupBy(trace, "t").agg(F.sum("n").alias("n"))
    base = base.join(counts.groupBy(trace).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("token_counts")), trace, "left")
    slots = parts.select(trace, F.posexplode("sketch").alias("i", "h")).groupBy(trace, "i").agg(F.min("h").alias("h"))
    return base.join(slots.groupBy(trace).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("sketch")), trace, "left")


def log_token_counts(counts: Column) -> Column:
    return F.transform_values(counts, lambda k, v: F.log1p(v))


def recent_tokens(tokens: Column, keep: int = S.TOKEN_RETENTION) -> Column:
    return F.when(F.size(tokens) > keep, F.slice(tokens, -keep, keep)).otherwise(tokens)


def window_id(seconds: Column, width: int = S.WINDOW_SECONDS) -> Column:
    return F.floor(seconds / width).cast("long")


def process_traces(events: DataFrame) -> DataFrame:
    """Per (host, root process): span of time, count and ordered hashes."""
    return events.groupBy("host", "root").agg(
        F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_hash"))), lambda x: x["event_hash"]).alias("event_hashes"),
    )


def session_roots(processes: DataFrame, boundaries) -> DataFrame:
    """``pid, root``: the ancestor just under a service image; a process on a cycle of parents, or below one, is its own root.

    ``processes``: pid, parent, image. Each round doubles how far a pointer has climbed; rounds end
    when none moves, or when they have climbed past the number of processes, as only cycles do.
    """
    stops = list(boundaries)
    parents = processes.select(F.col("pid").alias("p"), F.col("image").alias("p_image"))
    step = processes.join(parents, F.col("parent") == F.col("p"), "left")
    top = F.col("p").isNull() | F.col("p_image").isin(*stops) | (F.col("parent") == F.col("pid"))
    now = cut(step.select("pid", F.when(top, F.col("pid")).otherwise(F.col("parent")).alias("root")), "pointers")
    climb = now
    for _ in range(max(1, now.count()).bit_length()):
        up = climb.select(F.col("pid").alias("root"), F.col("root").alias("further"))
        step = climb.join(up, "root", "left").select("pid", F.coalesce("further", "root").alias("root"), (F.coalesce("further", "root") != F.col("root")).alias("moved"))
        step = cut(step, "pointers")
        if climb is not now:
            spent(climb)
        climb = step
        if step.where("moved").isEmpty():
            break
    tops = now.where("pid = root").select("root", F.lit(True).alias("top"))
    return climb.join(tops, "root", "left").select("pid", F.when(F.col("top"), F.col("root")).otherwise(F.col("pid")).alias("root"))
