"""Test tables as the engine's concepts: events, traces, spans, uses of indicators, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as telemetry: host by user, source by type, raw text of the fields."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("h"), F.col("user_id") % 8).alias("host"), F.col("event_type").alias("source_id"), F.col("event_id").alias("source_seq"),
        F.col("user_id").alias("session_id"), F.col("event_type").alias("action"), F.col("props").alias("attributes"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.col("value").cast("decimal(12,2)").cast("string"), "props").alias("raw"), "value",
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as spans: a turn hangs from the one before, starts a second later, lasts by its length."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").cast("long").alias("span_id"), F.when(F.col("turn") > 0, F.col("turn").cast("long") - 1).alias("parent_id"), F.col("role").alias("service"),
        F.concat(F.lit("turn."), "role").alias("action"), (F.col("turn") * 1000.0).alias("start_ms"), F.length("text").cast("double").alias("duration_ms"),
        F.when(F.length("text") % 7 == 0, "error").otherwise("ok").alias("status"), "text",
    ).dropDuplicates(["trace_id", "span_id"])


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as traces that use indicators (parts) and touch entities (suppliers) on a day."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return li.select(F.col("l_orderkey").alias("trace_id"), F.col("l_partkey").alias("indicator"), F.col("l_suppkey").alias("entity"), day.alias("day"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance edges: customers to nations, nations to regions; time by key, anomaly by key."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.col("c_mktsegment").alias("action"), F.col("c_custkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("part_of").alias("action"), F.col("n_nationkey").cast("long").alias("k"))
    rows = c.unionByName(n)
    return rows.select("src", "dst", "action", (F.col("k") * 60).cast("long").alias("ts"), ((F.col("k") % 10) / 10.0).alias("anomaly"))
