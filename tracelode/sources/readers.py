"""Readers: JSON lines, session corpora, edge lists, event logs, columnar files and fixtures."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.MapType(T.StringType(), T.StringType())


def read_jsonl(spark: SparkSession, path: str, source_id: str = "generic", strict: bool = True) -> DataFrame:
    """``file, position, record, source_id``: one map of text a line, blank lines skipped.

    A nested value is its JSON text. A malformed line raises, or with ``strict`` off has a null
    record. Positions order lines within a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"), "value")
    return parse_lines(lines.where(F.trim("value") != ""), source_id, strict)


def parse_lines(lines: DataFrame, source_id: str = "generic", strict: bool = True) -> DataFrame:
    record = F.from_json("value", RECORD)
    if strict:
        record = F.when(record.isNull(), F.raise_error(F.concat(F.lit("malformed JSON: "), F.substring("value", 1, 80)))).otherwise(record)
    return lines.select(*[c for c in lines.columns if c != "value"], record.alias("record"), F.lit(source_id).alias("source_id"))


def parse_body(bodies: DataFrame) -> DataFrame:
    """Request bodies (column ``body``): a JSON array, one object, or JSON lines; a row per record."""
    array = F.from_json("body", T.ArrayType(RECORD))
    lines = F.transform(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, RECORD))
    body = F.ltrim("body")
    records = F.when(body.startswith("["), array).otherwise(F.when(F.from_json("body", RECORD).isNotNull() & ~F.col("body").contains("\n{"), F.array(F.from_json("body", RECORD))).otherwise(lines))
    rows = bodies.select(F.posexplode(records).alias("position", "record"))
    return rows.withColumn("record", F.when(F.col("record").isNull(), F.raise_error(F.concat(F.lit("malformed record at "), F.col("position").cast("string")))).otherwise(F.col("record")))


def stamp_sequence(records: DataFrame, source: str = "source_id", explicit: str = "explicit_seq", position: str = "position") -> DataFrame:
    """Per-source sequence: an explicit number resets the count, which goes on from it."""
    w = Window.partitionBy(source).orderBy(position)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.row_number().over(w)
    rows = records.withColumn("__place", place)
    base = F.last(F.when(F.col(explicit).isNotNull(), F.col(explicit) - F.col("__place")), ignorenulls=True).over(upto)
    return rows.withColumn("source_seq", (F.col("__place") + F.coalesce(base, F.lit(-1))).cast("long")).drop("__place")


# Other names of the canonical fields of an edge list.
EDGE_ALIASES = {"ts": "timestamp", "host": "hostname", "subject": "src", "object": "dst", "action": "event_type"}


def apply_aliases(record: Column, aliases: dict[str, str] | None = None) -> Column:
    """A record whose alias keys are renamed; the canonical key wins, the alias always goes."""
    aliases = EDGE_ALIASES if aliases is None else aliases
    names = F.array(*[F.lit(a) for a in aliases.values()])
    kept = F.map_filter(record, lambda k, v: ~F.array_contains(names, k))
    for canonical, alias in aliases.items():
        add = F.when(F.try_element_at(record, F.lit(canonical)).isNull() & F.map_contains_key(record, alias), F.map_from_arrays(F.array(F.lit(canonical)), F.array(F.try_element_at(record, F.lit(alias)))))
        kept = F.when(add.isNull(), kept).otherwise(F.map_concat(_without(kept, canonical), add))
    return kept


def _without(record: Column, name: str) -> Column:
    return F.map_filter(record, lambda k, v: k != name)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, "edges")
    return rows.withColumn("record", apply_aliases(F.col("record")))


SESSION = T.StructType([T.StructField(c, T.StringType()) for c in ("session_id", "beacon_id", "id", "actor", "actor_id", "host", "ts", "timestamp")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("commands", "events")])
COMMAND = T.StructType([T.StructField(c, T.StringType()) for c in ("ts", "command", "text", "raw", "tactic", "technique")])


def expand_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions as JSON (column ``value``: an object or an array of them) to one ``exec`` event a command.

    A command without a time has its session's; without either the row raises.
    """
    array = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(SESSION))).otherwise(F.array(F.from_json("value", SESSION)))
    rows = sessions.select(F.explode(array).alias("s")).select("s.*")
    rows = rows.select(F.coalesce("session_id", "beacon_id", "id").alias("session_id"), F.coalesce("actor", "actor_id").alias("actor"), F.coalesce("host", F.lit("unknown")).alias("host"), F.coalesce("ts", "timestamp").alias("session_ts"), F.posexplode(F.coalesce("commands", "events")).alias("position", "c"))
    parsed = F.when(F.ltrim("c").startswith("{"), F.from_json("c", COMMAND))
    rows = rows.withColumn("p", parsed)
    ts = F.coalesce("p.ts", "session_ts")
    return rows.select(
        "session_id", "actor", "host", "position", F.when(ts.isNull(), F.raise_error(F.lit("command without a time"))).otherwise(ts).alias("ts"),
        F.lit("exec").alias("action"), F.coalesce("p.command", "p.text", "p.raw", "c").alias("raw"), F.coalesce("p.technique", "p.tactic").alias("technique"),
    )


def read_log(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Events of a log: the manifest's segments in order, then segments it doesn't list yet."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    order = manifest.select(F.col("name").alias("segment"), "seq")
    missing = order.join(rows.select("segment").distinct(), "segment", "left_anti")
    if not missing.isEmpty():
        raise FileNotFoundError("a listed segment is missing")
    return rows.join(order, "segment", "left").withColumn("listed", F.col("seq").isNotNull())


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        return getattr(spark.read, kind)(path)
    if kind == "csv":
        return spark.read.csv(path, header=True)
    raise ValueError(f"no reader for {kind}")


def load_corpus(records: DataFrame, max_words: int = 256, merged: str = "sf", merge_marks=("plki", "joke"), cap: int = 1500, drop: str = "other") -> DataFrame:
    """Command records (actor, session_id, ts, command) to the cleaned corpus.

    Actors whose name holds a mark become one, the catch-all actor goes, sessions of more than
    ``max_words`` words go, and the merged actor keeps its first ``cap`` sessions in order.
    """
    actor = F.lower(F.trim("actor"))
    mark = F.lit(False)
    for m in merge_marks:
        mark = mark | actor.contains(m)
    rows = records.withColumn("actor", F.when(mark, merged).otherwise(actor)).where(F.col("actor") != drop)
    words = rows.groupBy("actor", "session_id").agg(F.sum(F.size(F.split(F.trim("command"), r"\s+"))).alias("words"), F.min("ts").alias("first_ts"))
    kept = words.where(F.col("words") <= max_words)
    rank = F.row_number().over(Window.partitionBy("actor").orderBy("session_id"))
    kept = kept.withColumn("rank", rank).where((F.col("actor") != merged) | (F.col("rank") <= cap))
    rows = rows.join(kept.select("actor", "session_id"), ["actor", "session_id"])
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("actor", "session_id").orderBy("ts", "command")) - 1).cast("long"))


def corpus_manifest(records: DataFrame, dropped: Column | None = None) -> DataFrame:
    """Per actor: sessions, commands, first and last time, and how many rows are dropped."""
    actor = F.lower(F.trim("actor"))
    drop = F.lit(False) if dropped is None else dropped
    by = records.withColumn("__drop", drop).groupBy(actor.alias("actor"))
    return by.agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("commands"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.when(F.col("__drop"), 1).otherwise(0)).alias("dropped"))


def load_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Provenance edges with the names and types of their nodes, where these are known."""
    if nodes is None:
        return edges.withColumn("src_name", F.col("src_id")).withColumn("dst_name", F.col("dst_id"))
    n = nodes.select("node_id", "node_type", "name")
    src = n.toDF("src_id", "src_type_", "src_name")
    dst = n.toDF("dst_id", "dst_type_", "dst_name")
    out = edges.join(src, "src_id", "left").join(dst, "dst_id", "left")
    for side in ("src", "dst"):
        given = F.col(f"{side}_type") if f"{side}_type" in edges.columns else F.lit(None).cast("string")
        out = out.withColumn(f"{side}_type", F.coalesce(given, f"{side}_type_")).withColumn(f"{side}_name", F.coalesce(f"{side}_name", f"{side}_id")).drop(f"{side}_type_")
    return out


def incident_events(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Edges that touch a node of an incident at either end, once each."""
    nodes = truth.select("node_id").distinct()
    src = edges.join(nodes.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi")
    dst = edges.join(nodes.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return src.unionByName(dst).distinct()


def to_nanos(value: Column) -> Column:
    """Numbers over 1e12 are nanoseconds, others seconds; text is an ISO time."""
    number = value.try_cast("double")
    exact = value.try_cast("long")
    iso = F.unix_micros(F.try_to_timestamp(value)) * 1000
    return F.when(number > 1e12, F.coalesce(exact, number.cast("long"))).when(number.isNotNull(), F.round(number * 1e9).cast("long")).otherwise(iso)


def actor_fixture(spark: SparkSession, seed: int = 7, actors: int = 8, sessions: int = 40) -> DataFrame:
    """Seeded sessions of actors, each with its own tokens, tools, techniques and indicators."""
    rng = random.Random(seed)
    rows = []
    for a in range(actors):
        own = [f"cmd{a}_{i}" for i in range(18)]
        for s in range(sessions):
            tokens = rng.sample(own, 8) + rng.sample([f"tool{i}" for i in range(5)], 2)
            rng.shuffle(tokens)
            rows.append((f"actor{a}", f"a{a}s{s}", float(1_700_000_000 + s * 3600 + a), tokens, rng.sample([f"T{1000 + a * 4 + i}" for i in range(4)], 2), [f"ioc{a}_{rng.randrange(6)}" for _ in range(rng.choice((2, 3)))], s < sessions * 0.7))
    return spark.createDataFrame(rows, "actor string, session_id string, ts double, tokens array<string>, techniques array<string>, indicators array<string>, train boolean")


def provenance_fixture(spark: SparkSession, seed: int = 11, hosts: int = 4, processes: int = 30) -> tuple[DataFrame, DataFrame]:
    """Seeded provenance: edges of process trees that read, write and connect, and the nodes of one incident on each host."""
    rng = random.Random(seed)
    edges, truth = [], []
    for h in range(hosts):
        for p in range(1, processes):
            at = 1_700_000_000 + h * 10_000 + p * 60
            edges.append((f"h{h}p{rng.randrange(p)}", f"h{h}p{p}", "fork", float(at)))
            kind = rng.choice((("read", f"h{h}f{rng.randrange(12)}"), ("write", f"h{h}f{rng.randrange(12)}"), ("connect", f"10.0.{h}.{rng.randrange(5)}:443")))
            edges.append((f"h{h}p{p}", kind[1], kind[0], float(at + 5)))
        bad = rng.randrange(1, processes)
        edges.append((f"h{h}p{bad}", f"h{h}evil", "inject", float(1_700_000_000 + h * 10_000 + processes * 60)))
        truth += [(f"incident{h}", n) for n in (f"h{h}p{bad}", f"h{h}evil")]
    return spark.createDataFrame(edges, "src_id string, dst_id string, action string, ts double"), spark.createDataFrame(truth, "incident string, node_id string")
