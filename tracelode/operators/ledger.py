"""Hash chains: building them in order, verifying them in parallel."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S

FIELDS = ("seq", "kind", "inputs_hash", "model_hash", "params_hash", "context", "output_hash", "prev_hash")
LEDGER = "seq long, kind string, inputs_hash string, model_hash string, params_hash string, context string, output_hash string, prev_hash string, record_hash string"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def payload(columns=FIELDS) -> Column:
    """What a record's hash covers: its fields as text, nulls empty, joined by bars."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def record_hash() -> Column:
    return F.sha2(payload().cast("binary"), 256)


class Ledger:
    """Decision records in a chain; appended one by one, as each hash needs the one before."""

    def __init__(self, records: list[dict] | None = None) -> None:
        self.records = list(records or [])

    @property
    def head(self) -> str:
        return self.records[-1]["record_hash"] if self.records else S.GENESIS

    def append(self, kind: str, inputs, output, context: dict | None = None, model="", params="") -> dict:
        canon = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), default=str)
        row = {"seq": len(self.records), "kind": kind, "inputs_hash": _digest(canon(inputs)), "model_hash": _digest(canon(model)), "params_hash": _digest(canon(params)), "context": canon(context or {}), "output_hash": _digest(canon(output)), "prev_hash": self.head}
        row["record_hash"] = _digest("|".join(str(row[f]) for f in FIELDS))
        self.records.append(row)
        return row

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), LEDGER)

    def rows(self) -> list[tuple]:
        return [tuple(r[n] for n in (*FIELDS, "record_hash")) for r in self.records]

    def export(self, spark: SparkSession, path: str) -> str:
        self.frame(spark).coalesce(1).write.mode("overwrite").json(path)
        return self.head

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ledger:
        return cls([r.asDict() for r in spark.read.schema(LEDGER).json(path).orderBy("seq").collect()])


def _before(records: DataFrame, column: str, first) -> DataFrame:
    """Adds ``before``: the column's value in the record before, found by its number, so that no task sees all records."""
    prior = records.select((F.col("seq") + 1).alias("seq"), F.col(column).alias("__before"))
    return records.join(prior, "seq", "left").withColumn("before", F.when(F.col("seq") == 0, F.lit(first)).otherwise(F.col("__before"))).drop("__before")


def verify_ledger(records: DataFrame) -> DataFrame:
    """``seq, hash_ok, link_ok, seq_ok`` per record; every record is checked on its own and against the one before."""
    rows = _before(records, "record_hash", S.GENESIS)
    return rows.select(
        "seq", (F.col("record_hash") == record_hash()).alias("hash_ok"), F.coalesce(F.col("prev_hash") == F.col("before"), F.lit(False)).alias("link_ok"),
        ((F.col("seq") == 0) | F.col("before").isNotNull()).alias("seq_ok"),
    )


def link_root(prev: str, root: str) -> str:
    """The hash that links a segment's root to what came before: that of ``chain_hash``."""
    return _digest(f"{prev}|{root}")


def chain_hash(prev: Column, body: Column) -> Column:
    """sha256("prev|body") as text."""
    return F.sha2(F.concat(prev, F.lit("|"), body).cast("binary"), 256)


def chain_rows(rows: DataFrame, group: str, order: str, body: str, genesis: str = S.GENESIS) -> DataFrame:
    """Adds ``prev, record_hash``: one chain per group (a segment), each folded in order, groups in parallel.

    A group is folded in one task; a store deals its batches to segments of a bounded size.
    """
    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "prev string", "record_hash string"]

    def fold(pdf):
        pdf = pdf.sort_values(order)
        prev, before, hashes = genesis, [], []
        for text in pdf[body]:
            before.append(prev)
            prev = _digest(f"{prev}|{text}")
            hashes.append(prev)
        return pdf.assign(prev=before, record_hash=hashes)

    return rows.groupBy(group).applyInPandas(fold, ", ".join(schema))


def verify_chain(rows: DataFrame, group: str, order: str, body: str, genesis: str = S.GENESIS) -> DataFrame:
    """Per group: rows, whether all links and hashes hold, and the root (the last hash)."""
    w = Window.partitionBy(group).orderBy(order)
    checked = rows.withColumn("link", F.col("prev") == F.coalesce(F.lag("record_hash").over(w), F.lit(genesis))).withColumn("hash", F.col("record_hash") == chain_hash(F.col("prev"), F.col(body)))
    return checked.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.min(F.col("link") & F.col("hash")).alias("ok"), F.max_by("record_hash", order).alias("root"))


def verify_segments(segments: DataFrame) -> DataFrame:
    """Segments (seq, prev_root, root) link to each other: ``seq, link_ok``."""
    rows = _before(segments, "root", S.GENESIS)
    return rows.select("seq", F.coalesce(F.col("prev_root") == F.col("before"), F.lit(False)).alias("link_ok"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, hash`` of every data file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("hash"))


def sealed_hash(files: DataFrame) -> DataFrame:
    """``segment, hash``: one hash over a segment's file hashes in order of their names."""
    name = F.element_at(F.split("path", "/"), -1)
    by = files.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), "hash"))).alias("files"))
    return by.select("segment", F.sha2(F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["name"], f["hash"])), "|").cast("binary"), 256).alias("hash"))
