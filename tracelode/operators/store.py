"""Append-only log, sealed columnar segments, index tables and snapshots, on any Hadoop file system."""

from __future__ import annotations

import contextlib
import math
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from .graph import cut
from .ledger import chain_hash, chain_rows, file_hashes, link_root, sealed_hash, verify_chain
from .search import bm25_index, trigram_index

MANIFEST = "seq long, name string, batch string, count long, local_root string, prev_root string, root string"
SEALED = "seq long, name string, count long, hash string, files long"
INDEXED = "seq long, name string, count long"
KINDS = {"log": MANIFEST, "sealed": SEALED, "index": INDEXED}
ENVELOPE = ("segment", "line", *S.EVENT_COLUMNS, "body", "prev", "record_hash")
#: Events of a segment on average, and seconds after which another writer's lock is taken to be left behind.
SEGMENT_ROWS, LOCK_SECONDS = 250_000, 900


class Locked(RuntimeError):
    """Another writer holds the store."""


def event_body():
    """The text of an event that the chain covers."""
    return F.to_json(F.struct(*S.EVENT_COLUMNS), {"ignoreNullFields": "false"})


class Store:
    """Segments under ``path``: ``log/`` chained events, ``sealed/`` columnar copies, ``index/`` postings.

    A batch is one or more segments of about ``segment_rows`` events, each a chain of its own, linked
    by their roots in the manifest. Spark's committer publishes a batch's files; the manifest's entry
    makes them part of the log. Whole segments without an entry are entered by ``recover``.
    """

    def __init__(self, spark: SparkSession, path: str, segment_rows: int = SEGMENT_ROWS) -> None:
        self.spark, self.path, self.segment_rows = spark, path.rstrip("/"), segment_rows
        self._held = 0

    # Files

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target  # noqa: SLF001

    def _exists(self, name: str) -> bool:
        fs, target = self._fs(name)
        return fs.exists(target)

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time: a lock file that only one can create; one older than ``LOCK_SECONDS`` was left behind."""
        if self._held:  # this writer's own
            yield
            return
        fs, target = self._fs("_writer")
        if fs.exists(target) and time.time() - fs.getFileStatus(target).getModificationTime() / 1000 > LOCK_SECONDS:
            fs.delete(target, False)
        try:
            fs.create(target, False).close()
        except Exception:
            raise Locked(f"another writer holds {self.path}") from None
        self._held = 1
        try:
            yield
        finally:
            self._held = 0
            fs.delete(target, False)

    def manifest(self, kind: str = "log") -> DataFrame:
        if not self._exists(f"{kind}_manifest"):
            return self.spark.createDataFrame([], KINDS[kind])
        return self.spark.read.schema(KINDS[kind]).parquet(f"{self.path}/{kind}_manifest")

    def _enter(self, kind: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, KINDS[kind]).coalesce(1).write.mode("append").parquet(f"{self.path}/{kind}_manifest")

    def version(self) -> int:
        """Segments entered so far: it changes with every batch."""
        return self.manifest().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]

    # The log

    def append(self, events: DataFrame, batch: str, count: int) -> list[str]:
        """A batch of events as the next segments; written again under the same name it replaces itself.

        Events are dealt to segments by their hash, so that each segment is one bounded task.
        """
        with self.lock():
            n = max(1, math.ceil(count / self.segment_rows))
            part = F.format_string("%s-%05d", F.lit(batch), F.pmod(F.xxhash64("event_hash"), F.lit(n))) if n > 1 else F.lit(batch)
            rows = events.select(*S.EVENT_COLUMNS).withColumn("segment", part)
            order = Window.partitionBy("segment").orderBy("source_id", "source_seq", "event_hash")
            rows = rows.withColumn("line", F.row_number().over(order).cast("long")).withColumn("body", event_body())
            chained = chain_rows(rows, "segment", "line", "body").select(*ENVELOPE)
            chained.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
            return self._commit(batch)

    def _commit(self, batch: str) -> list[str]:
        rows = self.spark.read.parquet(f"{self.path}/log/batch={batch}")
        by = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("count"), F.max_by("record_hash", "line").alias("root")).orderBy("segment").collect()
        last = self.manifest().agg(F.max("seq"), F.max_by("root", "seq")).first()
        seq, root = (0, S.GENESIS) if last[0] is None else (last[0] + 1, last[1])
        entries = []
        for i, r in enumerate(by):
            before, root = root, link_root(root, r.root)
            entries.append((seq + i, r.segment, batch, r["count"], r.root, before, root))
        self._enter("log", entries)
        return [r.segment for r in by]

    def written(self) -> DataFrame:
        """Every event of the log's files with its ``batch``, entered or not."""
        if not self._exists("log"):
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {'long' if c in (*S.LONG_COLUMNS, 'line') else 'string'}" for c in (*ENVELOPE, "batch")))
        return self.spark.read.parquet(f"{self.path}/log").withColumn("batch", F.col("batch").cast("string"))

    def log(self) -> DataFrame:
        """Events of entered segments."""
        return self.written().join(F.broadcast(self.manifest().select(F.col("name").alias("segment"))), "segment", "left_semi")

    def recover(self) -> list[str]:
        """Enter whole batches that were written but not entered; a broken one raises."""
        lost = self.written().select("batch").distinct().join(self.manifest().select("batch").distinct(), "batch", "left_anti").orderBy("batch")
        names = []
        with self.lock():
            for r in lost.collect():
                bad = verify_chain(self.written().where(F.col("batch") == r.batch), "segment", "line", "body").where("not ok").limit(1).collect()
                if bad:
                    raise ValueError(f"segment {bad[0].segment} is broken")
                names += self._commit(r.batch)
        return names

    # Sealed copies and indexes

    def seal(self) -> list[str]:
        """Columnar copies of entered segments that have none, nulls filled, sorted by hash with a bloom filter, and a hash of their files."""
        with self.lock():
            todo = self.manifest().join(self.manifest("sealed").select("name"), "name", "left_anti").orderBy("seq").collect()
            if not todo:
                return []
            names = [m.name for m in todo]
            rows = self.written().where(F.col("segment").isin(names)).select("segment", *S.EVENT_COLUMNS)
            rows = rows.na.fill("", [c for c in S.EVENT_COLUMNS if c not in S.LONG_COLUMNS]).na.fill(0, list(S.LONG_COLUMNS))
            self._by_segment(rows, "sealed", ["event_hash"], **{"parquet.bloom.filter.enabled#event_hash": "true"})
            hashes = {r.segment: r for r in self._sealed_hashes(names).collect()}
            self._enter("sealed", [(m.seq, m.name, m["count"], hashes[m.name].hash, hashes[m.name].files) for m in todo])
            return names

    def _by_segment(self, rows: DataFrame, kind: str, order: list[str], **options) -> None:
        """A folder a segment; a folder that is there already is replaced, the others stay."""
        rows = rows.withColumn("in_segment", F.col("segment"))
        spread = rows.repartition("in_segment").sortWithinPartitions("in_segment", *order)
        spread.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy("in_segment").parquet(f"{self.path}/{kind}")

    def _sealed_hashes(self, names: list[str] | None = None) -> DataFrame:
        files = file_hashes(self.spark, f"{self.path}/sealed").withColumn("segment", F.url_decode(F.regexp_extract("path", "in_segment=([^/]+)", 1)))
        if names is not None:
            files = files.where(F.col("segment").isin(names))
        return sealed_hash(files).join(files.groupBy("segment").agg(F.count(F.lit(1)).alias("files")), "segment")

    def sealed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sealed").drop("in_segment")

    def live(self) -> DataFrame:
        """Logged events of segments that aren't sealed."""
        names = self.manifest("sealed").select(F.col("name").alias("segment"))
        return self.log().join(F.broadcast(names), "segment", "left_anti").select("segment", *S.EVENT_COLUMNS)

    def index(self) -> list[str]:
        """Term and trigram postings of sealed segments that have none, in a folder a segment."""
        with self.lock():
            todo = self.manifest("sealed").join(self.manifest("index").select("name"), "name", "left_anti").orderBy("seq").collect()
            if not todo:
                return []
            names = [m.name for m in todo]
            rows = cut(self.sealed().where(F.col("segment").isin(names)).select("segment", "event_hash", "raw"), "to_index")
            postings, lengths = bm25_index(rows, "event_hash", "raw")
            of = rows.select(F.col("event_hash").alias("id"), "segment")
            for kind, df, order in (("terms", postings, ["term"]), ("lengths", lengths, ["id"]), ("trigrams", trigram_index(rows, "event_hash", "raw"), ["tri"])):
                self._by_segment(df.join(of, "id"), f"index/{kind}", order)
            self._enter("index", [(m.seq, m.name, m["count"]) for m in todo])
            return names

    def postings(self, kind: str) -> DataFrame:
        """Postings of indexed segments; terms and trigrams are sorted in their files, so that a query's few are found by statistics."""
        rows = self.spark.read.parquet(f"{self.path}/index/{kind}").drop("in_segment")
        return rows.join(F.broadcast(self.manifest("index").select(F.col("name").alias("segment"))), "segment", "left_semi")

    # Checks

    def verify(self) -> DataFrame:
        """Per entered segment: count, chain and root, and whether its sealed copy is the one that was sealed."""
        m = self.manifest()
        rows = self.written().join(m.select(F.col("name").alias("segment")), "segment", "left_semi")
        w = Window.partitionBy("segment").orderBy("line")
        ok = (F.col("prev") == F.coalesce(F.lag("record_hash").over(w), F.lit(S.GENESIS))) & (F.col("record_hash") == chain_hash(F.col("prev"), F.col("body"))) & (F.col("body") == event_body())
        by = rows.withColumn("row_ok", ok).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("row_ok").alias("rows_ok"), F.max_by("record_hash", "line").alias("got"))
        out = m.withColumnRenamed("name", "segment").join(by, "segment", "left")
        chain = F.coalesce((F.col("n") == F.col("count")) & F.col("rows_ok") & (F.col("got") == F.col("local_root")) & (F.col("root") == chain_hash(F.col("prev_root"), F.col("local_root"))), F.lit(False))
        out = out.select("segment", "count", chain.alias("log_ok"))
        if self._exists("sealed"):
            sealed = self.manifest("sealed").select(F.col("name").alias("segment"), F.col("hash").alias("want"))
            seen = self._sealed_hashes().select("segment", "hash")
            out = out.join(sealed, "segment", "left").join(seen, "segment", "left").withColumn("sealed_ok", F.when(F.col("want").isNotNull(), F.coalesce(F.col("want") == F.col("hash"), F.lit(False)))).drop("want", "hash")
        else:
            out = out.withColumn("sealed_ok", F.lit(None).cast("boolean"))
        return out.withColumn("ok", F.col("log_ok") & F.coalesce("sealed_ok", F.lit(True)))

    # Projections

    def save(self, name: str, df: DataFrame, version: str | None = None) -> DataFrame:
        """A projection as a new version; readers take the newest whole one."""
        version = version or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.mode("overwrite").parquet(f"{self.path}/tables/{name}/{version}")
        return self.load(name, version)

    def load(self, name: str, version: str | None = None) -> DataFrame | None:
        """A version of a projection, the newest where none is named; None where there is no whole one."""
        fs, target = self._fs(f"tables/{name}")
        if not fs.exists(target):
            return None
        found = sorted(s.getPath().getName() for s in fs.listStatus(target) if fs.exists(self._fs(f"tables/{name}/{s.getPath().getName()}/_SUCCESS")[1]))
        if version is not None:
            found = [v for v in found if v == version]
        return self.spark.read.parquet(f"{self.path}/tables/{name}/{found[-1]}") if found else None

    def status(self) -> dict:
        """Counts of events and segments."""
        counts = {k: self.manifest(k).agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first() for k in ("log", "sealed", "index")}
        return {k: {"segments": v[0], "events": v[1]} for k, v in counts.items()}
