"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. A local folder is chosen only where that is
    unset and the master is local, as in tests, where driver and executors are one process; on a
    cluster without the setting this raises.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelode/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracelode_path = path  # noqa: SLF001
    return back


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that no result reads any more."""
    for df in frames:
        path = getattr(df, "_tracelode_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm  # noqa: SLF001
            conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside hand Python so many rows at a time at most; the session's setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def schema_of(df: DataFrame, *columns: str) -> list[T.StructField]:
    return [df.schema[c] for c in columns]


def slices(batch, step: int = 256, text: int | None = None, most_bytes: int = 4 << 20):
    """Cut an Arrow batch so that only few texts are Python objects at a time.

    ``text`` is the position of a string or binary column: a slice holds at most ``most_bytes`` of
    it, or one row.
    """
    if text is None or not batch.num_rows:
        ends = range(step, batch.num_rows + step, step)
    else:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        ends, at, base = [], 0, 0
        while at < batch.num_rows:
            at = max(at + 1, min(at + step, int(np.searchsorted(upto, base + most_bytes, "right"))))
            base = int(upto[at - 1])
            ends.append(at)
    at = 0
    for end in ends:
        yield batch.slice(at, end - at)
        at = end
