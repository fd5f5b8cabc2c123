"""Ordered positions and running sums without a task that sees all rows: ranges of the key, each a window of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that keys are cut in, at approximate quantiles.
PARTS = 128


def running(rows: DataFrame, key: Column, order: list, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Adds ``__position`` from 1 and, for each name of ``sums``, its sum up to and with the row, in order of key, then ``order``.

    Keys are numbers; null keys come last. Cut points are few and come to the driver; a row's range is
    the number of cut points at or below its key, so equal keys share a range; totals of the ranges,
    ``PARTS`` rows at most, carry over.
    """
    rows = rows.withColumn("__key", -key.cast("double") if descending else key.cast("double"))
    cuts = rows.agg(F.percentile_approx("__key", [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []
    points = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    part = F.when(F.col("__key").isNull(), F.lit(PARTS)).otherwise(F.size(F.filter(points, lambda c: c <= F.col("__key"))))
    rows = rows.withColumn("__part", part)
    for name, value in sums.items():
        rows = rows.withColumn(f"__v_{name}", value)
    totals = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n")]
    carried += [F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__t_{name}") for name in sums]
    rows = rows.join(F.broadcast(totals.select("__part", *carried)), "__part")
    w = Window.partitionBy("__part").orderBy("__key", *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__position", (F.col("__n") + F.row_number().over(w)).cast("long"))
    for name in sums:
        rows = rows.withColumn(name, F.col(f"__t_{name}") + F.sum(f"__v_{name}").over(upto))
    return rows.drop("__key", "__part", "__n", *[f"__{k}_{name}" for name in sums for k in "vt"])
