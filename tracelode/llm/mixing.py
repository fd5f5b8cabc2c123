"""Mixing sources to target weights: exact budgets by distributed prefix sums over hash-random keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize

#: Documents that one bucket of a source's key range holds on average, and the most buckets a source gets.
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16
#: Rows of a group of alike documents that one run of the result holds.
RUN_ROWS = 10_000


def source_targets(groups: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """A row per source: ``sid``, ``source``, ``source_size``, ``docs``, ``target``, from ``source, size, copies``.

    Weights go to the sources in code point order, null last, and repeat. The budget, ``share`` of
    all words, is dealt by weight; no target passes ``max_epochs`` times its source, and what is over
    is dealt again by weight. That fixed point is water-filling: in order of cap/weight a prefix of
    the sources is full, the others share the rest by weight. One task sees one row of each source.
    """
    stats = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    stats = stats.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight)
    stats = stats.withColumn("cap", F.col("source_size").cast("double") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    stats = stats.withColumn("budget", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
    stats = stats.withColumn("full_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    stats = stats.withColumn("weight_from", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    stats = stats.withColumn("full", F.col("cap") * F.col("weight_from") <= F.col("weight") * (F.col("budget") - F.col("full_before")))
    stats = stats.withColumn("full_caps", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything))
    stats = stats.withColumn("open_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(
        F.least(F.col("cap"), (F.col("budget") - F.col("full_caps")) * F.col("weight") / F.col("open_weight"))
    )
    return stats.select("sid", "source", "source_size", "docs", target.alias("target"))


def _placed(documents: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, max_epochs: float, seed: str) -> DataFrame:
    """``source, id, size, copies, source_size, target, epochs, part``: rows alike in source, id and size are one group.

    Whole epochs are taken of every row, and ``part`` words more of the group. A group's key is the
    md5 of the seed and its id. A source's groups are range-sorted by key: the key space is cut in
    equal ranges, one window each, so that a source with a third of all rows is many windows; range
    totals give each range's offset; the rest is cut at the exact word in key order.
    """
    groups = documents.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), words_in(F.col(text_col)).alias("size"))
    groups = materialize(groups.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("copies")), "groups")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    sources = materialize(source_targets(groups, weights, share, max_epochs), "sources")
    buckets = F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("docs") / BUCKET_ROWS))).cast("long")
    place = F.conv(F.substring("key", 1, 4), 16, 10).cast("long")
    rows = groups.withColumn("key", key).alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.select("d.source", "id", "size", "copies", "key", "sid", "source_size", "target", F.floor(place * buckets / 65536).alias("bucket"), (F.col("size") * F.col("copies")).alias("words"))
    totals = rows.groupBy("sid", "bucket").agg(F.sum("words").alias("total"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("words").over(inside)).join(totals, ["sid", "bucket"])
    before = F.col("offset") + F.col("upto") - F.col("words")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("words"), budget - epochs * F.col("source_size") - before))
    rows = rows.select("source", "id", "size", "copies", "source_size", "target", epochs.alias("epochs"), part.cast("long").alias("part"))
    placed = materialize(rows, "placed_groups")
    discard(groups, sources)
    return placed


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _taken(size: Column, epochs: Column, part: Column, number: Column) -> Column:
    """Words of the row of that number, from 0, in its group: the part goes to the first rows, the last of them in part."""
    return epochs * size + F.greatest(F.lit(0), F.least(size, part - number * size))


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """How many words of every document the mix takes: ``doc_id, size, source_size, target, taken`` under ``id_col``'s name.

    Documents are taken in order of a hash of their id: whole epochs of a source, then the first ones
    up to the exact word of its target.

    A null or empty text has size 0 and takes 0; texts of any length are counted whole; null sources
    are one source, last in order; null or repeated ids share a key and are told apart by size; rows
    alike in source, id and size are interchangeable, one group however many; an empty table gives an
    empty result. Other columns, whatever their names, are not read.
    """
    groups = _placed(documents, id_col, text_col, source_col, weights, share, max_epochs, seed)
    few = groups.where(F.col("copies") <= RUN_ROWS).withColumn("first", F.lit(0).cast("long"))
    # a group of very many rows is written by many tasks
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN_ROWS)))
    many = groups.where(F.col("copies") > RUN_ROWS).withColumn("run", runs).repartition("source", "id", "size", "run")
    many = many.withColumn("first", F.col("run") * RUN_ROWS).drop("run")
    last = F.least(F.col("copies"), F.col("first") + RUN_ROWS) - 1
    rows = few.unionByName(many).withColumn("number", F.explode(F.sequence(F.col("first"), last)))
    taken = _taken(F.col("size"), F.col("epochs"), F.col("part"), F.col("number"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """The mixed corpus: a document once for each epoch it is in, the last copy cut at the exact word.

    Takes what ``mix`` says, row by row. Keeps the columns of ``documents``, whatever their names;
    ``n_chars``, where there is one, follows the text. Texts without words are not in the mix. Where
    the cut falls among rows alike in source, id and size, they are numbered by a hash of their text;
    only the rows of that one group a source are sorted for it.
    """
    groups = _placed(documents, id_col, text_col, source_col, weights, share, max_epochs, seed)
    shares = groups.where((F.col("size") > 0) & ((F.col("epochs") > 0) | (F.col("part") > 0)))
    split = (F.col("copies") > 1) & (F.col("part") > 0) & (F.col("part") < F.col("size") * F.col("copies"))
    shares = shares.select(*[F.col(c).alias(f"__mix_{c}") for c in ("source", "id", "size", "copies", "epochs", "part")], split.alias("__mix_split"))
    same = F.col(source_col).eqNullSafe(F.col("__mix_source")) & F.col(id_col).eqNullSafe(F.col("__mix_id")) & (F.col("__mix_words") == F.col("__mix_size"))
    counted = documents.withColumn("__mix_words", words_in(F.col(text_col)))
    number = F.when(F.col("__mix_part") > 0, 0).otherwise(F.col("__mix_copies")).cast("long")
    rows = counted.join(shares.where("not __mix_split"), same).withColumn("__mix_number", number)
    parted = shares.where("__mix_split")
    if not parted.isEmpty():
        place = Window.partitionBy("__mix_source", "__mix_id", "__mix_size").orderBy(F.xxhash64(F.col(text_col)), F.col(text_col))
        rows = rows.unionByName(counted.join(parted, same).withColumn("__mix_number", (F.row_number().over(place) - 1).cast("long")))
    size = F.col("__mix_size")
    rows = rows.withColumn("__mix_taken", _taken(size, F.col("__mix_epochs"), F.col("__mix_part"), F.col("__mix_number")))
    rows = rows.where("__mix_taken > 0").withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / size).cast("int"))))
    left = F.least(size, F.col("__mix_taken") - (F.col("__mix_epoch") - 1) * size).cast("int")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, left), "")
    rows = rows.withColumn(text_col, F.when(left < size, cut).otherwise(F.col(text_col)))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(documents.schema["n_chars"].dataType))
    return rows.select(*documents.columns)
