"""Best-fit packing with certified bounds.

Documents become token pieces of at most one sequence. Pieces are dealt to partitions, each packed
best-fit decreasing and certified by a lower bound from dual-feasible functions. Partitions whose
bins pass their bound put their least-filled bins up for exchange; those pieces are dealt anew and
packed again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, slices
from .tokens import WordTokens

CAPACITY, END_ID = 4096, 1
#: Pieces a partition holds on average.
PARTITION_PIECES = 40_000
#: Rounds that sequence numbers have room for; each repacks about a tenth of the one before, so far fewer end it.
MOST_ROUNDS = 31


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins. Ties go to the earlier piece.

    Open bins are kept by free space, so a piece costs one search over at most ``capacity`` values.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []
    used = 0
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(spaces, n)
        if at == len(spaces):
            bin_, space = used, capacity
            used += 1
        else:
            space = spaces[at]
            bin_ = by_space[space].pop()
            if not by_space[space]:
                del by_space[space]
                spaces.pop(at)
        bins[i], offsets[i] = bin_, capacity - space
        left = space - n
        if left:
            if left not in by_space:
                by_space[left] = []
                insort(spaces, left)
            by_space[left].append(bin_)
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that ``counts[n]`` pieces of each length n can need.

    The largest of the bounds from two families of dual-feasible functions: for a threshold t the
    one that rounds lengths over ``capacity - t`` up to a whole bin and those under t down to
    nothing, and for k the one that rounds ``(k + 1) * n / capacity`` down to k-ths.
    """
    n = np.arange(len(counts), dtype=np.int64)
    size = counts * n
    best = -(-int(size.sum()) // capacity)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(size)])
    t = np.arange(1, capacity // 2 + 1)
    big = number[-1] - number[np.minimum(capacity - t + 1, len(counts))]
    middle = total[np.minimum(capacity - t + 1, len(counts))] - total[np.minimum(t, len(counts))]
    best = max(best, int((big + -(-middle // capacity)).max()))
    for k in range(1, 33):
        up, rest = np.divmod((k + 1) * n, capacity)
        value = np.where(rest == 0, n * k, up * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def token_pieces(documents: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row's tokens and its end id."""
    schema = T.StructType([documents.schema[id_col], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    names = schema.fieldNames()

    def run(batches):
        words = WordTokens(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, text=1):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = words.encode(text or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                columns = [pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), *columns], names)

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def _pack_groups(pieces: DataFrame, round_: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in every ``group``: ``uid, group, bin, offset, fill, used, bound``."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["uid"].to_numpy(), -table["length"].to_numpy()))
        uid, length = table["uid"].to_numpy()[order], table["length"].to_numpy()[order]
        bins, offsets, used = best_fit_decreasing(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, length, used).astype(np.int64)
        group = table["group"][0].as_py()
        same = lambda x: np.full(len(uid), x, np.int64)
        return pa.table({"uid": uid, "length": length, "round": same(round_), "group": same(group), "bin": bins, "offset": offsets, "fill": fill[bins], "used": same(used), "bound": same(bound)})

    schema = "uid long, length long, round long, `group` long, bin long, offset long, fill long, used long, bound long"
    return pieces.groupBy("group").applyInArrow(pack, schema)


def pack_documents(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    partition_pieces: int = PARTITION_PIECES,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, and its ``round``.

    Full pieces are sequences of their own. The others are dealt by hash to partitions of about
    ``partition_pieces`` (a task holds their lengths only) and packed. A partition with more bins than
    its bound gives up its emptiest bins, twice its gap and a tenth more; the pieces of all these are
    dealt anew, to fewer partitions, and packed again. A round's new bins are used only if they are
    fewer than the bins given up; rounds end when no gap is left or a round gains nothing, so a gap
    that is left is one that repacking did not close.

    A null or empty text is its end id alone; a text of any length is cut in whole pieces; rows that
    repeat an id are packed each; null ids stay null; an empty table gives an empty result. Extra
    columns, whatever their names, are not read. ``tokenizer`` is the file's path.
    """
    pieces = token_pieces(documents, id_col, text_col, tokenizer, capacity)
    # numbers are given before the table is written, so that no later run can change them
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    open_ = pieces.where(F.col("length") < capacity).select("uid", "length")
    placed: list[DataFrame] = []
    given, packed, rounds = None, None, []
    for round_ in range(MOST_ROUNDS):
        n = open_.count()
        if not n:
            break
        groups = max(1, round(n / partition_pieces))
        dealt = open_.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)).cast("long"))
        packed = materialize(_pack_groups(dealt, round_, capacity), f"round{round_}")
        rounds.append(packed)
        if given is not None:
            # the new bins stand only where they beat those given up
            before = given.select("round", "group", "bin").distinct().count()
            after = packed.select("group", "bin").distinct().count()
            if after >= before:
                placed.append(given)
                break
        gap = F.col("used") - F.col("bound")
        bins = packed.where(gap > 0).select("group", "bin", "fill", "used", "bound").distinct()
        if bins.isEmpty():
            placed.append(packed)
            break
        worst = Window.partitionBy("group").orderBy("fill", "bin")
        given_up = bins.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= 2 * gap + F.ceil(F.col("used") / 10)).select("group", "bin")
        given = materialize(packed.join(given_up, ["group", "bin"]).select(*packed.columns), f"given{round_}")
        rounds.append(given)
        placed.append(packed.join(given_up, ["group", "bin"], "left_anti").select(*packed.columns))
        open_ = given.select("uid", "length")
    else:
        raise RuntimeError("rounds of repacking did not end")
    where = None
    for part in placed:
        part = part.select("uid", "round", "group", "bin", F.col("offset"))
        where = part if where is None else where.unionByName(part)
    full = pieces.where(F.col("length") == capacity).select("uid", F.lit(-1).cast("long").alias("round"), F.lit(0).cast("long").alias("group"), F.col("uid").alias("bin"), F.lit(0).cast("long").alias("offset"))
    where = full if where is None else where.unionByName(full)
    where = materialize(where, "places")
    discard(*rounds)
    # rounds below 32, groups below 2^24, bins below 2^34; full pieces are numbered by uid, below zero
    number = F.when(F.col("round") < 0, -1 - F.col("bin")).otherwise((F.col("round") * (1 << 24) + F.col("group")) * (1 << 34) + F.col("bin"))
    where = where.select("uid", "round", number.alias("sequence_id"), "offset")
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round"]
    return pieces.join(where, "uid").select(*names)
