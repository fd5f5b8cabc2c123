"""MinHash near-duplicate removal by a multi-index Hamming join of b-bit signatures.

A document is the set of its distinct five-word shingles, as 64-bit hashes of the whole text. Its
signature has 64 positions of 16 bits. Signatures of sets with similarity 0.75 differ in 16 positions
on average; the join finds all pairs that differ in up to 27 (a true pair has more with a probability
under 0.1 %). The positions are cut in 14 chunks; by the pigeonhole principle a pair within 27 errors
has a chunk with at most one, so each chunk is indexed once for every position left out: 64 keys a
document. Links are confirmed on full sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, slices
from .graph import connected_components, smallest_roots

SHINGLE_WORDS = 5
POSITIONS, MOST_ERRORS = 64, 27
#: Bytes of signatures, or of texts, of a block, and members: larger buckets are dealt out in pairs of blocks.
BLOCK_BYTES = 8 << 20
BLOCK = BLOCK_BYTES // (2 * POSITIONS)
#: Members of small tiles that are looked at together, and rows whose errors to the others are counted at a time.
GROUP, STRIPE = 512, 128
#: Pairs of a tile that are held at a time.
HELD_PAIRS = 1 << 20
#: Rounds in which the likeliest pairs are tried before all that is left is compared.
ROUNDS = 2
_CHUNKS = np.array_split(np.arange(POSITIONS), (MOST_ERRORS + 1) // 2)
_STARTS = np.array([c[0] for c in _CHUNKS])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XORS = _rng.integers(0, 1 << 32, (POSITIONS, 1), dtype=np.uint32)
_ODDS = _rng.integers(0, 1 << 31, (POSITIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as far as the longest text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, inverse))
        return self.up, self.down


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in its bytes, mixed with its length."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers.of(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes; one for the whole sequence if the text has fewer than five words."""
    words = word_hashes((text or b"").lower())
    if not len(words):
        return words
    if len(words) < SHINGLE_WORDS:
        return _mix((words * _FACTORS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - SHINGLE_WORDS + 1
    x = words[:n] * _FACTORS[0]
    for i in range(1, SHINGLE_WORDS):
        x += words[i : i + n] * _FACTORS[i]
    return np.unique(_mix(x))


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 minima under random permutations, 16 bits of each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full((POSITIONS, 1), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        y = (x[at : at + 2048] ^ _XORS) * _ODDS
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(low, y.min(axis=1, keepdims=True), out=low)
    return (low[:, 0] & np.uint32(0xFFFF)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """For rows of signatures the 64 keys of each: every chunk without one of its positions, which the low six bits name."""
    out = []
    for chunk in _CHUNKS:
        for hole in chunk:
            h = np.full(len(signatures), int(hole) + 1, np.uint64)
            for p in chunk[chunk != hole]:
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, p].astype(np.uint64))
            out.append(h & ~np.uint64(63) | np.uint64(hole))
    return np.stack(out, axis=1).view(np.int64)


def first_shared(differ: np.ndarray) -> np.ndarray:
    """For pairs, given where their positions differ, the number of the first key they share: the first chunk with an error at most decides."""
    errors = np.add.reduceat(differ.view(np.uint8), _STARTS, axis=1)
    chunk = (errors <= 1).argmax(axis=1)
    start = _STARTS[chunk]
    later = differ & (np.arange(POSITIONS) >= start[:, None])
    return np.where(errors[np.arange(len(chunk)), chunk] == 0, start, later.argmax(axis=1))


def _unpack(column) -> np.ndarray:
    """Binary signatures as rows of 64 numbers."""
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _sets(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, node, check, bytes, sig`` by row; ``node`` and ``check`` are 128 bits that name the set."""
    schema = T.StructType([T.StructField("id", documents.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "node", "check", "bytes")], T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, node, check, size, sig = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    a, b = fingerprint(s)
                    node.append(a)
                    check.append(b)
                    size.append(len(text or b""))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], schema.fieldNames())

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    a = _mix(shingles + np.uint64(7)).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
    b = _mix(shingles ^ _BASE).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, leader, node`` for all members but the smallest of every key with two members or more.

    One shuffle by key; sorted runs of a key stream through, so no bucket is held in memory.
    """

    def keys(batches):
        for batch in batches:
            k = index_keys(_unpack(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), POSITIONS))], ["key", "node"])

    def runs(batches):
        key = leader = None
        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            lead = np.where(new, v, np.int64(0))
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            lead = np.where(at >= 0, v[at], np.int64(0 if leader is None else leader))
            keep = ~new & (lead != v)
            key, leader = k[-1], lead[-1]
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(lead[keep]), pa.array(v[keep])], ["key", "leader", "node"])

    rows = classes.select("node", "sig").mapInArrow(keys, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(runs, "key long, leader long, node long")


def _within(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose signatures differ in at most ``MOST_ERRORS`` positions."""

    def run(batches):
        for batch in batches:
            near = (_unpack(batch.column(2)) != _unpack(batch.column(3))).sum(axis=1) <= MOST_ERRORS
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], ["a", "b"])

    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets that aren't empty."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(nodes: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, check, text`` of classes: texts under the representative's id, once each.

    A class whose rows all have a null id has no representative; its text is found among the rows
    without an id by its fingerprint.
    """
    reps = nodes.join(classes.select("node", "check", "rep"), "node")
    rows = documents.select(F.col(id_col).alias("rep"), F.col(text_col).cast("binary").alias("text"))
    named = rows.join(reps, "rep").select("node", "check", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                marks = [fingerprint(shingle_set(t)) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)), part.column(0)], ["node", "check", "text"])

    unnamed = rows.where("rep is null and text is not null").select("text").mapInArrow(run, "node long, check long, text binary")
    unnamed = unnamed.join(reps.where("rep is null").select("node", "check"), ["node", "check"])
    return materialize(named.unionByName(unnamed).dropDuplicates(["node", "check", "text"]), "texts")


def _confirmed(pairs: DataFrame, texts, percent: int) -> DataFrame:
    """Of ``a, b`` those with 100 * intersection >= percent * union on full sets.

    Texts of the classes concerned meet their pairs; a class with many pairs is dealt to several
    tasks, its own text once to each. A task holds the set of one class and one other.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    deals = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 128).cast("int").alias("deals"))
    second = pairs.join(deals, "a").select("a", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"), F.col("b").alias("node"))
    first = deals.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("a").alias("node"))
    sides = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    met = sides.join(texts(nodes), "node").select("a", "deal", "side", "node", "check", "text")

    def run(batches):
        hub, own, done = None, None, set()
        for batch in batches:
            for part in slices(batch):
                a, side, node, check = (part.column(i).to_pylist() for i in (0, 2, 3, 4))
                found = []
                for i, text in enumerate(part.column(5).to_pylist()):
                    s = shingle_set(text)
                    if fingerprint(s) != (node[i], check[i]):  # another row that repeats the id
                        continue
                    if side[i] == 0:
                        hub, own, done = a[i], s, set()
                    elif hub == a[i] and node[i] not in done:
                        done.add(node[i])
                        if similar(own, s, percent):
                            found.append((a[i], node[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return met.repartition("a", "deal").sortWithinPartitions("a", "deal", "side", "node").mapInArrow(run, "a long, b long")


def _tiles(members: DataFrame, held: str) -> DataFrame:
    """Members of a key in pairs of blocks ``i, j``: a block has about ``BLOCK`` members and ``BLOCK_BYTES``, where ``held`` says how many bytes a member takes.

    A task keeps no more than a part of a tile's pairs, so only bytes limit a tile, and a bucket that fits in one is not copied.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.expr(held)) / BLOCK_BYTES)).cast("int")
    rows = members.join(members.groupBy("key").agg(blocks.alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def _by_tile(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(columns as lists)`` for whole tiles (key, i, j), whose rows stream in together, small ones in groups; yields Arrow batches."""

    def run(batches):
        held, at, size = [[] for _ in range(3 + len(columns))], None, 0
        for batch in batches:
            for part in slices(batch, 1024, text=part_of_text(batch)):
                lists = [c.to_pylist() for c in part.columns]
                for r, tile in enumerate(zip(*lists[:3], strict=True)):
                    if tile != at:
                        at = tile
                        if len(held[0]) >= GROUP or size >= BLOCK_BYTES:
                            yield from work(held)
                            held, size = [[] for _ in held], 0
                    for own, values in zip(held, lists, strict=True):
                        own.append(values[r])
                    size += len(lists[-1][r] or b"")
        if held[0]:
            yield from work(held)

    def part_of_text(batch):
        return batch.num_columns - 1  # signatures or texts come last

    rows = rows.select("key", "i", "j", *columns)
    # a set number of partitions: few bytes are much work here, so they must not be merged by size
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _candidates(held: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component of each member by number, and the rows ``x, y`` of all of the tiles' pairs, those of fewest errors first."""
    comp, parts = _pairs_of(held)
    none = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return comp, *_by_errors(*(np.concatenate(p) for p in zip(none, *parts, strict=True)))[1:]


def _by_errors(errors: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((y, x, errors))
    return errors[by], x[by], y[by]


def _pairs_of(held: list[list]):
    """Component of each member by number, and the tiles' pairs as ``errors, x, y``, by about ``HELD_PAIRS``; a pair's rows go by node.

    ``held``: key, i, j, node, comp, block, sig of whole tiles. A pair is of one tile, within the
    allowed errors, in two components, of two blocks unless the tile is one, and belongs to the tile:
    its key is the first that the two share, so each pair has one tile. A component has another
    number in each tile. Rows go by the size of their component, so that the largest is compared with
    the others, not with itself.
    """
    key, i, j, node, comp, block = (np.array(x) for x in held[:6])
    sig = _unpack(held[6])
    part = np.cumsum((np.diff(key, prepend=key[0]) != 0) | (np.diff(i, prepend=i[0]) != 0) | (np.diff(j, prepend=j[0]) != 0))
    comp = np.unique(comp, return_inverse=True)[1]
    comp, size = np.unique(part * len(comp) + comp, return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((node, comp, size[comp]))
    ends = np.flatnonzero(np.diff(comp[order], append=-1)) + 1
    columns = np.ascontiguousarray(sig[order].T)

    def parts():
        found, held_pairs = [], 0
        for at in range(0, len(node), STRIPE):
            lo = int(ends[np.searchsorted(ends, at, "right")])  # the first row's component ends there
            a, b = order[at : at + STRIPE], order[lo:]
            if not len(b):
                break
            ok = (part[a, None] == part[None, b]) & (comp[a, None] != comp[None, b])
            ok &= np.arange(at, at + len(a))[:, None] < np.arange(lo, len(node))[None, :]
            ok &= (i[a] == j[a])[:, None] | (block[a, None] != block[None, b])
            if not ok.any():
                continue
            if 8 * ok.sum() >= ok.size:
                errors = np.zeros(ok.shape, np.uint8)
                for line in columns:
                    errors += (line[at : at + STRIPE, None] != line[None, lo:]).view(np.uint8)
                ok &= errors <= MOST_ERRORS
            u, v = np.nonzero(ok)
            u, v = a[u].astype(np.int32), b[v].astype(np.int32)
            for x, y in ((u[k : k + 8192], v[k : k + 8192]) for k in range(0, len(u), 8192)):
                differ = sig[x] != sig[y]
                errors = differ.sum(axis=1, dtype=np.uint8)
                mine = (errors <= MOST_ERRORS) & (first_shared(differ) == (key[x] & 63))
                x, y = x[mine], y[mine]
                swap = node[x] > node[y]
                found.append((errors[mine], np.where(swap, y, x), np.where(swap, x, y)))
                held_pairs += len(x)
                if held_pairs >= HELD_PAIRS:
                    yield tuple(np.concatenate(f) for f in zip(*found, strict=True))
                    found, held_pairs = [], 0
        if held_pairs:
            yield tuple(np.concatenate(f) for f in zip(*found, strict=True))

    return comp, parts()


def _forest(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs make up the forest that joins components by the earliest pairs: fewer than there are components."""
    chosen = []
    at = np.arange(len(x))
    while True:
        at = at[comp[x[at]] != comp[y[at]]]
        if not len(at):
            return np.concatenate(chosen) if chosen else at
        first = np.full(comp.max() + 1, len(x))
        np.minimum.at(first, comp[x[at]], at)
        np.minimum.at(first, comp[y[at]], at)
        best = np.unique(first[first < len(x)])
        chosen.append(best)
        comp = smallest_roots(len(first), comp[x[best]], comp[y[best]])[comp]


def _tile_forest(held: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``x, y`` of the forest of all pairs of the tiles; no more than a part of the pairs is held, as a forest of forests is the whole one."""
    comp, parts = _pairs_of(held)
    kept = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)
    for part in parts:
        errors, x, y = _by_errors(*(np.concatenate(p) for p in zip(kept, part, strict=True)))
        best = np.sort(_forest(comp, x, y))
        kept = errors[best], x[best], y[best]
    return kept[1:]


def _likely(tiles: DataFrame) -> DataFrame:
    """Pairs ``a, b`` most likely to join components: a forest of each tile's pairs, so a tile gives fewer rows than it has members."""

    def work(held):
        x, y = _tile_forest(held)
        node = np.array(held[3])
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    return _by_tile(tiles, ["node", "comp", "block", "sig"], work, "a long, b long")


def _open_members(tiles: DataFrame) -> DataFrame:
    """Members of each tile that have a pair there: as components only grow, no other member will have one."""

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    names = ["key", "i", "j", "node", "comp", "block", "sig", "bytes"]

    def work(held):
        open_ = np.zeros(len(held[0]), bool)
        for _, x, y in _pairs_of([*held[:6], held[7]])[1]:
            open_[x] = open_[y] = True
        some = np.flatnonzero(open_).tolist()
        held = [*held[:6], held[7], held[6]]
        yield pa.RecordBatch.from_arrays([pa.array([column[r] for r in some], kind) for column, kind in zip(held, kinds, strict=True)], names)

    return _by_tile(tiles, ["node", "comp", "block", "bytes", "sig"], work, "key long, i int, j int, node long, comp long, block int, sig binary, bytes long")


def _links_left(tiles: DataFrame, texts, percent: int) -> DataFrame:
    """Links ``a, b`` between components, of all pairs within the allowed errors, confirmed where they are found.

    The members left are dealt out again, by the bytes of their texts. A pair whose components a link of the
    same tile has joined needs no look. Only links leave the task, fewer than the tile has members.
    """

    def work(held):
        comp, parts = _pairs_of(held)
        sets: dict[int, np.ndarray | None] = {}

        def set_of(i: int) -> np.ndarray | None:
            if i not in sets:
                s = shingle_set(held[8][i])
                sets[i] = s if fingerprint(s) == (held[3][i], held[7][i]) else None
            return sets[i]

        found = []
        for part in parts:
            x, y = _by_errors(*part)[1:]
            while len(x):
                live = comp[x] != comp[y]
                x, y = x[live], y[live]
                turn = max(1024, len(x) // 16)
                for i, j in zip(x[:turn].tolist(), y[:turn].tolist(), strict=True):
                    if comp[i] != comp[j]:
                        s, t = set_of(i), set_of(j)
                        if s is not None and t is not None and similar(s, t, percent):
                            comp[comp == comp[j]] = comp[i]
                            found.append((held[3][i], held[3][j]))
                x, y = x[turn:], y[turn:]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    members = tiles.select("key", "node", "comp", "sig", "bytes").dropDuplicates(["key", "node"])
    rows = _tiles(members, "bytes").join(texts(tiles.select("node").distinct()), "node")
    return _by_tile(rows, ["node", "comp", "block", "sig", "check", "text"], work, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Equal sets are one class. In each bucket of the index every class is first compared with the
    bucket's smallest; the components of those links then tell which further pairs of a bucket can
    matter, and only pairs across components are compared, the likeliest first. A pair inside one
    component needs no test: its link would change nothing. So groups of many copies cost their size,
    not its square, and what leaves a task is less than the rows it reads.

    Nulls, empty texts and texts without words have an empty set, component their own id. Texts of
    any length are read whole; a task holds ``BLOCK_BYTES`` of text, or one text, a block. Repeated
    rows share a class; a component's id is its smallest id; null ids are passed over unless all are
    null, and link like others. Extra columns, whatever their names, are not read; an empty table
    gives an empty result.
    """
    sets = materialize(_sets(documents, id_col, text_col), "sets")
    named = sets.where("n > 0")
    classes = named.groupBy("node", "check").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.max("bytes").alias("bytes"))
    classes = materialize(classes, "classes")
    buckets = materialize(_buckets(classes), "buckets")
    stars = materialize(_within(buckets.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), classes), "stars")
    spent: list[DataFrame] = []

    def texts(nodes: DataFrame) -> DataFrame:
        spent.append(_texts(nodes, classes, documents, id_col, text_col))
        return spent[-1]

    def found(links: DataFrame, name: str) -> DataFrame:
        """The links written, and what they were found in deleted."""
        links = materialize(links, name)
        discard(*spent)
        spent.clear()
        return links

    links = found(_confirmed(stars, texts, percent), "links")
    roots = connected_components(links)

    # What the stars leave open: buckets with members in different components. Likely pairs come
    # first, as each link may close many others; the last round leaves none out.
    tried = [stars]
    tiles = None
    for round_ in range(ROUNDS + 1):
        comp = roots.select("node", F.col("root").alias("comp"))
        if tiles is None:
            members = buckets.select("key", "node").union(buckets.select("key", F.col("leader").alias("node")).distinct())
            members = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            mixed = members.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            members = members.join(mixed.where("k > 2 and lo <> hi").select("key"), "key")
            members = materialize(members.join(classes.select("node", "sig", "bytes"), "node").select("key", "node", "bytes", "comp", "sig"), "open")
            met = _tiles(members, str(2 * POSITIONS))
        else:
            met = tiles.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        old, tiles = members if tiles is None else tiles, materialize(_open_members(met), "open_members")
        discard(old)
        if round_ < ROUNDS:
            likely = materialize(_likely(tiles).join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"), "likely")
            more = _confirmed(likely, texts, percent)
            tried.append(likely)
        else:
            more = _links_left(tiles, texts, percent)
        old, links = (links, roots), found(links.union(more), "all_links")
        discard(*old)
        roots = connected_components(links)
    discard(tiles)

    placed = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = materialize(placed.join(smallest, "root").select("node", "component_id"), "placed")
    discard(buckets, links, roots, classes, *tried)
    out = sets.select("id", "n", "node").join(placed.dropDuplicates(["node"]), "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` that stand for their group, each once.

    Rows that repeat both id and text are one document. Rows without an id are kept as they are.
    """
    text = options.get("text_col", "text")
    ids = near_duplicates(documents, id_col, **options).where("kept").select(F.col(id_col).alias("__id")).distinct()
    ids = ids.where("__id is not null")
    null_ids = documents.where(F.col(id_col).isNull())
    rows = documents.join(ids, F.col(id_col) == F.col("__id"))
    place = Window.partitionBy(id_col, F.sha2(F.col(text).cast("binary"), 256)).orderBy(id_col)
    rows = rows.withColumn("__place", F.row_number().over(place)).where("__place = 1")
    return rows.select(*documents.columns).unionByName(null_ids)
