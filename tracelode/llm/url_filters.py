"""URL filters: longest-match host and path rules over an exact Bloom filter cascade."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

#: (action, host, path): the rules of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hosts with such a label are the query's listed keys.
LISTED_LABEL = r"(^|\.)(spam|ads|phish|malware)[^.]*\."
#: Hosts of a shard on average, bits of a level for each key that it holds, and bytes of cascades that may be broadcast.
SHARD_KEYS, BITS_PER_KEY, MAX_BROADCAST = 1 << 18, 12.0, 16 << 20
#: Tasks that a shard's pages are dealt to where cascades aren't broadcast; pages sort after all levels.
CUTS, NO_LEVEL = 16, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its action; nulls where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, action = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


@dataclass(frozen=True)
class Cascade:
    """Levels of Bloom filters: even ones hold listed keys, odd ones the other keys let through before.

    A key's answer is set by the first level that lacks it: an even level says unlisted, an odd one
    listed. A key that all levels hold is listed if their number is odd. Exact for every key of the
    universe the cascade was built over.
    """

    levels: tuple[np.ndarray, ...]
    hashes: int

    def holds(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        words = self.levels[level]
        return _probe(words, self.hashes, level, h1, h2)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        answer = np.full(len(h1), len(self.levels) % 2 == 1)
        active = np.arange(len(h1))
        for level in range(len(self.levels)):
            held = self.holds(level, h1[active], h2[active])
            answer[active[~held]] = level % 2 == 1
            active = active[held]
        return answer


def _positions(bits: int, hashes: int, level: int, h1: np.ndarray, h2: np.ndarray):
    """Bit positions of each hash function, one array each; the level reseeds them."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    for i in range(hashes):
        x = a + b * np.uint64(i + 1 + level * 64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        yield x % np.uint64(bits)


def _probe(words: np.ndarray, hashes: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    held = np.ones(len(h1), bool)
    for at in _positions(len(words) * 64, hashes, level, h1, h2):
        held &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return held


def cascade_of(h1: np.ndarray, h2: np.ndarray, is_listed: np.ndarray, bits_per_key: float = BITS_PER_KEY) -> Cascade:
    """The cascade over a universe of distinct keys in memory.

    Each level is sized by the number of keys that it holds, and is built from the keys that all
    earlier levels hold, so that levels shrink geometrically. It ends when no key of the other kind
    is let through; keys that share both hashes can't be told apart and would never end it, so they
    are refused. An empty list gives no level: nothing is listed.
    """
    both = np.unique(np.stack([h1, h2]), axis=1).shape[1]
    if both < len(h1):
        raise ValueError("keys of the universe share both hashes")
    hashes = max(1, round(bits_per_key * math.log(2)))
    levels: list[np.ndarray] = []
    left = np.arange(len(h1))
    while True:
        level = len(levels)
        kind = is_listed[left] if level % 2 == 0 else ~is_listed[left]
        held, others = left[kind], left[~kind]
        if not len(held):
            return Cascade(tuple(levels), hashes)
        words = np.zeros(max(1, math.ceil(len(held) * bits_per_key / 64)), np.uint64)
        for at in _positions(len(words) * 64, hashes, level, h1[held], h2[held]):
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        levels.append(words)
        # keys held at this level go on, with those of the other kind that it lets through
        left = np.concatenate([held, others[_probe(words, hashes, level, h1[others], h2[others])]])


def build_cascades(universe: DataFrame, shards: int) -> DataFrame:
    """``shard, hashes, level, words``: the cascade of every shard that lists a key.

    ``universe`` has ``h1, h2, is_listed`` of distinct keys. A hash deals them to ``shards`` of about
    equal size, and each shard's cascade is built in one task, whatever the size of the whole.
    """

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        made = cascade_of(h1, h2, table.column("is_listed").to_numpy(zero_copy_only=False))
        n = len(made.levels)
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * n, pa.int32()), "hashes": pa.array([made.hashes] * n, pa.int32()), "level": pa.array(range(n), pa.int32()), "words": pa.array([x.tobytes() for x in made.levels], pa.binary())})

    dealt = universe.select(_shard(F.col("h1"), shards).alias("shard"), "h1", "h2", "is_listed")
    return dealt.groupBy("shard").applyInArrow(build, "shard int, hashes int, level int, words binary")


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(shards)).cast("int")


def _judged_by_shard(rows: DataFrame, cascades: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``__listed``, each beside its shard's cascade: levels come first in a partition's run of a shard.

    Shards are cut further by a hash of the row, with the cascade copied to each cut, so that a host
    with a third of all pages is many tasks. A task holds one shard's cascade and a batch of rows.
    """
    kinds = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    cuts = F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1)))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
    levels = cascades.select(F.col("shard").alias("__shard"), cuts.alias("__cut"), F.col("level").alias("__level"), F.col("hashes").alias("__hashes"), F.col("words").alias("__words"), *nothing)
    own = rows.select(_shard(F.col("__h1"), shards).alias("__shard"), F.pmod(F.xxhash64(*[F.col(f.name) for f in kinds]), F.lit(CUTS)).cast("int").alias("__cut"), F.lit(NO_LEVEL).alias("__level"), F.lit(0).alias("__hashes"), F.lit(None).cast("binary").alias("__words"), *[F.col(f.name) for f in kinds])
    names = [f.name for f in kinds]
    schema = T.StructType([*kinds, T.StructField("__listed", T.BooleanType())])

    def run(batches):
        at, levels, hashes = None, [], 0
        for batch in batches:
            shard, cut, level = (batch.column(c).to_numpy() for c in ("__shard", "__cut", "__level"))
            new = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(cut, prepend=-1) != 0))
            for lo, hi in zip(new, [*new[1:], batch.num_rows], strict=True):
                if (shard[lo], cut[lo]) != at:
                    at, levels = (shard[lo], cut[lo]), []
                mine = lo + int(np.searchsorted(level[lo:hi], NO_LEVEL))
                for row in range(lo, mine):
                    levels.append(np.frombuffer(batch.column("__words")[row].as_py(), np.uint64))
                    hashes = batch.column("__hashes")[row].as_py()
                part = batch.slice(mine, hi - mine)
                listed = Cascade(tuple(levels), hashes).listed(*(part.column(c).to_numpy().view(np.uint64) for c in ("__h1", "__h2")))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(listed)], schema.fieldNames())

    both = levels.unionByName(own)
    return both.repartition("__shard", "__cut").sortWithinPartitions("__shard", "__cut", "__level").mapInArrow(run, schema)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    shard_keys: int = SHARD_KEYS,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    ``listed`` has a column ``host`` with the blocked hosts. Where a rule fits, its action is the
    verdict; other pages are blocked if and only if their host is listed, which the cascades, built
    over all hosts of ``pages``, answer exactly with no join on the pages. Hosts are dealt by hash to
    shards of about ``shard_keys``, each with a cascade of its own. All cascades together are
    broadcast if they have at most ``max_broadcast`` bytes; beyond that pages go to their shard.

    A null url, or one without ``://``, has empty host and path; no rule fits it, and it is allowed
    unless the empty host is listed. Urls of any length are read whole; repeated rows and null ids
    are judged like others; null listed hosts count for nothing; empty tables give empty results.
    Extra columns, whatever their names, are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    h1, h2 = F.xxhash64("host", F.lit(17)), F.xxhash64(F.lit(71), "host")
    hosts = rows.select("host").distinct()
    marks = listed.select("host").where("host is not null").distinct().withColumn("mark", F.lit(True))
    universe = hosts.join(marks, "host", "left").select(h1.alias("h1"), h2.alias("h2"), F.col("mark").isNotNull().alias("is_listed"))
    universe = materialize(universe, "universe")
    shards = max(1, math.ceil(universe.count() / shard_keys))
    cascades = materialize(build_cascades(universe, shards), "cascades")
    discard(universe)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), action.alias("__action"), h1.alias("__h1"), h2.alias("__h2"))
    size = cascades.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    if size > max_broadcast:
        rows = _judged_by_shard(rows, cascades, shards)
    else:
        of: dict[int, list] = {}
        hashes = 1
        for r in cascades.orderBy("shard", "level").collect():
            of.setdefault(r.shard, []).append(np.frombuffer(r.words, np.uint64))
            hashes = r.hashes
        discard(cascades)
        shared = pages.sparkSession.sparkContext.broadcast({k: Cascade(tuple(v), hashes) for k, v in of.items()})

        @F.pandas_udf("boolean")
        def is_listed(shard: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            out = np.zeros(len(a), bool)
            for k in shard.unique():
                if k in shared.value:
                    at = (shard == k).to_numpy()
                    out[at] = shared.value[k].listed(*(x.to_numpy(np.int64)[at].view(np.uint64) for x in (a, b)))
            return pd.Series(out)

        rows = rows.withColumn("__listed", is_listed(_shard(F.col("__h1"), shards), "__h1", "__h2"))
    verdict = F.coalesce("__action", F.when(F.col("__listed"), "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def listed_hosts(pages: DataFrame, url_col: str = "url", label: str = LISTED_LABEL) -> DataFrame:
    """The query's list: all hosts of the pages that have a label named in ``label``."""
    return pages.select(host_of(F.col(url_col)).alias("host")).where(F.col("host").rlike(label)).distinct()
