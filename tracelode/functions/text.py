"""Text, hash and sketch expressions. All are JVM-side but the two that need zlib and byte counts, and the sketch that keeps hashes of words."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

# The rewrites of command text, in order.
SCLC = (
    ("<URL>", r"(?i)https?://[^\s'\"<>]+"),
    ("<IP>", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b"),
    ("<GUID>", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("<HASH>", r"\b[0-9a-fA-F]{32,64}\b"),
    ("<REG_KEY>", r"(?i)HKEY_[A-Z_]+(?:\\[a-zA-Z0-9_$. -]+)+"),
    ("<FILE_PATH>", r"(?i)(?:[a-zA-Z]:|%[A-Z_]+%|\\[a-zA-Z0-9_$.-]+)(?:\\[a-zA-Z0-9_$. -]+)+"),
    ("<FILE_PATH>", r"(?i)(?:/(?:bin|usr|etc|var|tmp|home|opt|dev|proc|sys)[^\s'\"<>]*)"),
)
EVENT_TOKEN = r"[a-z0-9_./:\-]+"
TRACE_TOKEN = r"[a-z0-9_]+(?:/[a-z0-9_.:-]+)?"


def normalize_sclc(text: Column) -> Column:
    """Command text with URLs, addresses, ids, hashes, keys and paths abstracted, in that order."""
    out = F.coalesce(text, F.lit(""))
    for mark, pattern in SCLC:
        out = F.regexp_replace(out, pattern, mark)
    return out


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def truthy(value: Column) -> Column:
    """A JSON scalar or container, as text, that is neither null, false, zero nor empty."""
    return value.isNotNull() & ~F.lower(F.trim(value)).isin("", "null", "false", "0", "0.0", "[]", "{}", '""')


def flux_tags(action: Column, raw: Column, attributes: Column, anomaly: Column | None = None) -> Column:
    """Bitmask of an event. Words are matched as substrings; ``attributes`` is a map of text."""
    a, r = F.lower(F.coalesce(action, F.lit(""))), F.lower(F.coalesce(raw, F.lit("")))
    attr = lambda k: F.try_element_at(attributes, F.lit(k))
    either = lambda words: contains_any(a, words) | contains_any(r, words)
    keys = F.coalesce(F.map_keys(attributes), F.array().cast("array<string>"))
    ai = F.exists(keys, lambda k: k.startswith("gen_ai.") | k.startswith("ai.")) | F.array_contains(keys, "model") | F.array_contains(keys, "prompt_tokens")
    score = F.coalesce(attr("anomaly_score").try_cast("double"), F.lit(0.0)) > 0.5
    bits = {
        S.ERROR: either(S.ERROR_WORDS) | F.lower(F.coalesce(attr("status"), F.lit(""))).isin("error", "fail"),
        S.ATTACK: contains_any(r, S.ATTACK_WORDS) | truthy(attr("technique_ids")) | truthy(attr("techniques")),
        S.NETWORK: contains_any(a, S.NETWORK_ACTIONS) | truthy(attr("remote_ip")) | truthy(attr("port")),
        S.FILE_MOD: contains_any(a, S.FILE_ACTIONS),
        S.AUTH: either(S.AUTH_WORDS),
        S.AI: ai,
        S.ANOMALY: score if anomaly is None else anomaly | score,
    }
    total = F.lit(0).cast("long")
    for bit, test in bits.items():
        total = total + F.when(test, F.lit(bit)).otherwise(F.lit(0))
    return total


def has_tags(tags: Column, mask: int) -> Column:
    return F.coalesce(tags, F.lit(0).cast("long")).bitwiseAND(F.lit(mask).cast("long")) != 0


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def template_hash(action: Column, object_class: Column, template: Column) -> Column:
    """sha256 of action, object class and abstracted template, joined by bars."""
    text = F.concat_ws("|", F.lower(F.trim(action)), F.lower(F.trim(object_class)), collapse_space(normalize_sclc(template)))
    return F.sha2(text.cast("binary"), 256)


def canonical_map(attributes: Column) -> Column:
    """Compact JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes))))


def event_tokens(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(f"({EVENT_TOKEN})"), F.lit(1))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TRACE_TOKEN), F.lit(0))


def ascii_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the bytes of a text, from their hex pairs. Empty: 0."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8")), F.lit(".."), F.lit(0))
    n = F.size(pairs).cast("double")
    ordered = F.array_sort(pairs)
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    part = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    step = lambda s, x: F.struct(
        x.alias("last"), F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(s["last"] == x, s["sum"]).otherwise(s["sum"] + part(s["run"])).alias("sum")
    )
    total = F.aggregate(ordered, zero, step, lambda s: s["sum"] + part(s["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def byte_entropy(data: bytes) -> float:
    n = len(data)
    if not n:
        return 0.0
    return -sum(c / n * math.log2(c / n) for c in (data.count(b) for b in set(data)))


_DEVIATION = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("ratio", T.DoubleType()), T.StructField("anomalous", T.BooleanType())])


@F.pandas_udf(_DEVIATION)
def compression_deviation(text: pd.Series) -> pd.DataFrame:
    """Byte entropy, zlib level 1 ratio and whether both are high; zlib has no JVM expression."""
    rows = []
    for value in text:
        data = (value or "").encode()
        if len(data) < 16:
            rows.append((0.0, 1.0, False))
            continue
        h, ratio = byte_entropy(data), len(zlib.compress(data, 1)) / len(data)
        rows.append((h, ratio, h > S.ENTROPY_LIMIT and ratio > S.RATIO_LIMIT))
    return pd.DataFrame(rows, columns=["entropy", "ratio", "anomalous"])


def trigrams(text: Column) -> Column:
    """Distinct lower-cased trigrams; a shorter text is one gram of itself."""
    t = F.lower(F.coalesce(text, F.lit("")))
    grams = F.regexp_extract_all(t, F.lit("(?s)(?=(...))"), F.lit(1))  # one pass; substr would start over at every place
    return F.array_distinct(F.when(F.length(t) < 3, F.array(t)).otherwise(grams))


def shingles(tokens: Column, widths=(1, 2, 3)) -> Column:
    """Distinct ``{w}g:`` shingles of one to three tokens, joined by the unit separator."""

    def of(w: int) -> Column:
        last = F.size(tokens) - (w - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(f"{w}g:"), F.array_join(F.slice(tokens, i, w), "\x1f")))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(w) for w in widths]))


def event_shingles(tokens: Column, techniques: Column) -> Column:
    """``u:``, ``b:``, ``t:`` n-grams of an event's tokens, and ``tech:`` marks."""

    def of(w: int, mark: str) -> Column:
        last = F.size(tokens) - (w - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(tokens, i, w), "\x1f")))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    tech = F.transform(F.coalesce(techniques, F.array().cast("array<string>")), lambda x: F.concat(F.lit("tech:"), x))
    return F.array_distinct(F.concat(of(1, "u:"), of(2, "b:"), of(3, "t:"), tech))


def slot_hash(slot: int, value: Column) -> Column:
    """16 hex digits of sha256("block:value"), of which each holds four slots: as text of fixed width, min is the unsigned min."""
    return F.substring(F.sha2(F.concat(F.lit(f"{slot // 4}:"), value).cast("binary"), 256), slot % 4 * 16 + 1, 16)


def minhash(values: Column, slots: int = S.SKETCH_SLOTS) -> Column:
    """Sketch of a set of texts: ``slots`` minima, null for an empty set. One digest is four slots."""
    digests = lambda b: F.transform(values, lambda v: F.sha2(F.concat(b.cast("string"), F.lit(":"), v).cast("binary"), 256))
    least = lambda ds, at: F.array_min(F.transform(ds, lambda d: F.substring(d, at, 16)))
    four = lambda b: F.transform(F.array(digests(b)), lambda ds: F.array(*[least(ds, at) for at in (1, 17, 33, 49)]))[0]
    sketch = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((slots - 1) // 4)), four)), 1, slots)
    return F.when(F.size(values) > 0, sketch)


#: Words whose hashes a worker keeps (8 bytes a slot each), and words gathered at once.
KEPT_WORDS, GATHERED_WORDS = 100_000, 20_000


class _SlotHashes(dict):
    """Rows of a table with every slot's hash of a word."""

    def __init__(self, slots: int) -> None:
        super().__init__()
        self.blocks = [f"{b}:".encode() for b in range(-(-slots // 4))]
        self.table = np.empty((1024, len(self.blocks) * 4), np.uint64)

    def __missing__(self, word: str) -> int:
        n, data = len(self), word.encode()
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[n] = np.frombuffer(b"".join([hashlib.sha256(b + data).digest() for b in self.blocks]), ">u8")
        self[word] = n
        return n


def _hex_sketches(parts, slots: int):
    """Arrays of 16-digit texts from arrays of words, a null for each without words."""
    known = _SlotHashes(slots)
    for part in parts:
        flat, ends, least = part.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)), []
        sizes = np.diff(ends, prepend=0)
        row = 0
        while row < len(part):
            upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + GATHERED_WORDS, "right")))
            if len(known) > KEPT_WORDS:
                known = _SlotHashes(slots)
            begin = int(ends[row - 1]) if row else 0
            at = np.fromiter((known[w] for w in flat[begin : int(ends[upto - 1])].to_pylist()), np.int64, int(ends[upto - 1]) - begin)
            live = sizes[row:upto] > 0
            starts = (ends[row:upto] - sizes[row:upto] - begin)[live]
            if len(starts):
                least.append(np.minimum.reduceat(known.table[at], starts, axis=0)[:, :slots])
            row = upto
        digits = np.concatenate(least).astype(">u8").tobytes().hex() if least else ""
        texts = pa.StringArray.from_buffers(len(digits) // 16, pa.py_buffer(np.arange(0, len(digits) + 1, 16, dtype=np.int32)), pa.py_buffer(digits.encode()))
        offsets = np.concatenate([[0], np.cumsum(sizes > 0) * slots]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), texts, mask=pa.array(sizes == 0))


def known_minhash(values: Column, slots: int = S.SKETCH_SLOTS) -> Column:
    """``minhash`` for many sets of few words: each worker hashes a word once, slots are minima over rows of a table."""

    def sketch(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _hex_sketches(parts, slots)

    # as if not deterministic: a filter on the sketch, moved below it, would sketch twice
    return F.arrow_udf(sketch, "array<string>").asNondeterministic()(values)


def fast_minhash(values: Column, slots: int = S.SKETCH_SLOTS) -> Column:
    """One 64-bit hash a value, slots by remixing: other values than ``minhash``, many times faster."""
    hashes = F.transform(values, lambda v: F.xxhash64(v))
    sketch = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))
    return F.when(F.size(values) > 0, sketch)


def sketch_jaccard(a: Column, b: Column) -> Column:
    """Share of equal slots; sketches of empty sets, which are null, are equal to each other and to no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.coalesce(same / F.size(a), F.lit(0.0)))


def merge_sketches(a: Column, b: Column) -> Column:
    return F.coalesce(F.zip_with(a, b, lambda x, y: F.least(x, y)), a, b)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def round_binary(x: Column, digits: int) -> Column:
    """Rounds the product with a power of ten, halves away from zero, as DuckDB does; ``F.round`` rounds the decimal text of the double."""
    return F.round(x * 10.0**digits) / 10.0**digits


def duration_sim(a: Column, b: Column) -> Column:
    """1 if both are 0, 0 if one is, else 1 / (1 + |ln(a / b)|)."""
    both = (a <= 0) & (b <= 0)
    one = (a <= 0) | (b <= 0)
    return F.when(both, 1.0).when(one, 0.0).otherwise(1 / (1 + F.abs(F.ln(a / b))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null for unequal lengths, 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(length > 0, dot / length).otherwise(F.lit(0.0)))
