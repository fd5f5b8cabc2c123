"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy.

The next subword is predicted in steps: its class, by attention over the context and a table by the
subword before; then the subword within the class, by corpus-wide pair counts. Classes are frequent
subwords of their own and groups of rarer ones. All counts, and with them the table, come from the
whole training text; the attention weights come from it too, by gradient on every training text,
task by task, and averaged.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, discard, fold, materialize, slices
from .tokens import WordTokens

#: Subwords known one by one; the others share one number and are told apart by their counts.
KNOWN = 1023
OTHER, EDGE, SIZE = KNOWN, KNOWN + 1, KNOWN + 2
LEAVES, GROUPS = 96, 32
CLASSES = LEAVES + GROUPS
WIDTH, STRIDE = 16, 16
#: Subword ids of the tokenizer, and the id that ends a text.
IDS, END_ID = 49408, 49407
#: Small corpora are read whole again until there were so many steps in all, in no more than so many passes.
STEPS, PASSES = 700, 8
#: A pass over all texts: runs of blocks a step, blocks a run, step size, subwords gathered for some steps, and parts that the weights are summed in.
RUNS, RUN, RATE, GATHER, PARTS = 16, 32, 0.003, 1 << 15, 16
#: Runs whose gradients are taken at once; the step size falls from the early one to ``RATE`` in so many steps.
TOGETHER, EARLY_RATE, EARLY = 2, 0.01, 150
#: Rows of a product over classes that the library takes at once.
PIECE = 176
#: Weights that the pass leaves as they are: the table holds counts of all texts.
COUNTED = ("table",)
#: Words whose counts every worker holds (16 bytes each), and words a worker numbers before it starts over.
HOT_WORDS, MOST_WORDS = 300_000, 400_000
#: Texts handed to Python at a time: their ids and hashes take more room than the texts.
BATCH = 1024


@dataclass
class Vocabulary:
    """``number`` by id, class by number, and log10 of what is not left to the network."""

    number: np.ndarray
    class_of: np.ndarray
    within: np.ndarray  # log10 p(number | class, number before), by number before and number
    rest: np.ndarray  # log10 p(id | number), by id


def build_vocabulary(unigrams: np.ndarray, pairs: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """From counts by id and by (number before, number): the vocabulary, and p(class | number before)."""
    number = number_ids(unigrams)
    by_number = np.bincount(number, unigrams, SIZE) + 1e-3
    class_of = np.full(SIZE, LEAVES, np.int64)
    order = np.argsort(-by_number[:OTHER], kind="stable")
    class_of[order[:LEAVES]] = np.arange(LEAVES)
    # groups of about equal weight, by what comes before their subwords
    tail = order[LEAVES:]
    profile = np.log1p(pairs[:, tail]).T
    profile = profile / (np.linalg.norm(profile, axis=1, keepdims=True) + 1e-9)
    axis = np.ones(profile.shape[1]) if not profile.any() else np.linalg.svd(profile.T @ profile)[0][:, 1]
    tail = tail[np.argsort(profile @ axis, kind="stable")]
    weight = np.cumsum(by_number[tail])
    class_of[tail] = LEAVES + np.minimum((weight - by_number[tail]) / weight[-1] * (GROUPS - 1), GROUPS - 2).astype(int)
    class_of[OTHER] = CLASSES - 1
    share = by_number / by_number.sum()
    smooth = pairs + 8.0 * share
    smooth[:, EDGE] = 0
    hot = np.zeros((SIZE, CLASSES))
    hot[np.arange(SIZE), class_of] = 1
    hot[EDGE] = 0
    by_class = smooth @ hot
    within = np.log10(np.maximum(smooth, 1e-30) / by_class[:, class_of])
    rest = np.zeros(IDS)
    unseen = number == OTHER
    rest[unseen] = np.log10((unigrams[unseen] + 1) / (unigrams[unseen] + 1).sum())
    return Vocabulary(number.astype(np.int16), class_of.astype(np.int8), within.astype(np.float32), rest.astype(np.float32)), by_class / by_class.sum(axis=1, keepdims=True)


def number_ids(unigrams: np.ndarray) -> np.ndarray:
    """0 to KNOWN - 1 for the most frequent ids, ties to the smaller id, OTHER for the rest."""
    number = np.full(IDS, OTHER, np.int64)
    number[np.argsort(-unigrams, kind="stable")[:KNOWN]] = np.arange(KNOWN)
    return number


class Network:
    """One head of causal self-attention over blocks of ``STRIDE`` with the block before as context.

    A block and the one before it are a window; windows overlap by half, and each token is scored in
    the window where it is in the second half, with 16 to 31 subwords of context.
    """

    #: ``biased()`` while the gradients of one step are taken.
    step_biased: np.ndarray | None = None

    def __init__(self, class_shares: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        near = np.concatenate([np.arange(STRIDE) - STRIDE, np.arange(STRIDE)])
        self.p = {
            "embed": f(SIZE, WIDTH, scale=0.3), "place": (-0.05 * np.abs(np.arange(STRIDE)[:, None] - near)).astype(np.float32),
            "q": f(WIDTH, WIDTH, scale=0.2), "k": f(WIDTH, WIDTH, scale=0.2), "v": f(WIDTH, WIDTH, scale=0.25), "o": f(WIDTH, WIDTH, scale=0.25),
            "out": f(WIDTH, CLASSES, scale=0.05), "scale": np.ones(1, np.float32), "bias": np.zeros(CLASSES, np.float32), "table": np.log(np.maximum(class_shares, 1e-6)).astype(np.float32),
        }
        mask = np.zeros((STRIDE, 2 * STRIDE), np.float32)
        mask[:, STRIDE:][np.triu_indices(STRIDE, 1)] = -1e9
        self.mask = mask

    def forward(self, before: np.ndarray, first: np.ndarray) -> dict:
        """``before``: numbers of the subword before each place, in blocks; ``first``: blocks that begin a text."""
        p = self.p
        n = len(before)
        x = p["embed"][before.ravel()]
        q, k, v = ((x @ p[w]).reshape(n, STRIDE, WIDTH) for w in "qkv")
        k2, v2 = (np.concatenate([np.concatenate([np.zeros_like(a[:1]), a[:-1]]), a], axis=1) for a in (k, v))
        s = q @ k2.transpose(0, 2, 1)
        s *= np.float32(WIDTH**-0.5)
        s += p["place"] + self.mask
        s[first, :, :STRIDE] = -1e9
        np.minimum(s, 40, out=s)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        mixed = (s @ v2).reshape(-1, WIDTH)
        h = mixed @ p["o"]
        h += x
        rows = p["table"][before.ravel()]
        z = h @ p["out"]
        z += rows * p["scale"]
        z += p["bias"]
        return {"rows": rows, "x": x, "q": q, "k2": k2, "v2": v2, "s": s, "mixed": mixed, "h": h, "z": z}

    def _attend(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries, keys, values, weights that aren't normalised yet, what they mix, and one over their sum.

        Queries, keys, values and a one lie beside each other, a row a place. A block's keys are the
        rows of the block before and its own, so windows overlap in memory and none is copied. The
        one beside the values gives the sum of the weights, and takes its part in the gradients.
        """
        p, n, kind = self.p, len(first), x.dtype
        rows = np.empty((len(x) + STRIDE, 3 * WIDTH + 1), kind)
        rows[:STRIDE], rows[STRIDE:, -1] = 0, 1
        np.matmul(x, np.concatenate([p["q"] * kind.type(WIDTH**-0.5), p["k"], p["v"]], axis=1), out=rows[STRIDE:, :-1])
        across, down = kind.itemsize, rows.strides[0]
        view = lambda start, at, places, width: np.ndarray((n, places, width), kind, rows, start * down + at * across, (STRIDE * down, down, across))
        q, k2, v2 = view(STRIDE, 0, STRIDE, WIDTH), view(0, WIDTH, 2 * STRIDE, WIDTH), view(0, 2 * WIDTH, 2 * STRIDE, WIDTH + 1)
        s = q @ k2.transpose(0, 2, 1)
        s += p["place"] + self.mask
        np.minimum(s, 40, out=s)
        np.exp(s, out=s)
        s[first, :, :STRIDE] = 0
        mixed = (s @ v2).reshape(-1, WIDTH + 1)
        over = 1 / mixed[:, WIDTH:]
        return q, k2, v2, s, mixed[:, :WIDTH] * over, over

    def biased(self) -> np.ndarray:
        """What the subword before adds to each class, as the weights are now."""
        return self.p["table"] * self.p["scale"] + self.p["bias"]

    def log10_classes(self, before: np.ndarray, first: np.ndarray, target: np.ndarray, biased: np.ndarray | None = None) -> np.ndarray:
        """log10 p(class) of each place's target: ``forward`` with fewer passes over memory.

        ``biased`` spares many batches working it out again. Exponents are taken as they are; the few
        batches where that overflows go through ``forward``.
        """
        p, flat = self.p, before.ravel()
        x = p["embed"].take(flat, 0)
        *_, mixed, _ = self._attend(x, first)
        h = mixed @ p["o"]
        h += x
        z = _product(h, p["out"])
        z += (self.biased() if biased is None else biased).take(flat, 0)
        own = z[np.arange(len(z)), target.ravel()]
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
            total = z @ np.ones(z.shape[1], z.dtype)
        if not _sound(total):
            z = self.forward(before, first)["z"].astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            own, total = z[np.arange(len(z)), target.ravel()], np.exp(z).sum(axis=1)
        return (own - np.log(total)) * np.float32(1 / np.log(10))

    def train(self, before: np.ndarray, first: np.ndarray, target: np.ndarray, live: np.ndarray, steps: int = STEPS, batch: int = 192, seed: int = 4) -> None:
        """Adam on the mean cross-entropy of classes over random pairs of neighbouring blocks."""
        if len(before) < 2:
            return
        rng = np.random.default_rng(seed)
        m = self.moments()
        for step in range(1, steps + 1):
            at = rng.integers(0, len(before) - 1, batch)
            rows = np.stack([at, at + 1], axis=1).ravel()  # the first of each pair is context only
            begin = first[rows].copy()
            begin[::2] = True
            use = live[rows].copy()
            use[::2] = False
            grads = self._gradients(before[rows], begin, target[rows].ravel(), use.ravel())
            self._adam(m, grads, step, 0.01 * min(1.0, 2 * (1 - step / (steps + 1))))

    def read(self, before: np.ndarray, first: np.ndarray, target: np.ndarray, live: np.ndarray, m: dict, step: int, seed: int = 9, early: bool = False) -> int:
        """Adam on the weights named in ``m`` over every block once, in runs of ``RUN`` blocks that the block before rides along with; the number of steps so far."""
        n = len(before)
        for starts in np.array_split(order := np.random.default_rng((seed, step)).permutation(np.arange(0, n, RUN)), -(-len(order) // RUNS)):
            at = starts[:, None] + np.arange(-1, RUN)
            rows = np.clip(at, 0, n - 1)
            begin, use = first[rows], live[rows] & (at < n)[:, :, None]
            begin[:, 0] = True
            use[:, 0] = False
            step, grads, total = step + 1, {}, max(1, use.sum())
            self.step_biased = self.biased()
            for lo in range(0, len(rows), TOGETHER):  # gradients of a few runs at a time stay in the cache
                few = rows[lo : lo + TOGETHER].ravel()
                live_few = use[lo : lo + TOGETHER].ravel()
                part, share = self._gradients(before[few], begin[lo : lo + TOGETHER].ravel(), target[few].ravel(), live_few, "table" in m), np.float32(live_few.sum() / total)
                grads = {k: share * g + (grads[k] if grads else 0) for k, g in part.items()}
            self.step_biased = None
            self._adam(m, grads, step, max(RATE, EARLY_RATE * (1 - step / EARLY)) if early else RATE)
        return step

    def moments(self, *without: str) -> dict:
        return {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.p.items() if k not in without}

    def _adam(self, m: dict, grads: dict, step: int, rate: float) -> None:
        for k, g in grads.items():
            a, b = m[k]
            a += np.float32(0.1) * (g - a)
            b += np.float32(0.01) * (g * g - b)
            self.p[k] -= np.float32(rate) * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.99**step)) + np.float32(1e-7))

    def _gradients(self, before: np.ndarray, first: np.ndarray, target: np.ndarray, use: np.ndarray, table: bool = True) -> dict:
        p, n, flat = self.p, len(before), before.ravel()
        kind = p["embed"].dtype
        x = p["embed"].take(flat, 0)
        q, k2, v2, s, mixed, over = self._attend(x, first)
        h = mixed @ p["o"]
        h += x
        z = _product(h, p["out"])
        rows = (self.biased() if self.step_biased is None else self.step_biased).take(flat, 0)
        z += rows
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
            total = z @ np.ones(CLASSES, kind)
        if not _sound(total):
            z = h @ p["out"] + rows
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            total = z @ np.ones(CLASSES, kind)
        # z less its total at the target, times the share, is the gradient of the loss; the share goes to what z meets
        share = (use / max(1, use.sum())).astype(kind) / total
        z[np.arange(len(z)), target] -= total
        g = {"out": _product_over_rows(h * share[:, None], z), "bias": share @ z}
        if abs(p["scale"][0]) > 0.01:  # the table's rows are the biased ones less the bias, over the scale
            g["scale"] = (share @ np.einsum("ij,ij->i", z, rows) - g["bias"] @ p["bias"]) / p["scale"]
        else:
            g["scale"] = (share @ np.einsum("ij,ij->i", z, p["table"].take(flat, 0)))[None]
        if table:
            g["table"] = _rows_added(flat, z * share[:, None]) * p["scale"]
        dh = _product(z, np.ascontiguousarray(p["out"].T))
        dh *= share[:, None]
        g["o"] = mixed.T @ dh
        dmixed = dh @ p["o"].T
        d = np.empty((len(x), WIDTH + 1), kind)
        np.multiply(dmixed, over, out=d[:, :WIDTH])
        d[:, WIDTH] = -np.einsum("ij,ij->i", d[:, :WIDTH], mixed)
        d = d.reshape(n, STRIDE, WIDTH + 1)
        ds = d @ v2.transpose(0, 2, 1)
        ds *= s
        g["place"] = (np.ones(n, kind) @ ds.reshape(n, -1)).reshape(STRIDE, 2 * STRIDE)
        scale = kind.type(WIDTH**-0.5)
        for w, got in (("q", ds @ k2), ("k", _given_back(ds, q)), ("v", _given_back(s, d[:, :, :WIDTH]))):
            got, w_scale = got.reshape(-1, WIDTH), scale if w == "q" else kind.type(1)
            g[w] = (x.T @ got) * w_scale
            dh += got @ (p[w].T * w_scale)
        g["embed"] = _rows_added(flat, dh)
        return g


def _sound(total: np.ndarray) -> bool:
    """Sums of exponentials that neither overflowed nor vanished."""
    return 1e-30 < total.min() and total.max() < np.inf


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in pieces of rows for which the library needs no copies."""
    out, whole = np.empty((len(a), b.shape[1]), a.dtype), len(a) // PIECE * PIECE
    if whole:
        np.matmul(a[:whole].reshape(-1, PIECE, a.shape[1]), b, out=out[:whole].reshape(-1, PIECE, b.shape[1]))
    if whole < len(a):
        np.matmul(a[whole:], b, out=out[whole:])
    return out


def _product_over_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` in pieces of rows, added up."""
    whole = len(a) // PIECE * PIECE
    out = a[whole:].T @ b[whole:]
    if whole:
        out += (a[:whole].reshape(-1, PIECE, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, PIECE, b.shape[1])).sum(axis=0)
    return out


def _given_back(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What each block's places get from the windows that they are in: their own and the next block's."""
    out = weights[:, :, STRIDE:].transpose(0, 2, 1) @ rows
    out[:-1] += weights[1:, :, :STRIDE].transpose(0, 2, 1) @ rows[1:]
    return out


def _rows_added(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each number."""
    width = rows.shape[1]
    cells = (at.astype(np.intp) * width)[:, None] + np.arange(width)
    out = np.zeros(SIZE * width, rows.dtype)
    np.add.at(out, cells.ravel(), rows.ravel())
    return out.reshape(SIZE, width)


def blocks_of(numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token of texts laid end to end goes in blocks padded text by text; blocks; first blocks."""
    per = -(-lengths // STRIDE)
    start = np.concatenate([[0], np.cumsum(per)])
    place = np.repeat(start[:-1] * STRIDE - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(numbers))
    first = np.zeros(start[-1], bool)
    first[start[:-1][per > 0]] = True
    return place, np.full(start[-1] * STRIDE, EDGE, np.int16), first


class Scorer:
    """log10 probability of texts given as ids, each text with its end."""

    def __init__(self, vocabulary: Vocabulary, network: Network) -> None:
        self.vocabulary, self.network = vocabulary, network

    def prepare(self, ids: np.ndarray, lengths: np.ndarray):
        v = self.vocabulary
        numbers = v.number[ids]
        place, before, first = blocks_of(numbers, lengths)
        previous = np.empty_like(numbers)
        previous[1:] = numbers[:-1]
        previous[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = EDGE
        before[place] = previous
        return numbers, previous, place, before.reshape(-1, STRIDE), first

    def lessons(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks, first blocks, classes to predict and live places, as ``Network.train`` takes them."""
        numbers, _, place, blocks, begin = self.prepare(np.concatenate(texts), np.array([len(x) for x in texts]))
        target, live = np.zeros(blocks.size, np.int64), np.zeros(blocks.size, bool)
        target[place], live[place] = self.vocabulary.class_of[numbers], True
        return blocks, begin, target.reshape(blocks.shape), live.reshape(blocks.shape)

    def score(self, ids: np.ndarray, lengths: np.ndarray, step: int = 128) -> np.ndarray:
        """All tokens of all texts, windows in batches of ``step`` blocks; a block's context rides along."""
        v = self.vocabulary
        numbers, previous, place, before, first = self.prepare(ids, lengths)
        target = np.zeros(before.size, np.int8)
        target[place] = v.class_of[numbers]
        target = target.reshape(before.shape)
        out, biased = np.empty(before.size, np.float32), self.network.biased()
        for at in range(0, len(before), step):
            lo = max(0, at - 1)
            got = self.network.log10_classes(before[lo : at + step], first[lo : at + step], target[lo : at + step], biased)
            out[at * STRIDE : (at + step) * STRIDE] = got[(at - lo) * STRIDE :]
        each = out[place].astype(np.float64) + v.within[previous, numbers] + v.rest[ids]
        return np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]]))


def _hash(word: bytes) -> int:
    """What Spark's xxhash64 gives for the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


class _Words(dict):
    """Numbers words as they come; a batch's new words are looked up together: hashes, subword ids, and how often each was counted."""

    def __init__(self, tokens: WordTokens) -> None:
        super().__init__()
        self.tokens = tokens
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.hashes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def settle(self) -> None:
        if not self.new:
            return
        flat, lengths = self.tokens.encode_words([w.decode("utf-8", "replace") for w in self.new])
        self.ids = np.concatenate([self.ids, np.frombuffer(flat, np.uint32).astype(np.uint16)])
        self.starts = np.concatenate([self.starts, np.cumsum(lengths) + self.starts[-1]])
        self.hashes = np.concatenate([self.hashes, np.array([_hash(w) for w in self.new], np.int64)])
        self.counts = np.concatenate([self.counts, np.zeros(len(self.new), np.int64)])
        self.new = []

    def encode(self, texts: list[bytes | None], counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts end to end, each with its end, where each ends, hashes of the words, where each ends; counts the words of the texts marked."""
        words = [x.lower().split() if x else [] for x in texts]
        n = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        self.settle()
        self.counts += np.bincount(at[np.repeat(counted, n)], minlength=len(self.counts))
        size = self.starts[at + 1] - self.starts[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], size) + np.arange(upto[-1])]
        word_ends = np.cumsum(n)
        ends = upto[word_ends]
        return np.insert(ids, ends, END_ID), ends + np.arange(1, len(n) + 1), self.hashes[at], word_ends


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values end to end as one binary value a text."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def encode_texts(rows: DataFrame, text_col: str, counted: str | None, tokenizer: str | None) -> DataFrame:
    """Each row without its text, with ``ids``, the text's subwords and end as 16-bit numbers, and ``hashes`` of its words; and rows ``word, c`` that have nothing else.

    The latter count, task by task, the words of texts that ``counted`` marks (all, if None): words
    lower-cased in A-Z, and the end of each text as the empty word. So a text is cut into words and
    subwords once, and no later pass does it again.
    """
    kept = [F.col(c) for c in rows.columns if c != text_col]
    rows = rows.select(F.col(text_col).cast("binary"), *kept)
    mark = rows.columns.index(counted) if counted else None
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema[1:]), T.StructField("ids", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("word", T.StringType()), T.StructField("c", T.LongType())])

    def run(batches):
        known, ends, kinds = _Words(WordTokens(tokenizer)), 0, []

        def words():
            some, names = np.flatnonzero(known.counts), list(known)
            texts = [*([b""] if ends else []), *(names[i] for i in some)]
            c = np.concatenate([[ends] if ends else [], known.counts[some]]).astype(np.int64)
            columns = [*(pa.nulls(len(c), k) for k in [*kinds, pa.binary(), pa.binary()]), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(c)]
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        for batch in batches:
            kinds = [c.type for c in batch.columns[1:]]
            for part in slices(batch, text=0):
                marks = np.ones(part.num_rows, bool) if mark is None else part.column(mark).to_numpy(zero_copy_only=False).astype(bool)
                ids, upto, hashes, words_upto = known.encode(part.column(0).to_pylist(), marks)
                ends += int(marks.sum())
                columns = [*part.columns[1:], _packed(ids.astype("<u2"), upto), _packed(hashes.astype("<i8"), words_upto), pa.nulls(part.num_rows, pa.string()), pa.nulls(part.num_rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())
                if len(known) > MOST_WORDS:
                    yield words()
                    known.reset()
                    ends = 0
        if known or ends:
            yield words()

    return rows.mapInArrow(run, schema)


def word_counts(training: DataFrame, text_col: str) -> DataFrame:
    """``word, c`` over all texts: words lower-cased in A-Z, and the end of each text as the empty word."""
    return _summed(encode_texts(training.select(text_col), text_col, None, None))


def _summed(encoded: DataFrame) -> DataFrame:
    return encoded.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("c").alias("c"))


def _subword_counts(counts: DataFrame, tokenizer: str | None) -> DataFrame:
    """``a, b, c``: how often subword b follows a in the training text's words; a is -1 at a word's start."""

    def run(batches):
        tokens = WordTokens(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                words = part.column(0).to_pylist()
                flat, lengths = tokens.encode_words([w for w in words if w])
                lengths, flat = np.array(lengths, np.int64), np.frombuffer(flat, np.uint32).astype(np.int64)
                if "" in words:  # the end of a text
                    at = words.index("")
                    flat, lengths = np.insert(flat, lengths[:at].sum(), END_ID), np.insert(lengths, at, 1)
                c = np.repeat(part.column(1).to_numpy(), lengths)
                before = np.concatenate([[-1], flat[:-1]])[: len(flat)]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                before[starts[lengths > 0]] = -1
                key, where = np.unique((before + 1) * IDS + flat, return_inverse=True)
                sums = np.bincount(where, c, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key // IDS - 1), pa.array(key % IDS), pa.array(sums)], ["a", "b", "c"])

    return counts.select("word", "c").mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def train_model(documents: DataFrame, counts: DataFrame, id_col: str, text_col: str, tokenizer: str | None, ids_col: str | None = None) -> Scorer:
    """Vocabulary and tables from counts of all training words; the network from all training texts, or their ids in ``ids_col``.

    To the driver come one row per subword id, one per pair of numbered subwords (about a million at
    most), and the network's weights.
    """
    spark = documents.sparkSession
    pairs = materialize(_subword_counts(counts, tokenizer), "subwords")
    unigrams = np.zeros(IDS)
    got = pairs.groupBy("b").agg(F.sum("c").alias("c")).toPandas()
    unigrams[got.b.to_numpy(np.int64)] = got.c.to_numpy(np.float64)
    number = number_ids(unigrams)
    named = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(number.tolist()) if n != OTHER], "id long, n int"))
    rows = pairs.join(named.toDF("a", "na"), "a", "left").join(named.toDF("b", "nb"), "b", "left")
    before = F.when(F.col("a") < 0, EDGE).otherwise(F.coalesce("na", F.lit(OTHER)))
    got = rows.groupBy(before.alias("a"), F.coalesce("nb", F.lit(OTHER)).alias("b")).agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros((SIZE, SIZE))
    table[got.a.to_numpy(np.int64), got.b.to_numpy(np.int64)] = got.c.to_numpy(np.float64)
    # what ends a word is followed by a word's start; so are the numbers that are seen with nothing after
    begins = table[EDGE] / max(1.0, table[EDGE].sum())
    table += 0.5 * np.maximum(0, np.bincount(number, unigrams, SIZE) - table.sum(axis=1))[:, None] * begins
    vocabulary, shares = build_vocabulary(unigrams, table)
    scorer = Scorer(vocabulary, Network(shares))
    discard(pairs)
    passes = int(np.clip(np.ceil(STEPS * RUNS * RUN * STRIDE / max(1.0, unigrams.sum())), 1, PASSES))
    for at in range(passes):
        read_all(documents, text_col, scorer, tokenizer, at == 0, ids_col)
    return scorer


def even_share(lengths: list[int], total: int) -> int:
    """The most subwords of a text so that all texts, cut at it, fit the total; longer texts leave nothing out of shorter ones."""
    left = sorted(lengths)
    for i, n in enumerate(left):
        if n * (len(left) - i) > total:
            return max(1, total // (len(left) - i))
        total -= n
    return max(left, default=1)


def read_all(training: DataFrame, text_col: str, scorer: Scorer, tokenizer: str | None, early: bool = False, ids_col: str | None = None) -> None:
    """One pass of every training text, whole, through the network, which tunes all weights but ``COUNTED``.

    ``ids_col`` holds the texts' ids as ``encode_texts`` gives them; without it texts are encoded here.

    Tasks start from the same weights; where they end is averaged, weighted by the subwords read,
    in ``PARTS`` sums, so that only the average comes to the driver.
    """
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(scorer)
    names = sorted(set(scorer.network.p) - set(COUNTED))

    def run(batches):
        model = shared.value
        network = Network.__new__(Network)
        network.mask, network.p = model.network.mask, {k: w.copy() for k, w in model.network.p.items()}
        m, step, seen = network.moments(*COUNTED), 0, 0
        ids, held = [], 0
        for batch in batches:
            for part in slices(batch, text=0):
                for x in part.column(0).to_pylist():
                    ids.append(np.frombuffer(x, "<u2"))
                    held += len(ids[-1])
                    if held >= GATHER:
                        step, seen = network.read(*model.lessons(ids), m, step, early=early), seen + held
                        ids, held = [], 0
        if held:
            step, seen = network.read(*model.lessons(ids), m, step, early=early), seen + held
        if seen:
            sums = np.concatenate([network.p[k].ravel() for k in names]).astype(np.float64) * seen
            parts = [x.tobytes() for x in np.array_split(sums, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array(parts, pa.binary())], ["part", "seen", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("sums").to_pylist())
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "seen": pa.array([sum(rows.column("seen").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "part int, seen long, sums binary"
    encoded = training.select(ids_col) if ids_col else encode_texts(training.select(text_col), text_col, None, tokenizer).where(F.col("ids").isNotNull()).select("ids")
    got = sorted(encoded.mapInArrow(run, kinds).groupBy("part").applyInArrow(add, kinds).collect(), key=lambda r: r.part)
    if got:
        mean, at = np.concatenate([np.frombuffer(r.sums) for r in got]) / got[0].seen, 0
        for k in names:
            w = scorer.network.p[k]
            scorer.network.p[k] = mean[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, modulus: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Learns from the rows whose crc32 of the id modulo ``modulus`` is not ``held``. ``base_score`` is
    the add-one unigram score of the words and the end; counts of the ``HOT_WORDS`` most frequent
    words, at most, are broadcast, those of the others are joined, so that no key of the join is
    frequent. Words are joined by a 64-bit hash. ``score`` is the model's log10 probability of the
    words' subwords and the end, each scored once.

    A null or empty text is its end alone. Texts are read whole; a task holds one slice of a few
    megabytes, or one longer text. A null id is in the training fold; repeated rows count each. With
    no training rows counts are 0, and the model knows no subword; an empty table gives an empty
    result. Extra columns, whatever their names, are not read.
    """
    held_out = fold(F.col(id_col), modulus) == held
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"), (~held_out).alias("learnt"))
    spark = documents.sparkSession
    with batches_of(spark, BATCH):
        encoded = materialize(encode_texts(rows, "text", "learnt", tokenizer), "encoded")
    texts = encoded.where(F.col("ids").isNotNull())
    counts = materialize(_summed(encoded).select("word", "c", F.xxhash64("word").alias("h")), "words")
    n_all, n_distinct, n_end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    # the least count of which the words fit the broadcast, in steps of an eighth of a power of two
    step = F.floor(F.log2("c") * 8)
    bins = counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.col("bin").desc()).collect()
    least, room = 1 << 62, HOT_WORDS
    for b in bins:
        room -= b.n
        if room < 0:
            break
        least = b.least
    hot = counts.where(F.col("c") >= least).select("h", "c").toPandas().sort_values("h")
    with batches_of(spark, BATCH):
        scorer = train_model(texts.where("learnt"), counts, "id", "text", tokenizer, "ids")
    shared = spark.sparkContext.broadcast((hot.h.to_numpy(np.int64), np.log10(hot.c.to_numpy(np.float64) + 1), scorer))
    end_log = float(np.log10(n_end + 1))
    schema = T.StructType([T.StructField("id", documents.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_hot", T.LongType()), T.StructField("hot_sum", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType()))])

    def run(batches):
        hashes, logs, model = shared.value
        for batch in batches:
            for part in slices(batch, 128, text=2):
                ids, words = part.column(2).to_pylist(), part.column(3).to_pylist()
                h = np.frombuffer(b"".join(words), "<i8")
                n = np.array([len(x) // 8 for x in words], np.int64)
                edge = np.concatenate([[0], np.cumsum(n)])
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                rare = hashes[at] != h if len(hashes) else np.ones(len(h), bool)
                sums = np.zeros(len(h) + 1)
                sums[1:][~rare] = logs[at[~rare]]
                sums = np.cumsum(sums)
                cold = np.concatenate([[0], np.cumsum(rare)])
                score = model.score(np.frombuffer(b"".join(ids), "<u2").astype(np.intp), np.array([len(x) // 2 for x in ids]))
                rare_of = pa.ListArray.from_arrays(pa.array(cold[edge], pa.int32()), pa.array(h[rare], pa.int64()))
                columns = [part.column(0), part.column(1), pa.array(n + 1), pa.array(n - np.diff(cold[edge]) + (n_end > 0)), pa.array(np.diff(sums[edge]) + end_log), pa.array(score), rare_of]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    scored = texts.select("id", "held_out", "ids", "hashes").mapInArrow(run, schema)
    with batches_of(spark, BATCH):
        scored = materialize(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    discard(encoded)
    rare = scored.select("uid", F.explode("rare").alias("h")).join(counts.where((F.col("c") < least) & (F.col("word") != "")).select("h", "c"), "h")
    rare = rare.groupBy("uid").agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"))
    out = scored.drop("rare").join(rare, "uid", "left")
    whole = float(np.log10(n_all + n_distinct + 1))
    base = F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
