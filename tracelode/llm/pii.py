"""Personal data: checked patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table that a rule writes (``labelled_table``), by maximum
likelihood with forward and backward sums, and decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Outside, inside an entity of a kind, and the first word of an entity right after another of its kind.
TAGS = ("O", *KINDS, *(f"+{k}" for k in KINDS))
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_TOKEN = re.compile(r"\S+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind; matches that fail their check are dropped.

    Emails are found from each ``@``: the run of local characters before it, back to the last match,
    and the domain after it, so that no text takes more than linear time.
    """
    out: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            out.append(("email", start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by start, then kind in listing order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# Word shapes


class _Shapes(dict):
    """Maps a character to its class for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c if code < 128 else "?"
        self[code] = value
        return value


_shapes = _Shapes()
_RUN, _HEX = re.compile(r"(.)\1+"), re.compile(r"[0-9a-f]{12,}")
#: Words that tell what the next ones are.
TRIGGERS = frozenset("(at) [at] (dot) [dot] phone tel call fax mobile email mail password passwd token key secret card visa ip address version page number year dated license licence".split())
#: Names whose value, after an equals sign, may be a secret.
SECRET_NAMES = frozenset("password passwd token key api_key secret".split())
EDGE = ("", "", "", "")
#: Shapes a field numbers before it forgets them: bounds memory on texts of endless shapes.
MOST_SHAPES = 200_000
_MARKS = ".,!?;:$%&#*"


def shape_key(word: str) -> tuple[str, str, str, str]:
    """What the field sees of a word: its collapsed shape, its shape with digit runs counted, a trigger, a size class."""
    letters = word.rstrip(_MARKS)
    if letters.isalpha():
        lower = letters.lower()
        shape = "x" if letters == lower else "Xx" if letters[1:].islower() else "X"
        return shape + _RUN.sub(r"\1", word[len(letters) :]), "", lower if lower in TRIGGERS else "", ""
    shape = word.translate(_shapes)
    runs = _RUN.sub(lambda m: m.group(1) + (str(min(len(m.group()), 20)) if m.group(1) == "d" else ""), shape)
    core = word.lower() if word[0] in "([" and word[-1] in ")]" else word.strip(".,;:!?\"'()[]{}<>#$%&*=").lower()
    digits = shape.count("d")
    size = ("hex" if _HEX.search(core) and digits and not core.isdigit() else "") + f"{min(digits, 20)}" + ("@" if "@" in word[1:-1] else "") + ("=" if "=" in word[1:-1] else "")
    name = core.partition("=")[0] if "=" in core else ""
    trigger = core if core in TRIGGERS else f"{name}=" + ("hex" if size.startswith("hex") else "d" if digits else "") if name in SECRET_NAMES else ""
    return _RUN.sub(r"\1", shape)[:24], runs[:32] if digits else "", trigger, size


def key_features(key: tuple[str, str, str, str], offset: int) -> list[str]:
    names = "srtz" if abs(offset) < 2 else "t"
    return [f"{offset}{n}{v}" for n, v in zip("srtz", key, strict=True) if n in names and v] or [f"{offset}-"]


# The labelled table


def labelled_table(rows: int = 900, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Token and tag lists written by a rule: entities of every kind and look-alikes among invented words."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = lambda n: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))
    syllables = ("an", "ber", "ción", "de", "en", "ing", "lé", "ly", "mon", "or", "que", "re", "sch", "st", "th", "ti", "ung")

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(1 + int(rng.integers(3))))
        return pick((w, w, w, w, w, w.capitalize(), w + ".", w + ",", w.upper() + "!!", w + pick(("$$$", "&&&", "%%%", "###", "***"))))

    def name() -> str:
        return "".join(pick("abcdefghijklmnoprstuvw") for _ in range(3 + int(rng.integers(6))))

    def card() -> str:
        body = pick(("4", "5", "3")) + digits(14)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    def entity(kind: int) -> tuple[list[str], str]:
        tail = pick(("", "", "", ".", ","))
        if kind == 0:
            return [f"{name()}.{digits(2)}@{name()}{digits(1)}.example.com{tail}"], "email"
        if kind == 1:
            return [f"{name()}@{name()}.{pick(('org', 'net', 'de'))}{tail}"], "email"
        if kind == 2:
            return [name(), pick(("(at)", "[at]")), name(), pick(("(dot)", "[dot]")), pick(("com", "org"))], "email"
        if kind == 3:
            return [".".join(str(int(rng.integers(256))) for _ in range(4)) + tail], "ip"
        if kind == 4:
            return [card() + tail], "card"
        if kind == 5:
            c = card()
            return [c[:4], c[4:8], c[8:12], c[12:] + tail], "card"
        if kind == 6:
            c = card()
            return ["-".join((c[:4], c[4:8], c[8:12], c[12:])) + tail], "card"
        if kind == 7:
            return [f"+{pick('1234')}", f"({digits(3)})", f"555-{digits(4)}{tail}"], "phone"
        if kind == 8:
            return [f"({digits(3)})", f"{digits(3)}-{digits(4)}{tail}"], "phone"
        if kind == 9:
            sep = pick("-.")
            return [sep.join((digits(3), digits(3), digits(4))) + tail], "phone"
        if kind == 10:
            return [f"{pick(('password', 'password', 'passwd'))}={hexes(10 + int(rng.integers(12)))}{tail}"], "secret"
        if kind == 11:
            return [pick(("token", "key", "secret")), "=", f'"{hexes(32 + 8 * int(rng.integers(2)))}"{tail}'], "secret"
        return [f"{pick(('api_key', 'token', 'secret'))}={hexes(24)}{tail}"], "secret"

    def lookalike() -> list[str]:
        kind = int(rng.integers(14))
        return [
            lambda: ["Version", f"{digits(1)}.{digits(1)}."], lambda: [f"{1900 + int(rng.integers(130))}"], lambda: [f"${digits(2)}.{digits(2)}"],
            lambda: [f"20{digits(2)}-0{1 + int(rng.integers(9))}-1{digits(1)}"], lambda: [f"1{digits(1)}:{1 + int(rng.integers(5))}{digits(1)}"],
            lambda: ["CC", "BY-NC", "4.0."], lambda: ["page", f"{digits(2)}"], lambda: [f"#{digits(4)}"], lambda: [f"{digits(1)},{digits(3)},{digits(3)}"],
            lambda: ["version", f"{digits(1)}."], lambda: [word(), "|", word(), "|"],
            lambda: [f"{name()}.{name()}"] * (1 + int(rng.integers(6))), lambda: [f"{name()},{name()}"] * (1 + int(rng.integers(6))),
            lambda: [f"{pick(('key', 'id', 'page', 'token'))}={name()}"],
        ][kind]()

    table = []
    for i in range(rows):
        tokens = [word() for _ in range(int(rng.integers(0, 8)))]
        tags = ["O"] * len(tokens)
        if i % 3:
            form = int(rng.integers(13))
            more, kind = entity(form)
            secret = kind == "secret" and len(more) == 3
            marks = ["O", "O", "secret"] if secret else [kind] * len(more)
            if i % 5 == 0 and not secret:  # another of the kind right after it
                second, _ = entity(form)
                more, marks = more + second, [*marks, f"+{kind}", *[kind] * (len(second) - 1)]
        else:
            more = lookalike()
            marks = ["O"] * len(more)
        tokens += more
        tags += marks
        after = [word() for _ in range(int(rng.integers(0, 6)))]
        table.append((tokens + after, tags + ["O"] * len(after)))
    return table


# The field


class _Numbers(dict):
    """Shape numbers by word; a miss works out the shape."""

    def __init__(self, owner: Field) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        n = self[word] = self.owner.number(shape_key(word) if word else EDGE)
        return n


@dataclass
class Field:
    """Weights by feature, transitions by tag pair; shapes are numbered as they turn up."""

    weights: dict[str, np.ndarray]
    trans: np.ndarray
    ids: dict = field(default_factory=dict)
    emit: list = field(default_factory=lambda: [[] for _ in range(5)])
    words: dict = field(default_factory=dict)  # numbers by word
    table: np.ndarray | None = None
    lead: np.ndarray | None = None

    def number(self, key: tuple) -> int:
        n = self.ids.get(key)
        if n is None:
            if len(self.ids) > MOST_SHAPES:
                raise OverflowError
            n = self.ids[key] = len(self.ids)
            for slot, offset in enumerate((-2, -1, 0, 1, 2)):
                self.emit[slot].append(sum((self.weights.get(f, 0.0) for f in key_features(key, offset)), np.zeros(len(TAGS))))
            self.table = self.lead = None
        return n

    def reset(self) -> None:
        self.ids, self.words, self.emit, self.table, self.lead = {}, {}, [[] for _ in range(5)], None, None
        self.number(EDGE)

    def numbers(self, words: list[str]) -> np.ndarray:
        if not self.ids:
            self.reset()
        if not isinstance(self.words, _Numbers) or len(self.words) > 250_000:
            self.words = _Numbers(self)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        """Scores by tag of a sequence whose lines are set apart by two edges."""
        self._tables()
        e = self.table[2][numbers]
        for slot, shift in ((0, 2), (1, 1), (3, -1), (4, -2)):
            if len(numbers) > abs(shift):
                if shift > 0:
                    e[shift:] += self.table[slot][numbers[:-shift]]
                else:
                    e[:shift] += self.table[slot][numbers[-shift:]]
        return e

    def leads(self, numbers: np.ndarray) -> np.ndarray:
        """For each word at most the least that O leads by over a tag, less what that tag may gain from its neighbours.

        The sum of the leads in each slot alone is at most the lead in the sum of the slots, so one
        number a slot tells where scores by tag aren't needed.
        """
        if self.lead is None:
            gain, _ = self._gains()
            self.lead = np.stack([x[:, 0] - (x[:, 1:] + gain * (slot == 2)).max(axis=1) for slot, x in enumerate(self._tables())])
        lead = self.lead[2][numbers]
        for slot, shift in ((0, 2), (1, 1), (3, -1), (4, -2)):
            if len(numbers) > abs(shift):
                if shift > 0:
                    lead[shift:] += self.lead[slot][numbers[:-shift]]
                else:
                    lead[:shift] += self.lead[slot][numbers[-shift:]]
        return lead

    def _gains(self) -> tuple[np.ndarray, float]:
        """What a tag's transitions may gain over O's, a transition between two tags shared by halves; what cutting a run at both ends may lose."""
        g = self.trans - self.trans[0, 0]
        into = np.maximum(g[1:, 1:].max(axis=0) / 2, g[0, 1:])
        out = np.maximum(g[1:, 1:].max(axis=1) / 2, g[1:, 0])
        after = (g[1:, 1:] / 2 - g[1:, :1]).max()
        before = (g[1:, 1:] / 2 - g[:1, 1:]).max()
        return into + out, max(after, 0.0) + max(before, 0.0)

    def _open(self, lead: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Words that the best path may tag.

        A run of tagged words whose leads are all above zero would gain by being O, so each run has a
        word that is not so, a core. What lies beyond a core in its run, or between two, would gain by
        being O if its leads add up to more than cutting the run there may lose.
        """
        core = (lead <= 1e-3) & real
        slack = np.where(core, 0.0, np.where(real, lead, 1e4)).astype(np.float64)
        upto, n = np.cumsum(slack), len(lead)
        left = np.maximum.accumulate(np.where(core, np.arange(n), -1))
        right = np.minimum.accumulate(np.where(core, np.arange(n), n)[::-1])[::-1]
        behind = np.where(left >= 0, upto - upto[left], np.inf)
        ahead = np.where(right < n, upto[np.minimum(right, n - 1)] - upto + slack, np.inf)
        return real & (np.minimum(behind, ahead) <= self._gains()[1] + 1e-3)

    def _tables(self) -> np.ndarray:
        if self.table is None:
            self.table, self.lead = np.array(self.emit, np.float32), None
        return self.table

    def emissions_by_parts(self, words: list[str]) -> np.ndarray:
        """What ``emissions`` gives, for words of any number of shapes: numbers are forgotten after each part, two words on either side ride along."""
        out = np.empty((len(words), len(TAGS)), np.float32)
        part = max(1, MOST_SHAPES - 4)
        for at in range(0, len(words), part):
            self.reset()
            lo = max(0, at - 2)
            e = self.emissions(self.numbers(words[lo : at + part + 2]))
            out[at : at + part] = e[at - lo : at - lo + part]
        self.reset()
        return out

    def tags(self, words: list[str]) -> np.ndarray:
        """Best tags. ``words`` begins and ends with two empty words and has two between lines.

        Only runs of words that the best path may tag (``_open``) are decoded, each framed by O, all
        of them in one batch; every other word is O on it, by proof.
        """
        real = np.fromiter(map(bool, words), bool, len(words))
        try:
            numbers = self.numbers(words)
            open_ = self._open(self.leads(numbers), real)
            some = np.flatnonzero(open_)
            e = np.zeros((len(words), len(TAGS)), np.float32)
            e[some] = sum(self.table[slot][numbers[some + slot - 2]] for slot in range(5))
        except OverflowError:
            e = self.emissions_by_parts(words)
            open_ = self._open(e[:, 0] - (e[:, 1:] + self._gains()[0]).max(axis=1), real)
        out = np.zeros(len(words), np.int8)
        edge = np.diff(np.concatenate([[0], open_.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        order = np.argsort(ends - starts, kind="stable")
        for at in range(0, len(order), 1024):
            group = order[at : at + 1024]
            self._viterbi(e, starts[group], ends[group], out)
        return out

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        """Runs sorted by length; those that have ended keep their scores."""
        lengths = ends - starts
        score = e[starts] + self.trans[0]
        back = []
        for step in range(1, int(lengths[-1])):
            live = np.flatnonzero(lengths > step)
            paths = score[live][:, :, None] + self.trans
            back.append((live[0], paths.argmax(axis=1).astype(np.int8)))
            score[live] = paths.max(axis=1) + e[starts[live] + step]
        best = (score + self.trans[:, 0]).argmax(axis=1)
        out[ends - 1] = best
        for step in range(int(lengths[-1]) - 1, 0, -1):
            first, came = back[step - 1]
            live = np.arange(first, len(lengths))
            best[live] = came[np.arange(len(live)), best[live]]
            out[starts[live] + step - 1] = best[live]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train_field(table: list[tuple[list[str], list[str]]] | None = None, epochs: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Adam on the mean log-likelihood of the labelled table, with all rows in every step."""
    table = labelled_table() if table is None else table
    names: dict[str, int] = {}
    n, width, tags = len(table), max(len(t) for t, _ in table), len(TAGS)
    where, what, gold, mask = [], [], np.zeros((n, width), int), np.zeros((n, width), bool)
    for i, (tokens, marks) in enumerate(table):
        keys = [EDGE, EDGE, *map(shape_key, tokens), EDGE, EDGE]
        mask[i, : len(tokens)] = True
        gold[i, : len(tokens)] = [TAGS.index(m) for m in marks]
        for j in range(len(tokens)):
            for offset in (-2, -1, 0, 1, 2):
                for f in key_features(keys[j + 2 + offset], offset):
                    where.append(i * width + j)
                    what.append(names.setdefault(f, len(names)))
    where, what = np.array(where), np.array(what)
    w, t = np.zeros((len(names), tags)), np.zeros((tags, tags))
    # expected minus observed counts; lines are framed by O
    frame_gold = np.zeros((tags, tags))
    for i in range(n):
        path = [0, *gold[i][mask[i]], 0]
        np.add.at(frame_gold, (path[:-1], path[1:]), 1)
    hot = np.zeros((n * width, tags))
    hot[np.arange(n * width)[mask.ravel()], gold[mask]] = 1
    moments = [np.zeros_like(x) for x in (w, w, t, t)]
    last = mask.sum(axis=1) - 1
    rows = np.arange(n)
    for step in range(1, epochs + 1):
        e = np.zeros((n * width, tags))
        for k in range(tags):
            e[:, k] = np.bincount(where, w[what, k], n * width)
        e = e.reshape(n, width, tags)
        alpha, beta = np.zeros((n, width, tags)), np.zeros((n, width, tags))
        alpha[:, 0] = e[:, 0] + t[0]
        for j in range(1, width):
            alpha[:, j] = _logsum(alpha[:, j - 1][:, :, None] + t, 1) + e[:, j]
        beta[rows, last] = t[:, 0]
        for j in range(width - 2, -1, -1):
            ahead = _logsum(t + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where((j < last)[:, None], ahead, beta[:, j])
        total = _logsum(alpha[rows, last] + t[:, 0], 1)
        p = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * mask[:, :, None]
        pairs = p[:, 0].sum(axis=0)[None, :] * np.eye(tags)[:, :1]
        pairs[:, 0] += p[rows, last].sum(axis=0)
        for j in range(1, width):
            inner = alpha[:, j - 1][:, :, None] + t + (e[:, j] + beta[:, j])[:, None, :] - total[:, None, None]
            pairs += (np.exp(np.minimum(inner, 0)) * mask[:, j][:, None, None]).sum(axis=0)
        d = p.reshape(-1, tags) - hot
        gw = np.stack([np.bincount(what, d[where, k], len(names)) for k in range(tags)], axis=1) / n + decay * w
        gt = (pairs - frame_gold) / n + decay * t
        for x, g, a in ((w, gw, 0), (t, gt, 2)):
            moments[a] += 0.1 * (g - moments[a])
            moments[a + 1] += 0.01 * (g * g - moments[a + 1])
            x -= rate * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[a + 1] / (1 - 0.99**step)) + 1e-8)
    return Field({f: w[i] for f, i in names.items()}, t)


_STRIP = ".,;:!?\"'#$%&*"
_BESIDE = _STRIP + " \t\r\f\v<>|/="


def field_spans(texts: list[str], crf: Field) -> list[list[tuple[str, int, int]]]:
    """Spans the field finds in whole texts, a line a chain; neighbouring tokens of one kind are one span unless the later one begins another."""
    words: list[str] = ["", ""]
    ends = []
    for text in texts:
        for line in text.split("\n"):
            words += line.split()
            words += ("", "")
        ends.append(len(words))
    tags = crf.tags(words)
    out = []
    start = 2
    for text, end in zip(texts, ends, strict=True):
        marked = np.flatnonzero(tags[start:end])
        spans: list[tuple[str, int, int]] = []
        if len(marked):
            place = np.cumsum([w != "" for w in words[start:end]]) - 1
            at = [m.span() for m in _TOKEN.finditer(text)]
            before = None
            for m in marked:
                a, b = at[place[m]]
                tag = TAGS[tags[start + m]]
                kind = tag.removeprefix("+")
                if before == (m - 1, kind) and tag == kind:
                    spans[-1] = (kind, spans[-1][1], b)
                else:
                    spans.append((kind, a, b))
                before = (m, kind)
            spans = [_tight(text, s) for s in spans]
        out.append([s for s in spans if s[1] < s[2]])
        start = end
    return out


def _tight(text: str, span: tuple[str, int, int], off: str = _STRIP) -> tuple[str, int, int]:
    kind, a, b = span
    while a < b and text[a] in off:
        a += 1
    while b > a and text[b - 1] in off:
        b -= 1
    return kind, a, b


def all_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """The base spans, and what they leave of the field's spans: each rest that has a letter or digit, without space and marks at its ends."""
    out, i = list(base), 0
    taken: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    for kind, a, b in more:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((kind, a, b))
            continue
        j, at, rests = i, a, []
        while j < len(taken) and taken[j][0] < b:
            rests.append((at, taken[j][0]))
            at = taken[j][1]
            j += 1
        for lo, hi in (*rests, (at, b)):
            rest = _tight(text, (kind, lo, hi), _BESIDE) if lo < hi else (kind, lo, lo)
            if any(map(str.isalnum, text[rest[1] : rest[2]])):
                out.append(rest)
    return out


def _run(documents: DataFrame, carry: list[str], text_col: str, schema: T.StructType, make):
    crf = train_field()
    shared = documents.sparkSession.sparkContext.broadcast((crf.weights, crf.trans))

    def run(batches):
        own = Field(*shared.value)
        for batch in batches:
            for part in slices(batch, 128, text=len(carry)):
                texts = [x or "" for x in part.column(len(carry)).to_pylist()]
                found = [(t, base, all_spans(base, more, t)) for t, base, more in zip(texts, map(base_spans, texts), field_spans(texts, own), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *make(found, part)], schema=pa.schema(_arrow(schema, part, carry)))

    return documents.select(*carry, text_col).mapInArrow(run, schema)


def _arrow(schema: T.StructType, part, carry: list[str]):
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    return [part.schema.field(f.name) if f.name in carry else pa.field(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields]


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every whole text.

    Offsets are code points, ends exclusive. Counts and the digest are of the checked patterns;
    ``spans`` adds what the field finds outside them. Null and empty texts have no spans; texts of
    any length are read whole; repeated rows and null ids are treated like any other; an empty table
    gives an empty result. Extra columns, whatever their names, are not read.
    """
    names = [f"n_{k}" for k in BASE_KINDS]
    schema = T.StructType([documents.schema[id_col], *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def make(found, part):
        counts = [pa.array([sum(s[0] == k for s in base) for _, base, _ in found], pa.int64()) for k in BASE_KINDS]
        digest = [hashlib.sha256(written(base).encode()).hexdigest() for _, base, _ in found]
        return [*counts, pa.array(digest, pa.string()), pa.array([written(spans) for _, _, spans in found], pa.string())]

    return _run(documents, [id_col], text_col, schema, make)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask_pii(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, personal data replaced in the text; a null text stays null, ``n_chars`` follows.

    Whole texts of any length are read; an empty text stays empty, repeated rows are masked each, an
    empty table gives an empty one. Other columns pass unchanged, whatever their names.
    """
    carry = [c for c in documents.columns if c not in (text_col, "n_chars")]
    masked, chars = (next(n for n in (stem + "_" * k for k in range(len(documents.columns) + 1)) if n not in documents.columns) for stem in ("masked", "chars"))
    extra = [T.StructField(masked, T.StringType()), T.StructField(chars, T.LongType())]
    schema = T.StructType([*[documents.schema[c] for c in carry], *extra])

    def make(found, part):
        nulls = part.column(len(carry)).is_null().to_pylist()
        texts = [None if null else mask(t, spans) if spans else t for null, (t, _, spans) in zip(nulls, found, strict=True)]
        return [pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())]

    done = _run(documents, carry, text_col, schema, make).withColumnRenamed(masked, text_col)
    if "n_chars" in documents.columns:
        done = done.withColumn("n_chars", F.col(chars).cast(documents.schema["n_chars"].dataType))
    return done.select(*documents.columns)
