"""Token ids of the public lower-casing word tokenizer, looked up word by word.

The tokenizer never joins characters across white space, so a text's ids are those of its words. A
word is encoded once per process while it stays in a bounded table.
"""

from __future__ import annotations

import os
import re
from array import array

DEFAULT = "word_bpe_49k.json"
_SEPARATOR = re.compile(r"[ \t\n\r\f\v]+")
#: White space to Python that may be none to the tokenizer, or the other way round.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")
#: Marks that the tokenizer takes together, apart from letters; an apostrophe isn't one, as it joins some endings.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words and parts kept in each of two generations.
MOST_WORDS, MOST_PARTS = 300_000, 120_000


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokens(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes; a miss encodes the word.

    A word of Latin-1 letters with marks after it is cut between them, where the tokenizer cuts, so
    that few parts need encoding; a part goes to the tokenizer's model, its bytes written in the
    model's alphabet. Any other word is encoded whole. When a generation is full it becomes the old
    one, from which words still in use move over.
    """

    def __init__(self, path: str | None = None) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.model = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256) if chr(c).isprintable() and not chr(c).isspace()}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            letters = word.rstrip(_MARKS)
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
                ids = self._part(letters.lower())
                if len(letters) < len(word):
                    ids += self._part(word[len(letters) :])
            else:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) < 100:
            self[word] = ids
        return ids

    def encode_words(self, words: list[str]) -> tuple[array, list[int]]:
        """Ids of words that the caller keeps, end to end, and how many each has; only what isn't letters is kept here."""
        flat, lengths = array("I"), []
        for word in words:
            at = len(flat)
            letters = word.rstrip(_MARKS)
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
                lower = letters.lower()
                flat.extend([t.id for t in self.model(lower if lower.isascii() else lower.translate(self.alphabet))])
                if len(letters) < len(word):
                    flat.frombytes(self._part(word[len(letters) :]))
            else:
                flat.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
            lengths.append(len(flat) - at)
        return flat, lengths

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                ids = array("I", [t.id for t in self.model(part if part.isascii() else part.translate(self.alphabet))]).tobytes()
            if len(self.parts) >= MOST_PARTS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = _SEPARATOR.split(text) if _ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))
