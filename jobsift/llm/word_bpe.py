"""A BPE vocabulary file with word-end symbols, as plain Python used inside tasks.

The text is cut at ASCII white space into *units*: no normalisation, pattern or merge of
such a vocabulary reaches across it, so a unit's tokens depend on the unit alone. Units
repeat, which is what the bounded caches of the operators live on.

A word is written with one character a symbol: bytes in the byte-level alphabet, the last
one moved to a private range, standing for the byte with the word-end suffix.
"""

from __future__ import annotations

import json
import re
import unicodedata

from tokenizers import Tokenizer

FINAL = 0xE000
SUFFIX = "</w>"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


# Bytes at a unit's end that are cut off: a run of them after a letter or digit is a word of
# its own. "<", "|" and ">" are left, since added tokens are written with them.
_TAIL = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


ALPHABET = byte_alphabet()


def spelled(text: str) -> str:
    """The text's UTF-8 bytes in the byte-level alphabet."""
    return text if text.isascii() and text.isalnum() else text.encode("utf-8").decode("latin-1").translate(ALPHABET)


def latin_word(text: str) -> bool:
    """Whether the text is letters only, of blocks in which every rule here is beyond doubt.

    Below U+0250 lower-casing is one letter to one but for U+0130, letters are those that
    Unicode has long assigned, and composition can be tested.
    """
    return text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text))


def simpler(unit: bytes) -> tuple[bytes, ...]:
    """Units that together have the same words as ``unit`` and are met more often."""
    core = unit.rstrip(_TAIL)
    if core and len(core) < len(unit) and core[-1] < 128 and core[-1:].isalnum():
        return core, unit[len(core) :]
    if unit.isascii() and b"<" not in unit:
        lower = unit.lower()
        if lower != unit:
            return (lower,)
    return (unit,)


class Remembered(dict):
    """``compute(key)`` for the keys met most recently, in two generations of ``size``.

    When the young generation is full it becomes the old one; a key found there is taken
    over. So frequent keys stay, and memory is bounded by twice ``size`` entries.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size = size
        self.old: dict = {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """Vocabulary, merge ranks and the text -> words step of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.library = Tokenizer.from_file(path)
        self.ids = {self.symbols(token): i for token, i in spec["model"]["vocab"].items()}
        self.names = {i: token for token, i in spec["model"]["vocab"].items()}
        self.added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.names |= {i: content for content, i in self.added.items()}
        self.ranks: dict[str, dict[str, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault(self.symbols(left), {})[self.symbols(right)] = rank
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @staticmethod
    def symbols(token: str) -> str:
        """One character a symbol."""
        if token.endswith(SUFFIX) and token != SUFFIX:
            token = token[: -len(SUFFIX)]
            return token[:-1] + chr(FINAL + ord(token[-1]))
        return token

    @staticmethod
    def latin(unit: str) -> str | None:
        """The only word of a unit that is a Latin word, in symbols."""
        if not latin_word(unit):
            return None
        word = spelled(unit.lower())
        return word[:-1] + chr(FINAL + ord(word[-1]))

    def words(self, unit: str) -> list[str]:
        """The words of a piece of text without added tokens, in symbols."""
        if unit.isascii():
            found = _ASCII.findall(unit.lower())
            if not unit.isprintable():
                found = [x for x, _ in self._library_words(unit)]
        else:
            found = [x for x, _ in self._library_words(unit)]
        return [x[:-1] + chr(FINAL + ord(x[-1])) for x in found]

    def _library_words(self, unit: str) -> list:
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))

    def parts(self, unit: str) -> list[tuple[str, bool]]:
        """The unit cut at added tokens; True marks one of them."""
        if self.special is None or "<" not in unit:
            return [(unit, False)]
        return [(x, x in self.added) for x in self.special.split(unit) if x]

    def merge(self, word: str) -> list[str]:
        """The tokens of one word or fragment: repeatedly the pair of least rank."""
        parts, ranks, none = list(word), self.ranks, {}
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i], none).get(parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary of ``path``, read once a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
