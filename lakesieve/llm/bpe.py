"""Byte-level BPE vocabularies: merge ranks, pre-tokens and a bounded cache of pre-token results.

Texts without rare characters are cut by the same pattern with listed classes, which is several times faster.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

#: Fixed value: the public pattern that byte_bpe_50k.json's pre-tokeniser applies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WHITE = "\t-\r \x85\xa0"
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: The same pattern for characters below U+0250, where the classes can be listed.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WHITE}{_LETTER}{_NUMBER}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_FULL = regex.compile(PATTERN)
#: Characters for which the listed classes don't hold.
RARE = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def byte_chars() -> dict[str, int]:
    """The characters that stand for the 256 bytes in the vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """ids, bytes and merges of a byte-level BPE file (the tokenizers library's JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.bytes_of[i] = raw(token)
        self.plain = sorted(i for t, i in model["vocab"].items() if t not in self.special)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for i in self.plain:
            if len(self.bytes_of[i]) == 1:
                self.byte_id[self.bytes_of[i][0]] = i
        #: left * 2**20 + right -> rank * 2**20 + merged
        self.merges: dict[int, int] = {}
        #: merged -> (left, right, rank)
        self.parts: dict[int, tuple[int, int, int]] = {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, merged = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault(left << 20 | right, rank << 20 | merged)
            self.parts.setdefault(merged, (left, right, rank))
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's parts and whether each is a special token's string, which the library takes as that token."""
        if self.splitter is None or not any(s in text for s in self.special):
            if text:
                yield text, False
            return
        for k, part in enumerate(self.splitter.split(text)):
            if part:
                yield part, bool(k % 2)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(text: str) -> list[str]:
    return _FULL.findall(text) if RARE.search(text) else _LATIN.findall(text)


class Words(dict):
    """Pre-token -> value by ``one``, in two generations: when the younger is full it becomes the older, and words that are met again return to the younger.  Memory is bounded and frequent words stay."""

    def __init__(self, one: Callable[[str], object], most: int = 250_000):
        super().__init__()
        self.one, self.most, self.older = one, most, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.one(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value

    def of(self, text: str) -> Iterator:
        """The values of a text's pre-tokens."""
        return map(self.__getitem__, pre_tokens(text))
