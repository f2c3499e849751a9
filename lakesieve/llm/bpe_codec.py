"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

Every prefix of a pre-token has exactly one last token: among the vocabulary's tokens that end there, the one that
is compatible with the last token of the prefix before it.  The tokens that end at a place come from a suffix
automaton of the vocabulary; compatibility of two tokens is read off the merge order.  Back-pointers from the whole
pre-token give the ids.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import Vocabulary, Words, pre_tokens, vocabulary
from .common import map_rows, project


class SuffixAutomaton:
    """Of all tokens at once: states by their longest string's length, suffix links, and the token, if any, that a state's longest string is."""

    def __init__(self, strings: list[tuple[bytes, int]]):
        self.length, self.link, self.token = [0], [-1], [-1]
        moves: list[dict[int, int]] = [{}]
        for text, token in strings:
            last = 0
            for byte in text:
                last = self._extend(moves, last, byte)
            self.token[last] = token
        # the tokens, as (length, token) by falling length, on the way of suffix links above each state, and from it on
        order = sorted(range(1, len(moves)), key=self.length.__getitem__)
        self.above: list[tuple] = [()] * len(moves)
        self.ending: list[tuple] = [()] * len(moves)
        for s in order:
            self.above[s] = self.ending[self.link[s]]
            self.ending[s] = ((self.length[s], self.token[s]), *self.above[s]) if self.token[s] >= 0 else self.above[s]
        self.moves = moves

    def _new(self, moves: list, length: int, move: dict) -> int:
        moves.append(move)
        self.length.append(length)
        self.link.append(0)
        self.token.append(-1)
        return len(moves) - 1

    def _split(self, moves: list, p: int, byte: int, q: int) -> int:
        clone = self._new(moves, self.length[p] + 1, dict(moves[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and moves[p].get(byte) == q:
            moves[p][byte] = clone
            p = self.link[p]
        return clone

    def _extend(self, moves: list, p: int, byte: int) -> int:
        q = moves[p].get(byte)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(moves, p, byte, q)
        new = self._new(moves, self.length[p] + 1, {})
        while p >= 0 and byte not in moves[p]:
            moves[p][byte] = new
            p = self.link[p]
        if p >= 0:
            q = moves[p][byte]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(moves, p, byte, q)
        return new


class Encoder:
    #: Token pairs whose compatibility is remembered.
    PAIRS = 300_000

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.automaton = SuffixAutomaton([(vocab.bytes_of[i], i) for i in vocab.plain])
        self.sizes = [len(b) for b in vocab.bytes_of]
        #: by the first token: second token -> compatible
        self.known: list[dict[int, bool]] = [{} for _ in range(vocab.size)]
        self.pairs = 0

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends in exactly these two tokens; remembered.

        Undo merges from the last to the first; whenever the tokens on both sides of the border stand side by side,
        a merge of the two of a lower rank than the merge that ends this state would have come before it.
        """
        merges, parts = self.vocab.merges, self.vocab.parts
        until, x, y = 1 << 40, a, b
        while True:
            found = merges.get(x << 20 | y)
            if found is not None and found >> 20 < until:
                ok = False
                break
            px, py = parts.get(x), parts.get(y)
            if px is None and py is None:
                ok = True
                break
            if py is None or px is not None and px[2] > py[2]:
                until, x = px[2], px[1]
            else:  # on equal ranks the left one is merged first, so undo the right one; it loses a tie to the border
                until, y = py[2] + 1, py[0]
        if self.pairs >= self.PAIRS:
            self.pairs = 0
            for found in self.known:
                found.clear()
        self.pairs += 1
        self.known[a][b] = ok
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        auto, sizes, known, test = self.automaton, self.sizes, self.known, self.compatible
        moves, length, link, ending, above = auto.moves, auto.length, auto.link, auto.ending, auto.above
        last = [-1]
        state = matched = i = 0
        for byte in word:
            while (to := moves[state].get(byte)) is None:
                state = link[state]
                matched = length[state]
            state = to
            matched += 1
            i += 1
            for n, t in ending[state] if matched == length[state] else above[state]:
                if n == i:
                    break
                before = last[i - n]
                ok = known[before].get(t)
                if test(before, t) if ok is None else ok:
                    break
            last.append(t)
        ids = []
        while i:
            ids.append(t := last[i])
            i -= sizes[t]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """A text without special tokens' strings, without any cache."""
        return [i for word in pre_tokens(text) for i in self.encode_word(word.encode())]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Once a Python worker, not once a task."""
    return Encoder(vocabulary(path))


def codec(path: str):
    """(encode, decode): from text to its ids as decimal strings, and back from these to text."""
    enc = encoder(path)
    vocab = enc.vocab
    name = [str(i) for i in range(vocab.size)]
    words = Words(lambda word: ",".join(map(name.__getitem__, enc.encode_word(word.encode()))))
    bytes_of = dict(zip(name, vocab.bytes_of, strict=True))

    def encode(text: str) -> str:
        """Ids joined by commas."""
        parts = [str(vocab.special[part]) if special else ",".join(words.of(part)) for part, special in vocab.segments(text)]
        return ",".join(parts)

    def decode(ids: str) -> str:
        return b"".join(map(bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    return encode, decode


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every row's whole text; a null text gives no ids.  Narrow."""

    def make():
        encode, _ = codec(path)

        def row(doc_id, text):
            ids = encode(text or "")
            yield doc_id, list(map(int, ids.split(","))) if ids else []

        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(project(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row's ids (null: none).  Narrow."""

    def make():
        _, decode = codec(path)

        def row(doc_id, ids):
            yield doc_id, decode(",".join(map(str, ids or [])))

        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(project(df, doc_id=id_col, ids=ids_col), make, f"doc_id {kind}, text string")


def codec_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from these ids).

    Null and empty texts have no ids: both digests are those of the empty string.  Null or repeated ids are carried
    as they are, other columns are ignored.  Narrow: no shuffle; memory is bounded by the vocabulary's automaton,
    the caches and the longest text.
    """

    def make():
        encode, decode = codec(path)

        def row(doc_id, text):
            ids = encode(text or "")
            yield doc_id, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decode(ids).encode()).hexdigest()

        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(project(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
