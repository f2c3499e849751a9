"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes form a linked list; a heap holds each adjacent pair that has a merge, by rank and then place.
The lowest is popped again and again, the pair becomes one symbol and its two neighbours' pairs are pushed.  The
count is the number of initial symbols minus the number of merges; no ids are emitted.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame

from .bpe import Vocabulary, Words, vocabulary
from .common import map_rows, project


def count_merged(word: bytes, vocab: Vocabulary) -> int:
    """Symbols that are left of ``word`` when no adjacent pair has a merge."""
    n = len(word)
    if n < 2:
        return n
    merges, ids = vocab.merges, vocab.byte_id
    symbol = [ids[b] for b in word]
    heap = []
    for i in range(n - 1):
        if (found := merges.get(symbol[i] << 20 | symbol[i + 1])) is not None:
            heap.append((found >> 20, i, found & 0xFFFFF, symbol[i], symbol[i + 1]))
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    pop, push, get = heapq.heappop, heapq.heappush, merges.get
    while heap:
        _, i, new, left, right = pop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:  # one of the two has been merged meanwhile
            continue
        merged += 1
        symbol[i], symbol[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := get(new << 20 | symbol[k])) is not None:
                push(heap, (found >> 20, i, found & 0xFFFFF, new, symbol[k]))
        if (h := before[i]) >= 0 and (found := get(symbol[h] << 20 | new)) is not None:
            push(heap, (found >> 20, h, found & 0xFFFFF, symbol[h], new))
    return n - merged


def counter(path: str):
    """A function from text to its number of tokens."""
    vocab = vocabulary(path)
    words = Words(lambda word: count_merged(word.encode(), vocab))

    def count(text: str) -> int:
        return sum(1 if special else sum(words.of(part)) for part, special in vocab.segments(text))

    return count


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty (0 bytes, 0 tokens); null or repeated ids are carried as they are; other columns
    are ignored; an empty table gives an empty result.  Narrow: no shuffle, one pass.  ``path`` must be readable by
    the executors.  Memory is bounded by the vocabulary, the cache and the longest text.
    """

    def make():
        count = counter(path)

        def row(doc_id, text):
            text = text or ""
            n = count(text)
            yield doc_id, len(text.encode()), n, n > limit

        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(project(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
