"""Packing token pieces into sequences by linear grouping, few-size configurations and best fit.

A document's ids end with one end id; only documents over the capacity are cut.  Pieces are dealt by a hash of
their place in the table to shards of about SHARD pieces, and each shard is packed on its own:

1. full pieces are sequences by themselves;
2. large pieces, by falling length, form groups of equal cardinality, and each counts as long as its group's longest;
3. with so few sizes, the linear programme over all configurations (multisets of sizes that fit) is solved by column
   generation: a knapsack over the sizes' prices finds the configuration that improves the solution most, until none
   does, or PIVOTS have been tried, which is told in a warning (the packing is valid then too, only less tight).  Each configuration is taken the whole number of times in the optimum; what the fractions leave, fewer pieces
   than a configuration for each size, goes by the largest size left and the fullest configuration with it;
4. actual pieces replace the sizes, which leaves more room;
5. small pieces, by falling length, go where the room left is least.

A shard costs at most one partly filled sequence, so the loss to sharding is about one sequence in SHARD pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import warnings
import zlib
from array import array
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _WHITE, RARE
from .common import checkpoint, map_parts, project

CAPACITY = 4096
#: Pieces of a shard, about.
SHARD = 16_384
#: Large pieces are longer than capacity / LARGE, so a configuration has fewer than LARGE of them.
LARGE = 5
#: Numbers of groups of equal cardinality that are tried in turn, few that leave room for small pieces and many that round
#: large ones up by little, until a packing has at most this share of sequences more than the tokens need.
GROUPS, CLOSE = (12, 96), 0.001
#: Improvements of the linear programme at most; what it has by then is as feasible.
PIVOTS = 3000
#: A configuration that leaves so few tokens is not improved on.
SLACK = 4


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0, 1, 2, 3 for each of the first 65,536 characters: white space, letter, number, other."""
    every, kinds = "".join(map(chr, range(1 << 16))), np.full(1 << 16, 3, dtype=np.uint8)
    for k, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        kinds[[m.start() for m in regex.finditer(pattern, every)]] = k
    return kinds


class WordIds:
    """A lower-casing word BPE's ids as little-endian bytes, through the tokenizers library.

    Its words never reach over white space and are encoded each by itself, so a text's ids are those of its words.
    The texts of a call are cut side by side, in blocks that end at white space: a cut is where the kind of character
    changes.  Each of a block's different words is looked up once.  Words that are new go through the library in lots
    and are remembered in two generations, up to a bound; each word ends with the one id that has the end-of-word mark.
    Texts with rare characters (for which lower case may depend on the neighbours) or with special tokens' strings go
    there whole.
    """

    #: Words of a generation.
    MOST = 250_000
    #: Characters of a block, about.
    BLOCK = 1 << 21
    WHITE = re.compile(f"[{_WHITE}]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        lots = [" ".join(words[k : k + 512]) for k in range(0, len(words), 512)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(lots, add_special_tokens=False) for i in e.ids], dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):  # not one mark a word: ask for each
            return {w: self._ids(w) for w in words}
        raw, starts = ids.tobytes(), [0, *(stops[:-1] * 4).tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, starts, (stops * 4).tolist(), strict=True)}

    def _look(self, words: list[str]) -> list[bytes]:
        """The ids of different words; none for white space."""
        out = list(map(self.known.get, words))
        new = [w for w, x in zip(words, out, strict=True) if x is None]
        found = {w: self.older.get(w, b"") for w in new}
        fresh = [w for w, x in found.items() if not x and not w.isspace()]
        if fresh:
            found |= self._learn(fresh)
        if len(self.known) + len(found) > self.MOST and self.known:
            self.older, self.known = self.known, {}
        self.known.update((w, x) for w, x in found.items() if len(w) <= 64)
        rest = iter(found.values())
        return [next(rest) if x is None else x for x in out]

    @staticmethod
    def _cuts(codes: np.ndarray) -> np.ndarray:
        """Where words and white space begin, by the public pattern of word_bpe_49k.json:

        's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
        """
        kinds = _kinds()[codes]
        cut = np.r_[True, kinds[1:] != kinds[:-1]] | (kinds == 2)
        quotes = np.flatnonzero((codes == ord("'")) & cut)  # a quote within a run of others begins nothing
        after = np.append(codes, np.zeros(2, codes.dtype))
        one, two = after[quotes + 1], after[quotes + 2]
        short = np.isin(one, list(b"stmd"))
        long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[quotes[short | long] + 1] = False
        ends = np.r_[quotes[short] + 2, quotes[long] + 3]
        cut[ends[ends < len(cut)]] = True
        return np.flatnonzero(cut)

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The ids of lower-case texts without rare characters."""
        text, begins = "\n".join(texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
        parts, edges, at, total = [], np.zeros(len(begins), dtype=np.int64), 0, 0
        while at < len(text):
            stop = found.start() if (found := self.WHITE.search(text, at + self.BLOCK)) else len(text)
            block = text[at:stop]
            codes = np.frombuffer(block.encode("latin-1") if block.isascii() else block.encode("utf-16-le"), dtype="u1" if block.isascii() else "<u2")
            starts = self._cuts(codes)
            places = np.r_[starts, len(codes)]
            if not block.isascii():  # bytes of UTF-8 before each character
                places += np.r_[0, np.cumsum((codes >= 1 << 7).view("u1") + (codes >= 1 << 11).view("u1"), dtype=np.int32)][places]
            buffers = [None, pa.py_buffer(places), pa.py_buffer(block.encode())]
            words = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
            ids = self._look(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            size, place = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4, words.indices.to_numpy()
            n, first = size[place], (np.cumsum(size) - size)[place]
            ends = np.r_[0, np.cumsum(n)]
            parts.append(np.frombuffer(b"".join(ids), dtype="<u4")[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])].tobytes())
            here = slice(*np.searchsorted(begins, (at, stop)))
            edges[here] = total + ends[np.searchsorted(starts, begins[here] - at)]
            at, total = stop, total + int(ends[-1])
        edges[np.searchsorted(begins, at) :] = total
        flat, edges = b"".join(parts), (edges * 4).tolist()
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        whole = [bool(RARE.search(t)) or any(s in t for s in self.special) for t in texts]
        cut = iter(self._cut([t.lower() for t, w in zip(texts, whole, strict=True) if not w]))
        return [self._ids(t) if w else next(cut) for t, w in zip(texts, whole, strict=True)]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """Once a Python worker, not once a task; the executors' cores are busy with other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def token_pieces(df: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces.  Narrow."""

    def make():
        ids_of, end = word_ids(path), array("I", [end_id]).tobytes()

        def rows(doc_ids, texts):
            for doc_id, own in zip(doc_ids, ids_of.many([t or "" for t in texts]), strict=True):
                ids = own + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    more = (array("I", part).tolist(),) if with_ids else ()
                    yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *more

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    more = ", ids array<long>" if with_ids else ""
    return map_parts(project(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def best_configuration(sizes: list[int], left: list[int], room: int) -> tuple[int, ...]:
    """Indices (rising) of the sizes, with repetition within ``left``, whose sum is the largest that ``room`` holds, or at most SLACK from full."""
    best, found = 0, ()
    usable = [i for i, n in enumerate(left) if n and sizes[i] <= room]

    def search(first: int, room_left: int, chosen: tuple[int, ...]) -> bool:
        nonlocal best, found
        used = room - room_left
        if used > best:
            best, found = used, chosen
            if best >= room - SLACK:
                return True
        for k in range(first, len(usable)):
            i = usable[k]
            if sizes[i] <= room_left and chosen.count(i) < left[i] and search(k, room_left - sizes[i], (*chosen, i)):
                return True
        return False

    search(0, room, ())
    return found


def optimal_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """(pieces of each size, how often): the configurations of a least fractional packing of ``demand`` pieces of the sizes, which are over capacity / LARGE."""
    m, most = len(sizes), LARGE - 1
    size, need = np.array(sizes), np.array(demand, dtype=np.float64)
    basis = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / (capacity // n) for n in sizes])
    often = inverse @ need
    for _ in range(PIVOTS):
        price = inverse.sum(0)
        # the dearest configuration, by the number of its pieces and the room it takes
        value, choice = np.zeros(capacity + 1), []
        for _ in range(most):
            best, pick = value.copy(), np.full(capacity + 1, -1, dtype=np.int32)
            for i in np.flatnonzero(price > 1e-12).tolist():
                offer = value[: capacity + 1 - size[i]] + price[i]
                better = offer > best[size[i] :] + 1e-12
                best[size[i] :][better] = offer[better]
                pick[size[i] :][better] = i
            choice.append(pick)
            value = best
        if value[capacity] <= 1 + 1e-7:
            break
        enter, room = np.zeros(m), capacity
        for pick in reversed(choice):
            if (i := int(pick[room])) >= 0:
                enter[i] += 1
                room -= sizes[i]
        move = inverse @ enter
        up = np.flatnonzero(move > 1e-9)
        leave = up[np.argmin(often[up] / move[up])]
        row = inverse[leave] / move[leave]
        inverse -= np.outer(move, row)
        inverse[leave] = row
        basis[leave], often = enter, inverse @ need
    else:
        warnings.warn(f"the linear programme over {m} sizes stopped after {PIVOTS} pivots", RuntimeWarning, stacklevel=2)
    return [(c.astype(np.int64), float(x)) for c, x in zip(basis, often, strict=True) if x > 0]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> np.ndarray:
    """The sequence (0, 1, ...) of each piece; no sequence holds more than ``capacity``.  The best of the packings with so many groups."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if lengths.size and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("lengths must be between 1 and the capacity")
    best, found = None, 0
    for n in groups:
        where = pack_grouped(lengths, capacity, n)
        used = int(where.max(initial=-1)) + 1
        if best is None or used < found:
            best, found = where, used
        if found <= -(-int(lengths.sum()) // capacity) * (1 + CLOSE):
            break
    return best


def pack_grouped(lengths: np.ndarray, capacity: int, groups: int) -> np.ndarray:
    """``pack`` with one number of groups."""
    where = np.full(lengths.size, -1, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = order[lengths[order] == capacity]
    where[full] = np.arange(full.size)
    room: list[int] = [0] * full.size
    large = [int(i) for i in order if capacity // LARGE < lengths[i] < capacity]
    small = [int(i) for i in order if lengths[i] <= capacity // LARGE]
    # linear grouping: equal cardinality, rounded up to the group's longest
    per = max(1, -(-len(large) // groups))
    members = [large[k : k + per] for k in range(0, len(large), per)]
    sizes, left, taken = [int(lengths[m[0]]) for m in members], [len(m) for m in members], [0] * len(members)

    def use(configuration: dict[int, int], times: int) -> None:
        for _ in range(times):
            free = capacity
            for i, n in configuration.items():
                for item in members[i][taken[i] : taken[i] + n]:
                    where[item] = len(room)
                    free -= int(lengths[item])
                taken[i] += n
            room.append(free)
        for i, n in configuration.items():
            left[i] -= n * times

    for counts, often in optimal_configurations(sizes, left, capacity) if members else []:
        whole = {int(i): int(counts[i]) for i in np.flatnonzero(counts)}
        use(whole, min(int(often + 1e-6), *(left[i] // n for i, n in whole.items())))
    for top in range(len(members)):
        while left[top]:
            left[top] -= 1
            others = best_configuration(sizes, left, capacity - sizes[top])
            left[top] += 1
            configuration = Counter((top, *others))
            use(configuration, min(left[i] // n for i, n in configuration.items()))
    # best fit of the small ones
    by_room: dict[int, list[int]] = defaultdict(list)
    for sequence, free in enumerate(room):
        if free:
            by_room[free].append(sequence)
    rooms = sorted(by_room)
    for item in small:
        length = int(lengths[item])
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            sequence, free = len(room), capacity
            room.append(capacity)
        else:
            free = rooms[at]
            sequence = by_room[free].pop()
            if not by_room[free]:
                del rooms[at], by_room[free]
        where[item] = sequence
        free -= length
        if free:
            if free not in by_room:
                bisect.insort(rooms, free)
            by_room[free].append(sequence)
    return where


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset added; offsets are gapless from 0.

    Counts the pieces once to choose the number of shards.  A shard holds about ``shard`` rows whatever rows repeat, as
    they are dealt by their places, which a checkpointed or written table keeps.
    """
    n = max(1, -(-pieces.count() // shard))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", sequence_id long, offset long"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_shard").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(dtype=np.int64)
        where = pack(lengths, capacity)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.r_[True, where[order][1:] != where[order][:-1]] if len(order) else np.array([], dtype=bool)
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        return rows.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    salted = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    return salted.groupBy("_shard").applyInPandas(one, schema)


def pack_documents(df: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id.  Repeated rows (also of one doc_id) are packed each; null ids
    are carried; other columns are ignored; an empty table gives no rows.  The texts are tokenised once, as the small
    piece table is checkpointed before it is counted and dealt; no text is shuffled.
    """
    return pack_pieces(checkpoint(token_pieces(df, path, end_id, capacity, id_col, text_col)), capacity)


def packed_sequences(df: DataFrame, path: str, **options) -> DataFrame:
    """sequence_id, ids: the sequences themselves.  A sequence's pieces meet by its id, at most ``capacity`` ids each."""
    packed = pack_pieces(checkpoint(token_pieces(df, path, with_ids=True, **options)))
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
