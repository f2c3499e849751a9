"""How far the sources of each language lie apart, by mergeable radix tries of their terms.

A trie is held flattened: its leaves in the order of their bytes, which is the trie's own traversal, each with the number
of bytes of its path that it shares with the leaf before it, the bytes that follow, the number of documents, and a counter
for each source that has the term.  Tries of one language merge leaf by leaf, and are cut at any path.

1. Each task counts its documents' terms in tries, and puts them out in pieces of consecutive leaves (narrow).
2. Paths that part the pieces' leaves into even ranges are chosen by a bounded sample of leaves; pieces that reach
   over such a path are cut there, and the pieces of a range meet and merge as they stream in.  A frequent term costs
   its range one leaf for each task, however often it occurs.
3. Of the merged leaves those in enough documents stay, again in pieces; a row a source sums them up.
4. Each task goes over its pieces in order and sums up what the pairs of sources differ by, and keeps the first terms of
   each source; both are merged by group.

A task holds a bounded number of leaves, the leaves of one range, or the sums of one block of sources by another.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import project, written

#: Bytes of text that are counted at a time.
TEXT_BYTES = 4 << 20
#: Leaves that a counting task holds, and leaves of a piece.
LEAVES, PIECE = 1 << 19, 4096
#: Marks of a full piece: leaves that stand for those around them where paths are chosen.
MARKS = 8
#: Bytes of pieces that a range holds, about; ranges at most; marks of the sample for each of them.
RANGE_BYTES, RANGES, DRAWN = 4 << 20, 50_000, 20
#: Sources of a block, whose sums with another block a task holds.
SOURCES = 1024
#: Groups of language and source at most: their pairs alone are a table of the square of their number.
GROUPS = 1_000_000
#: Scale of the shares, documents that a kept term is in, and terms that are told of a group.
SCALE, LEAST_DOCS, TOLD = 1_000_000_000, 3, 200
#: What a byte becomes: letters A to Z small, other characters than letters and those beyond ASCII a space.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` in an order, in whole numbers."""
    return np.add.reduceat(values[order], first) if len(first) else np.empty(0, dtype=np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where runs of equal keys begin in it, their keys)."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    return order, first, sorted_key[first]


class Tries:
    """The leaves of one trie for each language: ``lang`` (a code), ``term``, ``docs``, and counters (``leaf``, ``source``, ``count``), all in the order of language, bytes and source."""

    def __init__(self, lang, term, docs, leaf, source, count):
        self.lang, self.term, self.docs, self.leaf, self.source, self.count = lang, term, docs, leaf, source, count

    def __len__(self) -> int:
        return len(self.lang)

    @staticmethod
    def merged(parts: list[Tries]) -> Tries:
        """One trie a language of several, their leaves and counters added up."""
        if len(parts) == 1:
            return parts[0]
        base = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        both = pa.chunked_array([p.term for p in parts]).combine_chunks().dictionary_encode()
        return Tries.of(
            np.concatenate([p.lang for p in parts]), both, np.concatenate([p.docs for p in parts]),
            np.concatenate([p.leaf + b for p, b in zip(parts, base.tolist(), strict=True)]), np.concatenate([p.source for p in parts]), np.concatenate([p.count for p in parts]),
        )

    @staticmethod
    def of(lang: np.ndarray, term: pa.DictionaryArray, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> Tries:
        """From leaves and counters in any order, with repeats."""
        order = pc.array_sort_indices(term.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        n = max(len(order), 1)
        at, first, key = _runs(lang.astype(np.int64) * n + rank[term.indices.to_numpy(zero_copy_only=False)])
        place = np.empty(len(lang), dtype=np.int64)
        place[at] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))
        wide = int(source.max(initial=0)) + 1
        by, begin, counter = _runs(place[leaf] * wide + source)
        terms = term.dictionary.take(pa.array(order[key % n]))
        return Tries(key // n, terms, _sums(docs, at, first), counter // wide, counter % wide, _sums(count, by, begin))

    def part(self, start: int, stop: int) -> Tries:
        a, b = np.searchsorted(self.leaf, (start, stop))
        return Tries(self.lang[start:stop], self.term[start:stop], self.docs[start:stop], self.leaf[a:b] - start, self.source[a:b], self.count[a:b])

    def where(self, chosen: np.ndarray) -> Tries:
        to, kept = np.cumsum(chosen) - 1, chosen[self.leaf]
        return Tries(self.lang[chosen], self.term.filter(pa.array(chosen)), self.docs[chosen], to[self.leaf[kept]], self.source[kept], self.count[kept])


def flattened(trie: Tries, names: list[str]) -> tuple[list[str], bytes]:
    """The sources that occur, and one language's leaves as bytes: numbers of leaves and counters, and of each leaf the bytes shared with the one before (255 at most), those that follow, documents and counters."""
    term = trie.term
    ends = np.frombuffer(term.buffers()[1], dtype=np.int32)[term.offset : term.offset + len(term) + 1].astype(np.int64)
    data = np.frombuffer(term.buffers()[2], dtype=np.uint8) if term.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    size = np.diff(ends)
    shared, alive = np.zeros(len(trie), dtype=np.uint8), np.arange(1, len(trie))
    for k in range(255):
        alive = alive[np.minimum(size[alive], size[alive - 1]) > k]
        alive = alive[data[ends[alive] + k] == data[ends[alive - 1] + k]]
        if not len(alive):
            break
        shared[alive] += 1
    tail = size - shared
    inside = np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail)
    tails = data[np.repeat(ends[:-1] + shared, tail) + inside]
    used, code = np.unique(trie.source, return_inverse=True)
    numbers = [trie.docs, np.bincount(trie.leaf, minlength=len(trie)), code, trie.count, tail]
    blob = np.array([len(trie), len(code)], dtype="<i8").tobytes() + shared.tobytes() + b"".join(x.astype("<i8" if k in (0, 3) else "<u4").tobytes() for k, x in enumerate(numbers)) + tails.tobytes()
    return [names[k] for k in used.tolist()], blob


def unflattened(blob: bytes, lang: int, codes: np.ndarray) -> Tries:
    """What ``flattened`` got, its sources under the given codes."""
    n, m = np.frombuffer(blob, dtype="<i8", count=2).tolist()
    at = 16

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=k, offset=at)
        at += out.nbytes
        return out

    shared, docs, width, code, count, tail = take("u1", n), take("<i8", n), take("<u4", n), take("<u4", m), take("<i8", m), take("<u4", n)
    term, before, start = [], b"", at
    for k, more in zip(shared.tolist(), tail.tolist(), strict=True):
        before = before[:k] + blob[start : start + more]
        start += more
        term.append(before)
    return Tries(np.full(n, lang, dtype=np.int64), pa.array(term, pa.binary()), docs.astype(np.int64), np.repeat(np.arange(n), width), codes[code], count.astype(np.int64))


def _rows(batches: Iterator[pa.RecordBatch], most: int = 16) -> Iterator[tuple]:
    """Rows of large values, few in memory at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, most):
            yield from zip(*[c.to_pylist() for c in whole.slice(start, most).columns], strict=True)


class _Codes(dict):
    """name -> code, given out as names come."""

    def __missing__(self, name: str) -> int:
        self[name] = len(self)
        return self[name]

    def of(self, names: list[str]) -> np.ndarray:
        return np.array([self[x] for x in names], dtype=np.int64)


def counted(text: pa.Array, lang: np.ndarray, source: np.ndarray) -> Tries:
    """The tries of some documents; languages and sources are codes."""
    n = len(text)
    ends = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + n + 1]
    raw = memoryview(text.buffers()[2])[ends[0] : ends[-1]].tobytes().translate(_TERM) if ends[-1] > ends[0] else b""
    plain = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(raw)])
    words = pc.ascii_split_whitespace(plain)
    doc = np.repeat(np.arange(n), words.value_lengths().to_numpy(zero_copy_only=False))
    term = words.flatten().cast(pa.binary()).dictionary_encode()
    code = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(term.dictionary, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:
        doc, code = doc[code != empty], code[code != empty]
    size = max(len(term.dictionary), 1)
    # terms of each document, and of these the counters of each language and source
    _, first, key = _runs(doc * size + code)
    times = np.diff(np.r_[first, len(doc)])
    doc, code = key // size, key % size
    leaf_at, leaf_first, leaf_key = _runs(lang[doc] * size + code)
    leaf = np.empty(len(doc), dtype=np.int64)
    leaf[leaf_at] = np.repeat(np.arange(len(leaf_first)), np.diff(np.r_[leaf_first, len(doc)]))
    docs = np.diff(np.r_[leaf_first, len(doc)])
    return Tries.of(leaf_key // size, pa.DictionaryArray.from_arrays(pa.array(leaf_key % size, pa.int32()), term.dictionary), docs, leaf, source[doc], times)


class _Growing:
    """Tries that are merged when the new ones have become as many as the old."""

    def __init__(self):
        self.parts: list[Tries] = []

    def add(self, more: Tries) -> None:
        self.parts.append(more)
        while len(self.parts) > 1 and len(self.parts[-1]) * 2 >= len(self.parts[-2]):
            self.parts[-2:] = [Tries.merged(self.parts[-2:])]

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def take(self) -> Tries:
        out, self.parts = Tries.merged(self.parts), []
        return out


def _pieces(trie: Tries, langs: list[str], sources: list[str], marked: bool = False) -> Iterator[tuple]:
    """(lang, first, sources, leaves, and if asked for marks) of consecutive leaves of one language."""
    bounds = np.flatnonzero(np.r_[True, trie.lang[1:] != trie.lang[:-1], True]) if len(trie) else np.empty(0, dtype=np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for start in range(a, b, PIECE):
            part = trie.part(start, min(start + PIECE, b))
            yield (langs[int(trie.lang[a])], part.term[0].as_py(), *flattened(part, sources), *([_marks(part)] if marked else []))


def _marks(trie: Tries) -> list[bytes]:
    """Some leaves of a piece, MARKS of a full one, evenly apart from a place that the leaves decide."""
    k = 1 + MARKS * len(trie) // PIECE
    begin = zlib.crc32(trie.term[-1].as_py()) / 2**32
    return trie.term.take(pa.array(((np.arange(k) + begin) * len(trie) / k).astype(np.int64))).to_pylist()


_PIECE = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("sources", pa.list_(pa.string())), ("leaves", pa.binary())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 16) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def term_tries(docs: DataFrame) -> DataFrame:
    """Pieces of the tries of (lang, source, text): lang, first, sources, leaves, marks (some of the leaves' terms).  Narrow."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        langs, sources, held = _Codes(), _Codes(), _Growing()
        for batch in batches:
            text = pc.fill_null(batch.column(2), "")
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(text):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
                own = batch.slice(start, stop - start)
                part = counted(text.slice(start, stop - start), langs.of(own.column(0).to_pylist()), sources.of(own.column(1).to_pylist()))
                held.add(part)
                start = stop
                if len(held) > LEAVES:
                    yield from _pieces(held.take(), list(langs), list(sources), marked=True)
        if len(held):
            yield from _pieces(held.take(), list(langs), list(sources), marked=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), _PIECE.append(pa.field("marks", pa.list_(pa.binary()))))

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, first binary, sources array<string>, leaves binary, marks array<binary>")


def _paths(pieces: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, path) at which ranges begin, but for the first; from a sample of the pieces' marks whose size is bounded by RANGES * DRAWN."""
    n, size = pieces.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0)), F.coalesce(F.sum(F.length("leaves")), F.lit(0))).first()
    ranges = min(RANGES, max(-(-size // RANGE_BYTES), 2 * pieces.sparkSession.sparkContext.defaultParallelism), 1 + n // 2)
    every = max(1, n // (ranges * DRAWN))
    marks = pieces.select("lang", F.posexplode("marks").alias("k", "mark"), F.crc32("leaves").alias("of")).where(F.pmod(F.xxhash64("lang", "k", "mark", "of"), F.lit(every)) == 0)
    drawn = sorted((r["lang"].encode(), bytes(r["mark"])) for r in marks.select("lang", "mark").limit(2 * RANGES * DRAWN).collect())
    chosen = {drawn[k * len(drawn) // ranges] for k in range(1, ranges)} if drawn else set()
    return [(lang.decode(), path) for lang, path in sorted(chosen)]


def merged_tries(pieces: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """kind, lang, source, n, first, sources, leaves: merged pieces of the leaves in ``least_docs`` documents and more (``piece``), their number by language (``terms``) and their counters' sums by source (``total``), which a row a range makes up."""
    paths = [(lang.encode(), path) for lang, path in _paths(pieces)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for lang, first, sources, leaves in _rows(batches):
                name = lang.encode()
                low = bisect.bisect_right(paths, (name, first))
                if low == len(paths) or paths[low][0] != name:  # nothing parts it
                    yield low, lang, first, sources, leaves
                    continue
                trie = unflattened(leaves, 0, np.arange(len(sources)))
                term = trie.term.to_pylist()
                start = 0
                while start < len(term):
                    stop = bisect.bisect_left(term, paths[low][1], start) if low < len(paths) and paths[low][0] == name else len(term)
                    if stop > start:
                        yield (low, lang, term[start], *flattened(trie.part(start, stop), sources)) if stop - start < len(term) else (low, lang, first, sources, leaves)
                    start, low = stop, low + 1

        yield from _batches(rows(), pa.schema([("range", pa.int32()), *_PIECE]))

    schema = "kind string, lang string, source string, n long, first binary, sources array<string>, leaves binary"
    out_schema = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), *list(_PIECE)[1:]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: _Growing, langs: _Codes, sources: _Codes) -> Iterator[tuple]:
            trie = held.take()
            trie = trie.where(trie.docs >= least_docs)
            lang_names, source_names = list(langs), list(sources)
            for lang, first, names, leaves in _pieces(trie, lang_names, source_names):
                yield "piece", lang, None, None, first, names, leaves
            for k, n in zip(*[x.tolist() for x in np.unique(trie.lang, return_counts=True)], strict=True):
                yield "terms", lang_names[k], None, n, None, None, None
            wide = max(len(source_names), 1)
            order, first, key = _runs(trie.lang[trie.leaf] * wide + trie.source)
            for k, n in zip(key.tolist(), _sums(trie.count, order, first).tolist(), strict=True):
                yield "total", lang_names[k // wide], source_names[k % wide], n, None, None, None

        def rows() -> Iterator[tuple]:
            now, held, langs, sources = None, _Growing(), _Codes(), _Codes()
            for at, lang, _, names, leaves in _rows(batches):
                if at != now and len(held):
                    yield from done(held, langs, sources)
                if at != now:
                    now, held, langs, sources = at, _Growing(), _Codes(), _Codes()
                held.add(unflattened(leaves, langs[lang], sources.of(names)))
            if len(held):
                yield from done(held, langs, sources)

        yield from _batches(rows(), out_schema)

    dealt = pieces.select(*_PIECE.names).mapInArrow(cut, "range int, lang string, first binary, sources array<string>, leaves binary")
    # pieces of several languages at a time come in the order of their paths, so equal leaves follow each other closely
    return dealt.repartition(len(paths) + 1, "range").sortWithinPartitions("range", "lang", "first").mapInArrow(merge, schema)


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    if int(np.max(count, initial=0)) >= (1 << 62) // SCALE:
        exact = SCALE * (count.astype(object) + 1) // total
        return 1 + exact.astype(np.int64)
    return 1 + SCALE * (count + 1) // total


def _scored(pieces: DataFrame, groups: dict[str, tuple[list[str], np.ndarray, int]]) -> DataFrame:
    """part, lang, source, item, value: parts of the sums of pairs, and candidates of the terms."""
    schema = "part string, lang string, source string, item string, value long"
    out_schema = pa.schema([(c, pa.string()) for c in ("part", "lang", "source", "item")] + [("value", pa.int64())])
    shared = pieces.sparkSession.sparkContext.broadcast(groups)

    class Block:
        """What one task has of the sources ``i`` to ``i + SOURCES`` of a language against those from ``j`` on."""

        def __init__(self, lang: str, i: int, j: int):
            self.lang, self.i, self.j = lang, i, j
            self.names, self.n, self.v = shared.value[lang]
            self.code = {x: k for k, x in enumerate(self.names)}
            self.rows, self.columns = (slice(k, k + SOURCES) for k in (i, j))
            self.sums = np.zeros((len(self.names[self.rows]), len(self.names[self.columns])), dtype=np.int64)
            self.told: list[list[tuple[int, bytes]]] = [[] for _ in self.names[self.rows]] if j == 0 else []
            self.mark = np.zeros(len(self.told), dtype=np.int64)

        def of(self, trie: Tries, part: slice) -> np.ndarray:
            base, own = self.n[part] + self.v, (trie.source >= part.start) & (trie.source < part.stop)
            out = np.repeat(shares(np.zeros(len(base), dtype=np.int64), base)[None, :], len(trie), axis=0)
            out[trie.leaf[own], trie.source[own] - part.start] = shares(trie.count[own], base[trie.source[own] - part.start])
            return out

        def add(self, trie: Tries) -> None:
            p = self.of(trie, self.rows)
            q = p if self.i == self.j else self.of(trie, self.columns)
            for t in range(q.shape[1]):
                gap = p - q[:, t : t + 1]
                self.sums[:, t] += (gap * gap // q[:, t : t + 1]).sum(axis=0)
            if not self.told:
                return
            all_counts = np.zeros(len(trie), dtype=np.int64)
            np.add.at(all_counts, trie.leaf, trie.count)
            whole = shares(all_counts, int(self.n.sum()) + self.v)
            has = (trie.source >= self.rows.start) & (trie.source < self.rows.stop)
            leaf, source = trie.leaf[has], trie.source[has] - self.rows.start
            own, q = p[leaf, source], whole[leaf]
            value = (own - q) * (own - q) // q
            fits = (own > q) & (value >= self.mark[source])
            leaf, source, value = leaf[fits], source[fits], value[fits]
            if not len(leaf):
                return
            order = np.lexsort((leaf, -value, source))
            leaf, source, value = leaf[order], source[order], value[order]
            first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            for a, b in zip(first, [*first[1:], len(source)], strict=True):
                few = slice(a, min(b, a + TOLD))
                more = list(zip((-value[few]).tolist(), trie.term.take(pa.array(leaf[few])).to_pylist(), strict=True))
                k = int(source[a])
                self.told[k] = sorted(self.told[k] + more)[:TOLD]
                if len(self.told[k]) == TOLD:
                    self.mark[k] = -self.told[k][-1][0]

        def done(self) -> Iterator[tuple]:
            for s, name in enumerate(self.names[self.rows]):
                for t, other in enumerate(self.names[self.columns]):
                    if name != other:
                        yield "pair", self.lang, name, other, int(self.sums[s, t])
            for s, found in enumerate(self.told):
                for value, term in found:
                    yield "term", self.lang, self.names[self.rows][s], term.decode(), -value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            block = None
            for lang, i, j, names, leaves in _rows(batches):
                if block is None or (block.lang, block.i, block.j) != (lang, i, j):
                    if block is not None:
                        yield from block.done()
                    block = Block(lang, i, j)
                block.add(unflattened(leaves, 0, np.array([block.code[x] for x in names], dtype=np.int64)))
            if block is not None:
                yield from block.done()

        yield from _batches(rows(), out_schema, 4096)

    # nearly always one block a language
    sizes = [(lang, k * SOURCES) for lang, (names, _, _) in groups.items() for k in range(-(-len(names) // SOURCES))]
    blocks = pieces.sparkSession.createDataFrame(sizes, "lang string, i int")
    dealt = pieces.join(F.broadcast(blocks), "lang").join(F.broadcast(blocks.withColumnRenamed("i", "j")), "lang")
    return dealt.sortWithinPartitions("lang", "i", "j", "first").select("lang", "i", "j", "sources", "leaves").mapInArrow(run, schema)


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank.

    A term is a run of letters A to Z, a to z and characters beyond ASCII, with A to Z made small; each row is a
    document, and a language keeps the terms in ``least_docs`` of its documents.  Of n occurrences of kept terms and v
    kept terms, a term that occurs c times has the share p = 1 + floor(SCALE * (c + 1) / (n + v)), for each source of
    the language and for the language; a share p differs from q by floor((p - q)^2 / q).  Part ``pair``: what a source
    differs from each other source of the language by, summed over the kept terms (0 if there are none).  Part ``term``:
    the first TOLD terms that a source has, and more often than the language has, by their difference.  Ranks are by
    falling value, then by the item's bytes.

    Null texts, languages and sources count as empty text; a group without terms has pairs and no terms; rows that
    repeat count each; ties go by bytes; other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    docs = project(df, text=text_col, lang=lang_col, source=source_col)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = written(merged_tries(written(term_tries(docs)), least_docs))
    totals = found.where("kind = 'total'").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    there = written(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(found.where("kind = 'terms'").groupBy("lang").agg(F.sum("n").alias("v")), "lang", "left"))
    if there.count() > GROUPS:
        raise ValueError(f"over {GROUPS} groups of language and source")
    groups: dict[str, list] = {}
    for r in there.where("v > 0").collect():  # a row a group
        groups.setdefault(r["lang"], []).append((r["source"], r["n"] or 0, r["v"]))
    known = {lang: ([x[0] for x in sorted(own)], np.array([x[1] for x in sorted(own)], dtype=np.int64), own[0][2]) for lang, own in groups.items()}
    pieces = found.where("kind = 'piece'").select("lang", "first", "sources", "leaves")
    scores = written(_scored(pieces, known)) if known else spark.createDataFrame([], "part string, lang string, source string, item string, value long")
    bare = there.where("v IS NULL").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))  # the pairs themselves
    pairs = scores.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none)
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))
    terms = scores.where("part = 'term'").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= TOLD)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*order).unionByName(terms.select(*order))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n, any_value(coalesce(v, 0)) AS v FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n.n + n.v) AS p FROM n JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(m.n) + any_value(m.v)) AS q FROM p JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM n GROUP BY lang) m USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM n a JOIN n b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
