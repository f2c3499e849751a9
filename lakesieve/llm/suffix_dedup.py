"""Repeated passages by sparse suffix arrays.

Suffixes are retained where a text's content chooses: of each run of WINDOW words the GRAM-word group with the least
hash is the minimiser, so two copies of a passage of WINDOW words always retain suffixes at the same places.  Suffixes
whose minimiser is found once only fall out.  Each remaining suffix goes, as one row, to the others that begin with
the same minimiser, with the hashes of what lies on either side of it, to the left as far and to the right as far as
one of its windows reaches.  There the suffixes are sorted by that content, neighbours in the order compared, and each
match is extended left and right: a suffix's match is the union of its windows that a neighbour has too.  Every
distance to the left is an order of its own, so the result is exact: a passage is found whichever neighbour shares its
left and its right part.  Matches of a text that overlap or touch make up the passage.

A minimiser of more than BLOCK suffixes is dealt to blocks; windows that are single in their block, and one of those
that aren't, meet once more by their content, at most one a block.  Texts that are equal as a whole take part once, and
each copy is one passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_sorted_groups, project, text_key, written

#: Words of the shortest passage, and of a minimiser.
WINDOW, GRAM = 50, 10
#: Suffixes of one minimiser that are compared in one task.
BLOCK = 256
#: Words as in ``\S+`` for space and code points 9 to 13.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = r"[\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str = "text"):
    """64-bit hashes of a text's words, on the JVM side."""
    return F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def part_of(key: str):
    """The first 64 bits of a key as a long."""
    return F.conv(F.substring(F.hex(key), 1, 16), 16, -10).cast("bigint")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """A polynomial hash modulo 2**64 of every ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        total = total * odd + words[j : j + len(total)]
    return mixed(total)


def minimisers(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(the minimiser's word of every stretch of ``window`` words, the hashes of the grams)."""
    grams = rolling(words, gram, _ODD)
    per = window - gram + 1
    if len(grams) < per:
        return np.zeros(0, dtype=np.int64), grams
    out = np.empty(len(grams) - per + 1, dtype=np.int64)
    for at in range(0, len(out), 65_536):  # in blocks, so that long texts need no more memory
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + 65_536 + per - 1], per)
        out[at : at + len(part)] = at + np.arange(len(part)) + part.argmin(1)
    return out, grams


def retained(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """From (doc_id, key, words): gram, doc_id, key, places.  One row for each different minimiser of a text.  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, words = batch.columns
            flat, ends = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
            rows, grams_out, places_out, sizes = [], [], [], []
            for r, end in enumerate(ends.tolist()):
                start = ends[r - 1] if r else 0
                at, grams = minimisers(flat[start:end], window, gram)
                if not len(at):
                    continue
                places = np.unique(at)
                values = grams[places]
                order = np.argsort(values, kind="stable")
                values, places = values[order], places[order]
                first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
                rows.append(np.full(len(first), r))
                grams_out.append(values[first])
                places_out.append(places)
                sizes.append(np.diff(np.r_[first, len(values)]))
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places_out).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams_out).view(np.int64)), ids.take(take), keys.take(take), lists], names=["gram", "doc_id", "key", "places"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "key", "words").mapInArrow(run, f"gram long, doc_id {kind}, key binary, places array<int>")


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)], dtype=np.uint64)


def sides(words: np.ndarray, at: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """32 bits each of the words of a window on the left and on the right of its minimiser ``at``; the windows begin at ``starts``.

    Polynomial hashes of any stretch are read off one running sum.
    """
    up, down = powers(_BASE, len(words)), powers(_INVERSE, len(words))
    total = np.r_[np.uint64(0), np.cumsum(words * down[: len(words)], dtype=np.uint64)]
    left = mixed((total[at] - total[starts]) * up[starts])
    right = mixed((total[starts + window] - total[at + gram]) * up[at + gram] + np.uint64(1))
    return (left >> np.uint64(32) << np.uint64(32)) | right >> np.uint64(32)


def suffixes(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each retained suffix in ``places`` (array<struct<place, blocks>>), from (doc_id, key, text, words, places).  Narrow.

    gram, salt, blocks; doc_id, part (64 bits of the key, to tell texts of one id apart); l0 (words of the first of
    its windows to the left of the minimiser), at (the first window's first word), start and stop (its characters);
    and for each of its windows ``sides``, and how many characters further than the window before it it starts and stops.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"gram long, salt int, blocks int, doc_id {kind}, part long, l0 int, at int, start int, stop int, side array<bigint>, on array<int>, off array<int>"
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for begin in range(0, whole.num_rows, 256):
                    batch = whole.slice(begin, 256)
                    ids, keys, texts, words, places = batch.columns
                    flat, ends = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]
                    inner = places.flatten()
                    place, blocks = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    last = np.r_[0, np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))]
                    out: list[tuple] = []
                    for r, (key, text) in enumerate(zip(keys.to_pylist(), texts.to_pylist(), strict=True)):
                        own = flat[ends[r] : ends[r + 1]]
                        at, grams = minimisers(own, window, gram)
                        if not len(at):
                            continue
                        order = np.argsort(place[last[r] : last[r + 1]], kind="stable")
                        mine, dealt = place[last[r] : last[r + 1]][order], blocks[last[r] : last[r + 1]][order]
                        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # a minimiser's windows are neighbours
                        n = np.diff(np.r_[first, len(at)])
                        spot = np.searchsorted(mine, at[first])
                        kept = (spot < len(mine)) & (mine[np.minimum(spot, len(mine) - 1)] == at[first])
                        first, n, spot = first[kept], n[kept], spot[kept]
                        if not len(first):
                            continue
                        begins = np.cumsum(n) - n
                        windows = np.arange(n.sum()) - np.repeat(begins - first, n)
                        span = np.array([m.span() for m in _WORD.finditer(text)], dtype=np.int32)
                        on, off = span[windows, 0], span[windows + window - 1, 1]
                        start, stop = on[begins], off[begins]
                        on, off = np.r_[np.int32(0), np.diff(on)], np.r_[np.int32(0), np.diff(off)]
                        on[begins] = off[begins] = 0
                        part = int.from_bytes(key[:8], "big", signed=True)
                        hot = dealt[spot].astype(np.int64)
                        salt = (mixed(at[first].astype(np.uint64) + np.uint64(part & 0xFFFFFFFFFFFFFFFF)) % hot.astype(np.uint64)).astype(np.int32)
                        out.append((np.full(len(first), r), grams[at[first]].view(np.int64), salt, hot.astype(np.int32), np.full(len(first), part), (at[first] - first).astype(np.int32), first.astype(np.int32), start, stop, n, sides(own, at[windows], windows, window, gram).view(np.int64), on, off))
                    if not out:
                        continue
                    row, g, salt, hot, part, l0, first, start, stop, n, side, on, off = (np.concatenate(c) for c in zip(*out, strict=True))
                    offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (side, on, off)]
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(salt), pa.array(hot), ids.take(pa.array(row)), *map(pa.array, (part, l0, first, start, stop)), *lists], names=names)

    return df.select("doc_id", "key", "text", "words", "places").mapInArrow(run, schema)


def matches(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, part, at, until (words), start, stop (characters): each suffix's match; and, with ``left`` of 0 and more, the windows of hot minimisers that go on to meet those of other blocks: left, side, and ``known`` if they are repeated in their block."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(key: tuple, t: dict[str, np.ndarray]):
        n, side = t["side_n"], t["side"]
        if len(n) < 2 and t["blocks"][0] < 2:
            return None
        row, begins = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        nth = np.arange(len(row)) - begins[row]
        left = t["l0"][row] - nth
        order = np.lexsort((side, left))
        same = (left[order][1:] == left[order][:-1]) & (side[order][1:] == side[order][:-1])
        again = np.zeros(len(row), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        on, off = np.cumsum(t["on"]), np.cumsum(t["off"])  # the first of a row is 0
        hits = np.flatnonzero(again)
        fresh = np.flatnonzero(np.r_[True, row[hits][1:] != row[hits][:-1]]) if len(hits) else hits
        lo, hi = hits[fresh], hits[np.r_[fresh[1:] - 1, len(hits) - 1]] if len(hits) else hits
        if t["blocks"][0] > 1:  # every different window goes on, and those that are repeated here are known to be
            sent = order[np.r_[True, ~same]]
            lo, hi, known = np.r_[lo, sent], np.r_[hi, sent], np.r_[np.zeros(len(lo), dtype=bool), again[sent]]
            marked, what = np.r_[np.full(len(lo) - len(sent), -1), left[sent]], np.r_[np.zeros(len(lo) - len(sent), dtype=np.int64), side[sent]]
        else:
            known, marked, what = np.zeros(len(lo), dtype=bool), np.full(len(lo), -1), np.zeros(len(lo), dtype=np.int64)
        if not len(lo):
            return None
        r = row[lo]
        start, stop = t["start"][r] + on[lo] - on[begins[r]], t["stop"][r] + off[hi] - off[begins[r]]
        return r, t["at"][r] + nth[lo], t["at"][r] + nth[hi] + window, start, stop, np.full(len(lo), key[0]), marked, what, known

    schema = f"doc_id {kind}, part long, at int, until int, start int, stop int, gram long, `left` int, side long, known boolean"
    return map_sorted_groups(rows, ["gram", "salt"], work, schema, ragged=("side", "on", "off"), carry=("doc_id", "part"), least=1)


def equal_neighbours(sorted_rows: DataFrame) -> DataFrame:
    """Rows of a frame sorted within partitions by its first three columns (numbers) that equal a neighbour in these.  Streams: one row is held over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before, not yet told, and whether it equals the one before it
        last_equal = False

        def pair(batch: pa.RecordBatch) -> np.ndarray:
            return np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)], 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches(([last] if last is not None else []) + [batch]).combine_chunks().to_batches()[0]
            content = pair(rows)
            same = (content[1:] == content[:-1]).all(1)
            keep = np.r_[last_equal if last is not None else False, same] | np.r_[same, False]
            if keep[:-1].any():
                yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
            last, last_equal = rows.slice(rows.num_rows - 1, 1), bool(keep[-1])
        if last is not None and last_equal:
            yield last

    return sorted_rows.mapInArrow(run, sorted_rows.schema)


def repeated_passages(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (code points, stop exclusive), n_words, whole: one row for each union of overlapping or touching ``window``-word stretches of a text that occur twice or more in the table (in other texts or in this one).

    ``whole``: the text is one of several equal ones (of ``window`` words or more) and counts as one passage.
    Null, empty and shorter texts have none.  Rows that repeat both id and text are copies and give a row each; null
    ids are kept; other columns are ignored; an empty table gives no rows.  Windows are compared by 128 bits: 64 of the
    minimiser and 32 of each side.  The texts are shuffled once, to find those with a minimiser that is found twice.
    """
    docs = project(df, doc_id=id_col, text=text_col).select("doc_id", text_key().alias("key"), "text", word_hashes().alias("words"))
    size = F.size("words")
    narrow = docs.where(size >= window).select("doc_id", "key", size.alias("n_words"), F.length("text").alias("stop"))
    copied = written(narrow.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))  # so that Spark can split the join's hot texts
    whole = narrow.join(copied, "key", "left_semi").select("doc_id", F.lit(0).alias("start"), F.col("stop").cast("int").alias("stop"), F.col("n_words").cast("int").alias("n_words"), F.lit(True).alias("whole"), part_of("key").alias("part"))

    kept = written(retained(docs, window, gram))
    more = F.max(F.size("places")) > 1
    text = F.xxhash64("key")  # numbers aggregate in place
    again = kept.groupBy("gram").agg(((F.min(text) != F.max(text)) | more).alias("again"), F.ceil(F.sum(F.size("places")) / BLOCK).cast("int").alias("blocks"))
    again = written(again.where("again").select("gram", "blocks"))  # so that Spark can split the join's hot minimisers
    left = kept.join(again, "gram").select("key", "doc_id", "blocks", F.explode("places").alias("place"))
    # equal texts retain equal suffixes: the copy with the least id goes on
    left = left.groupBy("key", "place", "blocks").agg(F.min("doc_id").alias("doc")).groupBy("key").agg(F.min("doc").alias("_id"), F.collect_list(F.struct("place", "blocks")).alias("places"))
    texts = project(df, doc_id=id_col, text=text_col).select("doc_id", text_key().alias("key"), "text").withColumnRenamed("key", "_key")
    met = texts.join(left.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("key"))).select("doc_id", "key", "text", word_hashes().alias("words"), "places")
    found = written(matches(suffixes(met, window, gram), window))
    same = found.where("`left` < 0").select("doc_id", "part", "at", "until", "start", "stop")
    between = found.where("`left` >= 0").select("gram", "left", "side", "known", "doc_id", "part", "at", "until", "start", "stop")
    between = equal_neighbours(between.repartition("gram", "left", "side").sortWithinPartitions("gram", "left", "side"))
    same = same.unionByName(between.where("not known").select(*same.columns))

    by_place = Window.partitionBy("doc_id", "part").orderBy("at", "until")
    before = F.max("until").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = same.withColumn("fresh", F.coalesce(F.col("at") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "part", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("until") - F.min("at")).alias("n_words"))
    ours = whole.select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"))
    passages = runs.join(ours, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left_anti").select("doc_id", "start", "stop", "n_words", F.lit(False).alias("whole"))
    return passages.unionByName(whole.drop("part"))
