"""Line dedup by winnowing: runs of RUN lines and more that came earlier are deleted.

Lines with a character other than white space are hashed.  Of each window of RUN consecutive lines the rightmost
least hash is the window's fingerprint; equal windows choose the same line, so every run of RUN lines is guaranteed
to share one with its earlier copy.  Fingerprints found at one place only fall out.  The places of each other one meet,
in their order; a later place matches an earlier one as far as the lines to its left and to its right, in the windows
that the fingerprint stands for, are the same, and the match, so extended both ways, is deleted.  Matches of a text
that overlap make up the whole run.

A fingerprint of more than BLOCK places is dealt to blocks; the first place of each different window in a block meets
those of the other blocks once more.

Rows that repeat both id and text are one document: a task lets each through once, and where the copies that are left,
one a task at most, meet at a fingerprint, all but the first fall out.

With ``words``, windows of fewer lines that hold over so many words take part as well, each with its own fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_sorted_groups, project, text_key, written
from .suffix_dedup import mixed, powers

#: Lines of a window, and so the shortest run that is deleted.
RUN = 3
#: Runs of fewer lines are deleted too, where asked for, if they hold over so many words.
WORDS = 50
#: Places of one fingerprint that are compared in one task.
BLOCK = 256
#: Documents that a task remembers at a time, to let copies of a row through once.
SEEN = 1 << 19
_BASE = np.uint64(0xD6E8FEB86659FD93)


def solid_lines(text: str) -> list[str]:
    """Lines with something other than space, tab and the like (code points 9 to 13 and 32)."""
    return [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]


def fingerprints(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """The fingerprint's line of each window: the rightmost least of its ``run`` hashes."""
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], run)
    return (len(hashes) - 1 - (np.arange(len(windows)) + windows.argmin(1)))[::-1]


def anchors(df: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """From (doc_id, key, text), one row for each selected line: fp, doc_id, key, at, and of each window that it stands for: back (lines to its left), lines, side (64 bits of all the window's lines).  Narrow."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"fp long, doc_id {kind}, key binary, at int, back array<int>, lines array<int>, side array<bigint>"
    names = StructType.fromDDL(schema).names

    def windows_of(lines: list[bytes]):
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), dtype=np.uint64).reshape(-1, 2)
        before = np.r_[0, np.cumsum([len(x.split()) for x in lines])] if words is not None else None  # bytes split at code points 9 to 13 and 32
        factors = powers(_BASE, run)
        found = []
        for size in (run,) if words is None else range(1, run + 1):
            if len(lines) < size:
                break
            line = fingerprints(both[:, 0], size)
            start = np.arange(len(line))
            side = sum(both[t : t + len(line), 1] * factors[t] for t in range(size))
            if size < run:
                long = before[start + size] - before[start] > words
                line, start, side = line[long], start[long], side[long]
            found.append((line, line - start, np.full(len(line), size), mixed(side + np.uint64(size))))
        line, back, size, side = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(line, kind="stable")
        at, n = np.unique(line, return_counts=True)
        return both[at, 0], at, n, back[order], size[order], side[order]

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        with np.errstate(over="ignore"):
            for whole in batches:
                for begin in range(0, whole.num_rows, 256):
                    batch = whole.slice(begin, 256)
                    out: list[tuple] = []
                    for r, (doc_id, key, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                        lines = [x.encode("utf-8", "replace") for x in solid_lines(text or "")]
                        if lines and (words is not None or len(lines) >= run):
                            if (doc_id, key) in seen:
                                continue
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add((doc_id, key))
                            fp, at, n, back, size, side = windows_of(lines)
                            out.append((np.full(len(at), r), fp.view(np.int64), at.astype(np.int32), n, back.astype(np.int32), size.astype(np.int32), side.view(np.int64)))
                    if not out:
                        continue
                    row, fp, at, n, back, size, side = (np.concatenate(c) for c in zip(*out, strict=True))
                    take, offsets = pa.array(row), pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (back, size, side)]
                    yield pa.RecordBatch.from_arrays([pa.array(fp), batch.column(0).take(take), batch.column(1).take(take), pa.array(at), *lists], names=names)

    return df.select("doc_id", "key", "text").mapInArrow(run_batches, schema)


def matches(places: DataFrame) -> DataFrame:
    """doc_id, key, at, until: what of each place came earlier; and, with ``back`` of 0 and more, a hot fingerprint's windows whose first place in the block this is: fp, back, lines, side."""
    kind = places.schema["doc_id"].dataType.simpleString()

    def work(key: tuple, t: dict[str, np.ndarray]):
        n, back, lines, side = t["back_n"], t["back"], t["lines"], t["side"]
        if len(n) < 2 and t["blocks"][0] < 2:
            return None
        row = np.repeat(np.arange(len(n)), n)
        new = np.r_[True, (t["place"][1:] != t["place"][:-1]) | (t["at"][1:] != t["at"][:-1])]
        if not new.all():  # copies of a row are neighbours
            row, back, lines, side = (x[new[row]] for x in (row, back, lines, side))
        order = np.lexsort((row, side, lines, back))  # rows are in the order of their places
        same = np.r_[False, (side[order][1:] == side[order][:-1]) & (lines[order][1:] == lines[order][:-1]) & (back[order][1:] == back[order][:-1])]
        later = np.sort(order[same])  # rising rows
        first = np.flatnonzero(np.r_[True, row[later][1:] != row[later][:-1]]) if len(later) else later
        r = row[later][first]
        # windows of a place all hold the fingerprint's line, so together they reach from the leftmost start to the rightmost end
        start, stop = t["at"][row] - back, t["at"][row] - back + lines
        lo = np.minimum.reduceat(start[later], first) if len(later) else start[:0]
        hi = np.maximum.reduceat(stop[later], first) if len(later) else stop[:0]
        sent = order[~same] if t["blocks"][0] > 1 else order[:0]
        r, lo, hi = np.r_[r, row[sent]], np.r_[lo, start[sent]], np.r_[hi, stop[sent]]
        if not len(r):
            return None
        gap = len(r) - len(sent)
        return r, lo, hi, np.full(len(r), key[0]), np.r_[np.full(gap, -1), back[sent]], np.r_[np.zeros(gap, dtype=np.int64), lines[sent]], np.r_[np.zeros(gap, dtype=np.int64), side[sent]]

    schema = f"doc_id {kind}, key binary, at int, until int, fp long, back int, lines int, side long"
    return map_sorted_groups(places, ["fp", "salt"], work, schema, ragged=("back", "lines", "side"), carry=("doc_id", "key"), order=("doc_id", "key", "at"), least=1)


def repeated_runs(df: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, key, runs (first and after the last of the solid lines that came earlier), for texts that have any."""
    selected = written(anchors(df, run, words))
    again = selected.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")  # also those of copies alone, which then match nothing
    again = written(again.select("fp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))  # so that Spark can split the join's hot fingerprints
    places = selected.join(again, "fp").withColumn("place", F.xxhash64("doc_id", "key", "at")).withColumn("salt", F.pmod("place", F.col("blocks")).cast("int"))
    found = written(matches(places))
    later = found.where("back < 0").select("doc_id", "key", "at", "until")
    place = Window.partitionBy("fp", "back", "lines", "side").orderBy("doc_id", "key", "at")  # one row a block
    between = found.where("back >= 0").withColumn("nth", F.row_number().over(place)).where("nth > 1")
    later = later.unionByName(between.select(*later.columns))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "until")).alias("runs"))


def line_dedup(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """``df`` with the text cut, and n_lines (solid lines before) and n_removed added; existing columns of these names are replaced.

    ``words``: later repeats of runs of fewer lines are deleted too if they hold over so many words (maximal runs of
    characters other than code points 9 to 13 and 32); None: ``run`` lines are the shortest, however long they are.

    A place is earlier by (doc_id, the text's digest, line).  A deleted line goes with its line break; white lines stay.
    Null texts stay null with 0 lines; a text whose every line is deleted becomes empty; rows that repeat both id and
    text count as one document, and all get its result; null ids come first; an empty table gives no rows.  Texts are
    shuffled once, to meet their decisions (unless these are small enough for AQE to broadcast).
    """
    docs = project(df, doc_id=id_col, text=text_col).select("doc_id", text_key().alias("key"), "text")
    gone = repeated_runs(docs, run, words).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("runs").alias("_runs"))

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, at in zip(texts, found, strict=True):
                if not text:
                    out.append((text, 0, 0))
                    continue
                if at is None:
                    out.append((text, len(solid_lines(text)), 0))
                    continue
                gone = {i for s in at.tolist() for i in range(s["at"], s["until"])}
                kept, n = [], 0
                for line in text.split("\n"):
                    if line.strip(" \t\x0b\x0c\r"):
                        n += 1
                        if n - 1 in gone:
                            continue
                    kept.append(line)
                out.append(("\n".join(kept), n, len(gone)))
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    cut = cut.asNondeterministic()  # else a filter on its columns would compute it once more
    known = df.withColumn("_jk", text_key(text_col))
    joined = known.join(gone.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_jk") == F.col("_key")), "left")
    joined = joined.withColumn("_cut", cut(F.col(f"`{text_col}`"), F.col("_runs")))
    columns = [F.col("_cut.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.col("_cut.n_lines").alias("n_lines"), F.col("_cut.n_removed").alias("n_removed"))


#: Documents are distinct pairs of id and text, numbered in the order that says which place is earlier.
_LINES_SQL = r"""
WITH docs AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS d FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
lines AS (SELECT d, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (SELECT d, string_split(text, chr(10)) AS ls FROM docs)),
solid AS (SELECT d, p, l, len(regexp_extract_all(l, '[^ \x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY d ORDER BY p) AS i FROM lines WHERE regexp_matches(l, '[^ \x09-\x0D]')),
"""
_CUT_SQL = r"""
later AS (SELECT d, i, k FROM (SELECT d, i, k, row_number() OVER (PARTITION BY k, x ORDER BY d, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT s.d, s.p FROM solid s JOIN later t ON s.d = t.d AND s.i BETWEEN t.i AND t.i + t.k - 1),
kept AS (SELECT d, string_agg(l, chr(10) ORDER BY p) AS text FROM lines ANTI JOIN gone USING (d, p) GROUP BY d),
n AS (SELECT d, count(*) AS n_lines FROM solid GROUP BY d),
g AS (SELECT d, count(*) AS n_removed FROM gone GROUP BY d),
cut AS (SELECT docs.doc_id, docs.text AS old, coalesce(kept.text, '') AS text, n_lines, n_removed FROM docs LEFT JOIN kept USING (d) LEFT JOIN n USING (d) LEFT JOIN g USING (d))
SELECT a.doc_id, cut.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents a LEFT JOIN cut ON a.doc_id IS NOT DISTINCT FROM cut.doc_id AND a.text = cut.old
"""

ORACLE_SQL = (
    _LINES_SQL
    + r"""win AS (SELECT a.d, a.i, 3 AS k, a.l || chr(10) || b.l || chr(10) || c.l AS x FROM solid a JOIN solid b ON b.d = a.d AND b.i = a.i + 1 JOIN solid c ON c.d = a.d AND c.i = a.i + 2),"""
    + _CUT_SQL
)

#: The same with WORDS: repeated windows of one and two lines of over 50 words go too.
WORDS_ORACLE_SQL = (
    _LINES_SQL
    + r"""win AS (
  SELECT d, i, 1 AS k, l AS x FROM solid WHERE w > 50
  UNION ALL SELECT a.d, a.i, 2, a.l || chr(10) || b.l FROM solid a JOIN solid b ON b.d = a.d AND b.i = a.i + 1 WHERE a.w + b.w > 50
  UNION ALL SELECT a.d, a.i, 3, a.l || chr(10) || b.l || chr(10) || c.l FROM solid a JOIN solid b ON b.d = a.d AND b.i = a.i + 1 JOIN solid c ON c.d = a.d AND c.i = a.i + 2
),"""
    + _CUT_SQL
)
