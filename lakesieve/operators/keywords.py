"""Keywords of a table, in any number, looked for in texts: an index of grams, joined and verified.

Each keyword is found by one of its runs of GRAM bytes, the one that fewest keywords have (a shorter keyword by itself).
Tasks hash all runs of their texts' bytes at once and keep those that a bitmap of the index lets through; the bitmap has a
bounded size however many keywords there are, and is made by tasks.  What is left meets the index by the run's hash, and
the candidates are held against the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of a run, bits of the bitmap (as a power of two), and texts' bytes that are hashed at a time.
GRAM, BITS, BYTES = 5, 27, 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of one row of Spark's bitmap aggregation.
_BUCKET = 32_768


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, none for shorter data."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out = (out ^ data[k : k + n].astype(np.uint64)) * _BASE
            out ^= out >> np.uint64(29)
    return out


def _runs(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of all runs of the given sizes; no run reaches over a text's end."""
    raw = texts.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return
    data, ends = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    row = np.repeat(np.arange(len(raw)), np.diff(ends))
    for size in sizes:
        hashes = run_hashes(data, size)
        inside = row[: len(hashes)] == row[size - 1 :]
        yield row[: len(hashes)][inside], hashes[inside]


def _index(keywords: DataFrame) -> DataFrame:
    """keyword, low, gram, size: the run that stands for each keyword that isn't empty.  A few rows a keyword are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                length = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for size in range(1, GRAM + 1):
                    own = np.flatnonzero(length == size if size < GRAM else length >= size)
                    if len(own):
                        part = batch.take(pa.array(own))
                        for rows, hashes in _runs(part.column(1), [size]):
                            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in part.columns], pa.array(hashes.view(np.int64)), pa.array(np.full(len(rows), size), pa.int32())], names=["keyword", "low", "gram", "size"])

    grams = keywords.where("low <> ''").mapInArrow(run, "keyword string, low string, gram long, size int").distinct()
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).withColumnRenamed("gram", "_gram")
    chosen = grams.join(often, F.col("gram") == F.col("_gram")).groupBy("keyword", "low").agg(F.min(F.struct("n", "gram", "size")).alias("m"))
    return written(chosen.select("keyword", "low", F.col("m.gram").alias("gram"), F.col("m.size").alias("size")))


def _bitmap(index: DataFrame) -> np.ndarray:
    """2 ** BITS bits of which those of the index's grams are set."""
    bit = F.pmod(F.col("gram"), F.lit(1 << BITS)) + 1  # Spark counts a bitmap's values from 1
    rows = index.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # 2 ** BITS bits at most
    out = np.zeros((1 << BITS) // _BUCKET * (_BUCKET // 8), dtype=np.uint8)
    for r in rows:
        at = (r["b"] - 1) * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def keyword_matches(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyword_col: str = "keyword") -> DataFrame:
    """``id_col``, keyword: each row of ``docs`` with every different keyword that its text holds, whatever the case.

    Every raw keyword counts by itself, also inside words and other keywords; the empty one is in every text.  Null texts
    hold none, null keywords are none; rows that repeat or share an id are matched each, a null id stays null.  Other
    columns are ignored; an empty side gives no rows.
    """
    spark = docs.sparkSession
    words = keywords.select(F.col(keyword_col).alias("keyword")).where("keyword IS NOT NULL").distinct().withColumn("low", F.lower("keyword"))
    index = _index(words)
    bitmap = spark.sparkContext.broadcast(_bitmap(index))
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # GRAM at most
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low")).where("low IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = bitmap.value, np.int64((1 << BITS) - 1)
        for whole in batches:
            ends, start = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False)), 0
            while start < whole.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES, side="right")))
                batch = whole.slice(start, stop - start)
                for rows, hashes in _runs(batch.column(1), sizes):
                    gram = hashes.view(np.int64)
                    bit = gram & mask
                    passed = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    rows, gram = rows[passed], gram[passed]
                    order = np.lexsort((gram, rows))
                    rows, gram = rows[order], gram[order]
                    new = np.r_[True, (rows[1:] != rows[:-1]) | (gram[1:] != gram[:-1])][: len(rows)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[new])), pa.array(gram[new])], names=["id", "gram"])
                start = stop

    met = low.mapInArrow(run, f"id {low.schema['id'].dataType.simpleString()}, gram long")
    candidates = met.join(index.select(F.col("gram").alias("_gram"), "keyword", F.col("low").alias("_low")), F.col("gram") == F.col("_gram")).select(F.col("id").alias("_id"), "keyword", "_low").distinct()
    found = low.join(candidates, F.col("id").eqNullSafe(F.col("_id"))).where(F.contains("low", "_low")).select("id", "keyword")
    everywhere = low.join(words.where("low = ''").select("keyword"), F.lit(True)).select("id", "keyword")  # one row at most
    return found.unionByName(everywhere).withColumnRenamed("id", id_col)
