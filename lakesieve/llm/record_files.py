"""Token ids in length-delimited binary files.

A record is ``length`` (8 bytes) | masked checksum of the length (4) | payload | masked checksum of the payload (4), all
little-endian; the checksum is CRC-32C, turned right by 15 bits and added to a constant, so that files that hold files
don't check by accident.  A payload is one serialised sequence: the bytes of an id (1: 2 or 4), the length of the
document's id as text (4; -1: null), that text, and the token ids.

Beside each file lies its index: for each record, and once more for the end, the place of its first byte and the number
of token ids before it in the file (8 bytes each).  A reader of any records, in any order, goes to them by the index.

Documents are dealt by ranges of their ids and sorted there, so the texts are shuffled once, and tokens never; each task
encodes its range and writes it as files of at most FILE_BYTES.  The files' names are new in every attempt and only those
of finished tasks get into the manifest, a Parquet table with a row a file, so a task that is lost and run again, or twice,
does no harm.  The manifest's running sums say where each file begins in the whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import new_folder
from .common import project, written
from .packing import word_ids

#: A file ends with the record that reaches this.
FILE_BYTES = 256 << 20
#: Bytes of records that a reading task takes, about, and that it holds at a time.
SPLIT_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Texts that are encoded and framed at a time, and about the bytes that they have at most.
TEXTS, TEXT_BYTES = 512, 2 << 20
#: The reversed polynomial of CRC-32C, and what masking adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a lane: a message is cut into lanes whose checksums are worked out side by side.
LANE = 256


class ChecksumError(ValueError):
    """A record whose bytes don't agree with their checksum, or an index that doesn't agree with its file."""


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(4, 256) each: what a register becomes by its byte k and the next four bytes, and by LANE zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    by_zero = lambda x: one[x & 255] ^ (x >> 8)
    word = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    lane = list(word)
    for _ in range(4):
        word = [by_zero(x) for x in word]
    for _ in range(LANE):
        lane = [by_zero(x) for x in lane]
    return np.stack(word), np.stack(lane)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def checksums(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of messages of 4 bytes and more.

    A checksum is linear: zeros in front change nothing if the register begins with zero, so messages are filled up
    there to whole lanes, and the register's usual beginning is the same as other first four bytes.
    """
    word, lane = _tables()
    size = np.array([len(m) for m in messages], dtype=np.int64)
    if not len(size):
        return np.empty(0, dtype=np.uint32)
    if size.min() < 4:
        raise ValueError("messages of 4 bytes and more")
    pads = -size % LANE
    data = np.frombuffer(b"".join([x for m, pad in zip(messages, pads.tolist(), strict=True) for x in (bytes(pad), m)]), dtype=np.uint8).copy()
    lanes = (size + pads) // LANE
    ends = np.cumsum(lanes)
    data[((ends - lanes) * LANE + pads)[:, None] + np.arange(4)] ^= 255
    columns = np.ascontiguousarray(data.view("<u4").reshape(-1, LANE // 4).T)
    register = np.zeros(columns.shape[1], dtype=np.uint32)
    for column in columns:
        register = _apply(word, register ^ column)
    order = np.argsort(-lanes, kind="stable")  # so that messages that have a further lane come first
    first, out = (ends - lanes)[order], np.zeros(len(size), dtype=np.uint32)
    having = np.searchsorted(-lanes[order], -np.arange(1, int(lanes.max()) + 1), side="right")
    for step, n in enumerate(having.tolist()):
        out[:n] = _apply(lane, out[:n]) ^ register[first[:n] + step]
    back = np.empty_like(out)
    back[order] = out
    return back ^ np.uint32(0xFFFFFFFF)


def masked(checksum: np.ndarray) -> np.ndarray:
    return ((checksum >> np.uint32(15)) | (checksum << np.uint32(17))) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    """The records of payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(checksums([*heads, *payloads])).astype("<u4")
    raw, n = sums.tobytes(), 4 * len(payloads)
    return [b"".join((h, raw[4 * k : 4 * k + 4], p, raw[n + 4 * k : n + 4 * k + 4])) for k, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def payloads_of(records: list[bytes], where: str = "") -> list[bytes]:
    """What ``frames`` got; an error if a length or a checksum isn't right."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    if any(len(r) < 20 or struct.unpack("<Q", r[:8])[0] != len(r) - 16 for r in records):
        raise ChecksumError(f"a record's length isn't what its index says {where}")
    want = np.frombuffer(b"".join([r[8:12] for r in records] + [r[-4:] for r in records]), dtype="<u4")
    if (masked(checksums([*heads, *payloads])) != want).any():
        raise ChecksumError(f"a record's checksum is wrong {where}")
    return payloads


def serialised(doc_id: str | None, ids: bytes, width: int) -> bytes:
    name = b"" if doc_id is None else doc_id.encode()
    return struct.pack("<Bi", width, -1 if doc_id is None else len(name)) + name + ids


def parsed(payload: bytes) -> tuple[str | None, np.ndarray]:
    """The document's id and its token ids."""
    width, n = struct.unpack_from("<Bi", payload)
    at = 5 + max(n, 0)
    return None if n < 0 else payload[5:at].decode(), np.frombuffer(payload, dtype=f"<u{width}", offset=at)


def _store(folder: str):
    """The file system of a folder (a path, or an address that pyarrow knows) and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Writer:
    """One file and its index."""

    def __init__(self, store, base: str, part: int, number: int):
        name = f"{base}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}"
        self.store, self.file, self.index = store, f"{name}.records", f"{name}.index"
        self.data, self.places = store.open_output_stream(self.file), store.open_output_stream(self.index)
        self.row = [part, number, 0, 0, 0]  # documents, ids, bytes

    def add(self, records: list[bytes], counts: np.ndarray) -> None:
        ends, ids = np.cumsum([len(r) for r in records]), np.cumsum(counts)
        first = np.r_[0, ends[:-1]] + self.row[4], np.r_[0, ids[:-1]] + self.row[3]
        self.data.write(b"".join(records))
        self.places.write(np.stack(first, axis=1).astype("<u8").tobytes())
        self.row[2:] = [self.row[2] + len(records), self.row[3] + int(ids[-1]), self.row[4] + int(ends[-1])]

    def done(self) -> tuple:
        self.places.write(struct.pack("<QQ", self.row[4], self.row[3]))
        self.data.close()
        self.places.close()
        return (*self.row[:2], self.file.rpartition("/")[2], self.index.rpartition("/")[2], *self.row[2:])

    def drop(self) -> None:
        for stream, name in ((self.data, self.file), (self.places, self.index)):
            try:
                stream.close()
                self.store.delete_file(name)
            except OSError:  # the task's own error is the one to tell
                pass


_MANIFEST = "part int, number int, file string, index string, n_docs long, n_ids long, n_bytes long"


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of texts that are encoded at a time."""
    ends, at = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))], 0
    while at < len(texts):
        stop = min(at + TEXTS, int(np.searchsorted(ends, ends[at] + TEXT_BYTES, side="right")) - 1)
        yield at, max(stop - at, 1)
        at += max(stop - at, 1)


def write_records(df: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text with the word BPE at ``path``, ``end_id`` behind it, and writes the ids in the order of ``id_col``; returns the manifest.

    The manifest has a row a file: folder, part, number, file, index, n_docs, n_ids, n_bytes, and start, the token ids in
    all files before it.  ``folder``: a path or address that the executors can write; None: a new one in the shared folder.

    A null text counts as empty (one end id).  Null ids come first; rows that repeat an id are written each, in the order
    in which they are read.  Other columns are ignored.  An empty table gives no files.  Very long texts are records of
    their own size; a task holds TEXTS texts at a time, and of texts that have TEXT_BYTES together fewer, one at least.
    """
    folder = folder or new_folder(df.sparkSession, "records")
    out_schema = to_arrow_schema(StructType.fromDDL(_MANIFEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end, writer, rows = TaskContext.get().partitionId(), array("I", [end_id]).tobytes(), None, []
        store = base = encoder = None
        try:
            for whole in batches:
                for start, number in _lots(whole.column(1)):
                    batch = whole.slice(start, number)
                    if encoder is None:
                        encoder, (store, base) = word_ids(path), _store(folder)
                        store.create_dir(base, recursive=True)
                    width = 2 if len(encoder.ends) <= 1 << 16 and end_id < 1 << 16 else 4
                    own = [x + end for x in encoder.many([t or "" for t in batch.column(1).to_pylist()])]
                    counts = np.array([len(x) // 4 for x in own])
                    raw, stops = np.frombuffer(b"".join(own), dtype="<u4").astype(f"<u{width}").tobytes(), np.r_[0, np.cumsum(counts)] * width
                    names = batch.column(0).to_pylist()
                    records = frames([serialised(names[k], raw[stops[k] : stops[k + 1]], width) for k in range(len(names))])
                    at, ends = 0, np.cumsum([len(r) for r in records])
                    while at < len(records):
                        writer = writer or _Writer(store, base, part, len(rows))
                        stop = 1 + int(np.searchsorted(ends, FILE_BYTES - writer.row[4] + (ends[at - 1] if at else 0)))
                        writer.add(records[at:stop], counts[at:stop])
                        at = stop
                        if writer.row[4] >= FILE_BYTES:
                            rows.append(writer.done())
                            writer = None
            if writer is not None:
                rows.append(writer.done())
        except BaseException:
            if writer is not None:
                writer.drop()
            raise
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    # the place among rows of one id parts them, so that an id that repeats isn't one range
    docs = project(df, doc_id=id_col, text=text_col).withColumn("place", F.monotonically_increasing_id())
    docs = docs.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    manifest = written(docs.mapInArrow(run, _MANIFEST))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.select(F.lit(folder).alias("folder"), "*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("start"))


def _map_records(splits: DataFrame, take: Callable[[str | None, int, np.ndarray], tuple], schema: str) -> DataFrame:
    """``take(doc_id, start, ids)`` for the records from ``first`` to before ``stop`` of each split (folder, file, index, start, first, stop), checked."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def read(folder: str, file: str, index: str, start: int, first: int, stop: int) -> Iterable[tuple]:
        store, base = _store(folder)
        with store.open_input_file(f"{base}/{index}") as f:
            f.seek(16 * first)
            places = np.frombuffer(f.read(16 * (stop - first + 1)), dtype="<u8").reshape(-1, 2).astype(np.int64)
        if len(places) != stop - first + 1:
            raise ChecksumError(f"the index of {file} is too short")
        with store.open_input_file(f"{base}/{file}") as f:
            at = 0
            while at < stop - first:
                end = max(at + 1, int(np.searchsorted(places[:, 0], places[at, 0] + READ_BYTES, side="right")) - 1)
                f.seek(int(places[at, 0]))
                raw, cuts = f.read(int(places[end, 0] - places[at, 0])), places[at : end + 1, 0] - places[at, 0]
                payloads = payloads_of([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], f"in {file}")
                for payload, begin in zip(payloads, places[at:end, 1].tolist(), strict=True):
                    yield take(*((found := parsed(payload))[0], start + begin, found[1]))
                at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for made in read(*row):
                    out.append(made)
                    if len(out) >= 1024:
                        yield flush()
                        out = []
        if out:
            yield flush()

    return splits.select("folder", "file", "index", "start", "first", "stop").mapInArrow(run, schema)


def _splits(manifest: DataFrame) -> DataFrame:
    """Ranges of records of about SPLIT_BYTES, each a row, dealt evenly: files are read by as many tasks as they have splits, and any reader begins by the index."""
    n = F.least(F.greatest(F.ceil(F.col("n_bytes") / SPLIT_BYTES), F.lit(1)), F.col("n_docs"))
    total = manifest.agg(F.sum(n)).first()[0] or 1
    out = manifest.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    out = out.withColumn("first", F.expr("n_docs * _k div _n")).withColumn("stop", F.expr("n_docs * (_k + 1) div _n"))
    return out.drop("_n", "_k").repartition(min(int(total), 100_000))  # a number that is given isn't made smaller for small rows


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id (string), start (token ids of all documents before it), ids: every record, its checksums verified."""
    return _map_records(_splits(manifest), lambda name, start, ids: (name, start, ids.tolist()), "doc_id string, start long, ids array<int>")


def read_shuffled(manifest: DataFrame, seed: int, tasks: int) -> DataFrame:
    """``read_records`` in an order that depends on the seed only: ``tasks`` partitions, dealt and sorted by a hash of (file's place, record, seed), each record found by the index."""
    spread = F.xxhash64("part", "number", "first", F.lit(seed))
    each = manifest.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1))).withColumn("stop", F.col("first") + 1)
    each = each.withColumn("_key", spread).repartitionByRange(tasks, "_key").sortWithinPartitions("_key", "part", "number", "first")
    return _map_records(each, lambda name, start, ids: (name, start, ids.tolist()), "doc_id string, start long, ids array<int>")


def record_digests(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id (of the given type), start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read back from the files."""
    read = _map_records(_splits(manifest), lambda name, start, ids: (name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "doc_id string, start long, n_tokens long, ids_crc32 long")
    return read.withColumn("doc_id", F.col("doc_id").cast(kind))


def open_records(spark: SparkSession, folder: str, manifest_path: str) -> DataFrame:
    """A manifest that was saved as Parquet, for files that have moved to ``folder`` since."""
    return spark.read.parquet(manifest_path).withColumn("folder", F.lit(folder))
