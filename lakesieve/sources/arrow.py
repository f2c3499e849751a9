"""Arrow IPC files as a Spark data source, and written by Spark.

A file is split into ranges of record batches: a task opens its file, reads the footer and goes to its own batches by
their offsets, one at a time, so neither a file's size nor its number of rows is bounded by a task's memory.  A file in
the stream format has no footer and is one task's, batch after batch.  Only named columns are decoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import files

#: Bytes of a file that a task reads, about.
SPLIT_BYTES = 64 << 20


def known_store(path: str) -> bool:
    """Whether pyarrow reads the path's file system itself."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _listed(path: str) -> list[tuple[str, int]]:
    """(path within its file system, size) of the folder's ``*.arrow`` files, by name."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(base))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".arrow"))


def _opened(path: str, file: str, columns: list[str] | None):
    """The reader of a file, and whether it has a footer."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(path)
    source = store.open_input_file(file)
    whole = source.read(6) == b"ARROW1"
    source.seek(0)
    start = pa.ipc.open_file if whole else pa.ipc.open_stream
    reader = start(source)
    if columns is not None:
        fields = [reader.schema.get_field_index(c) for c in columns]
        if min(fields) < 0:
            raise ValueError(f"{file} has no column {columns[fields.index(-1)]}")
        source.seek(0)
        reader = start(source, options=pa.ipc.IpcReadOptions(included_fields=sorted(fields)))
    return reader, whole


@dataclass
class BatchRange(InputPartition):
    """The ``part``-th of ``parts`` ranges of a file's record batches."""

    file: str
    part: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], names: list[str], split: int):
        self.path, self.columns, self.names, self.split = path, columns, names, split

    def partitions(self) -> list[BatchRange]:
        """From names and sizes alone: footers are read by the tasks."""
        parts = [(file, max(1, -(-size // self.split))) for file, size in _listed(self.path)]
        return [BatchRange(file, k, n) for file, n in parts for k in range(n)] or [BatchRange("", 0, 0)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        reader, whole = _opened(self.path, partition.file, self.columns)
        if whole:
            n, k = reader.num_record_batches, partition.part
            batches = (reader.get_batch(i) for i in range(n * k // partition.parts, n * (k + 1) // partition.parts))
        else:
            batches = iter(reader) if partition.part == 0 else ()
        for batch in batches:
            yield batch.select(self.names)


class ArrowFiles(DataSource):
    """Format ``arrow_files``: options ``path`` (a folder), ``columns`` (names with commas between; default all) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self):
        listed = _listed(self.options["path"])
        if not listed:
            raise ValueError(f"no .arrow file in {self.options['path']}; name a schema")
        reader, _ = _opened(self.options["path"], listed[0][0], self._columns())
        names = self._columns() or reader.schema.names
        return from_arrow_schema(pa.schema([reader.schema.field(c) for c in names]))

    def _columns(self) -> list[str] | None:
        return [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], schema.names, schema.names, int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_arrow(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All ``*.arrow`` files of a folder; a schema is that of the first file unless given, and the columns all unless named."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files").option("path", path)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return (reader.schema(schema) if schema else reader).load()


def write_arrow(df: DataFrame, path: str) -> int:
    """A file a task that has rows, in the file format, under ``path``, beside those that are there; returns their number.

    A task writes under a name of its attempt's own, and only the files of finished tasks get the ending that is read.
    """
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        name, sink = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None
        for batch in batches:
            if batch.num_rows:
                if sink is None:
                    store.create_dir(base, recursive=True)
                    stream = store.open_output_stream(f"{base}/{name}.writing")
                    sink = pa.ipc.new_file(stream, schema)
                sink.write(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
        if sink is not None:
            sink.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    spark = df.sparkSession
    names = [r["name"] for r in df.mapInArrow(run, "name string").collect()]  # a name a task
    for name in names:
        files.move(spark, f"{path}/{name}.writing", f"{path}/{name}.arrow")
    return len(names)
