"""Sources: where documents, blocklists, verdicts, configurations and checkpoints come from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import first_rows
from . import files
from .arrow import known_store, read_arrow

BLOCKLIST = "keyword string, pos_ratio double, is_relevant boolean"
DOCUMENT = "id string, text string, source string"
SPECTRUM = "map<string, struct<singular_values: array<double>, n_samples: bigint, hidden_dim: int>>"


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset by its path: .csv, .json, .jsonl, .orc or .txt files, a folder of Arrow files, else Parquet (a file, a folder or a pattern)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if end in ("json", "jsonl"):
        return reader.json(path)
    if end == "orc":
        return reader.orc(path)
    if end == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if any(name.endswith(".arrow") for name in files.names(spark, path)):
        return arrow_folder(spark, path, schema)
    return reader.parquet(path)


def arrow_folder(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All ``*.arrow`` files (IPC stream or file format) of a folder, split by ranges of record batches; only ``columns`` are decoded, if named.

    A store that pyarrow doesn't know itself is read through Spark, a file at a time as one binary value (2 GB at most).
    """
    if known_store(path):
        return read_arrow(spark, path, schema, columns)
    out = _arrow_by_spark(spark, path, schema)
    return out.select(*columns) if columns else out


def _arrow_by_spark(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``arrow_folder`` by Spark's reader of binary files.  Without a schema one task reads the first file and returns its schema, a few bytes, and never its content."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path)

    def opened(raw):
        try:
            stream = pa.ipc.open_stream(raw)
            return stream.schema, iter(stream)
        except pa.ArrowInvalid:
            whole = pa.ipc.open_file(raw)
            return whole.schema, (whole.get_batch(k) for k in range(whole.num_record_batches))

    if schema is None:
        def head(batches):
            for batch in batches:
                for raw in batch.column(0):
                    yield pa.RecordBatch.from_pydict({"s": [opened(pa.BufferReader(raw.as_buffer()))[0].serialize().to_pybytes()]})

        first = found.agg(F.min("path")).first()[0]
        known = found.where(F.col("path") == first).select("content").mapInArrow(head, "s binary").first()["s"]
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(known)))).simpleString()[len("struct<") : -1]

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                yield from opened(pa.BufferReader(raw.as_buffer()))[1]

    return found.select("content").mapInArrow(run, ", ".join(_top_level(schema)))


def _top_level(fields: str) -> list[str]:
    """``a:int,b:array<..>`` -> ``a int``, ``b array<..>``; a list with blanks stays."""
    out, depth, part = [], 0, ""
    for c in fields + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, colon, kind = part.strip().partition(":")
            out.append(f"`{name}` {kind}" if colon and " " not in name else part.strip())
            part = ""
        else:
            part += c
    return out


def split_slice(df: DataFrame, order_by: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by the order (None: all; more than there are: all)."""
    return df if n is None else first_rows(df, order_by, n)


def subset(df: DataFrame, **equal: str) -> DataFrame:
    """A named configuration or split, as a filter that prunes partitions."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """keyword, pos_ratio and, if the source has it, is_relevant."""
    df = read(spark, path)
    names = {"keyword": "string", "pos_ratio": "double", "is_relevant": "boolean"}
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in names.items() if c in df.columns])


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(spark: SparkSession, run: str) -> DataFrame:
    """All parts of a run's verdicts, in one partitioned scan; an unreadable part is an error."""
    return spark.read.parquet(f"{run}/verdicts")


def config(spark: SparkSession, path: str) -> dict:
    return json.loads(files.read_text(spark, path))


def checkpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """batch_idx, samples_processed, results of spectrum checkpoints, by batch."""
    schema = f"batch_idx int, samples_processed bigint, results {SPECTRUM}"
    return spark.read.schema(schema).json(pattern, multiLine=True).orderBy("batch_idx")


def prompt(spark: SparkSession, path: str) -> str | list[dict[str, str]]:
    """A .json file's messages, else the text."""
    text = files.read_text(spark, path)
    return json.loads(text)["messages"] if path.endswith(".json") else text


def first_records(df: DataFrame, n: int | None = 100, most: int = 200) -> DataFrame:
    """Any ``n`` records to look at, a limit that reads as few files as it takes (None: all records); text and nested columns as text of ``most`` characters."""
    shown = [F.col(c) if not kind.startswith(("string", "struct", "array", "map")) else F.col(c) if kind == "string" else F.to_json(c).alias(c) for c, kind in df.dtypes]
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(F.col(c)).alias(c)
    out = (df if n is None else df.limit(n)).select(*shown)
    return out.select(*[cut(c) if kind == "string" else F.col(c) for c, kind in out.dtypes])


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
