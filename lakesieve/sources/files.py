"""Small files of any file system that Spark reads: configurations, markers, reports and prompts, read and written by the driver."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't one."""
    where, fs = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) and fs.getFileStatus(where).isDirectory() else []


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return bool(fs.exists(where))


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _place(spark, path)
    source = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Replaces the file; folders above it are made."""
    where, fs = _place(spark, path)
    sink = fs.create(where, True)
    try:
        sink.write(bytearray(text, "utf-8"))
    finally:
        sink.close()
    return path


def write_json(spark: SparkSession, path: str, content: dict) -> str:
    return write_text(spark, path, json.dumps(content, indent=2, default=str))


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    where, fs = _place(spark, path)
    if not fs.rename(where, _place(spark, to)[0]):
        raise OSError(f"could not move {path} to {to}")
