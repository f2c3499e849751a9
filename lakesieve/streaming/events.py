"""Event time and keyed state over streams of files.

Sliding windows and sessions are Spark's, with a watermark; what comes too late for a window is dropped by the state and
counted apart, as what has arrived less what was counted.  Packing by key keeps a buffer for each key in the state store,
with a timer that lets a buffer go that nothing has been added to.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DatetimeType, FractionalType, StringType, TimestampNTZType

from ..functions.text import words
from ..sources.shared import new_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **settings: str):
    """Session settings for the time in which a query starts; it keeps what it has started with."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _finished(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def arrivals(df: DataFrame, batch: Column, folder: str | None = None) -> DataFrame:
    """A stream that gives ``df`` in the batches that ``batch`` (a whole number from 0 on) says, a file each, in their order; the folder is new unless named.

    The rows are written once, dealt by batch: for replays whose batches a task can write.  Files are read by their time
    of change, which is set here, so the folder has to be of a file system that can set it.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "arrivals")
    df.withColumn("_batch", batch.cast("int")).repartition("_batch").write.partitionBy("_batch").parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    begin = int(time.time() * 1000) - 10_000_000
    for part in fs.listStatus(root):  # a folder a batch
        name = part.getPath().getName()
        if name.startswith("_batch="):
            for file in fs.listStatus(part.getPath()):
                fs.setTimes(file.getPath(), begin + 1000 * int(name.removeprefix("_batch=")), -1)
    schema = df.limit(0).schema
    return spark.readStream.schema(schema.add("_batch", "integer")).option("maxFilesPerTrigger", 1).parquet(folder).drop("_batch")


def _timed(events: DataFrame, at: str) -> DataFrame:
    """Rows with a time, which a watermark wants as a timestamp; one without a zone counts as UTC whatever the session's zone is."""
    known = events.where(F.col(at).isNotNull())
    if isinstance(events.schema[at].dataType, TimestampNTZType):
        known = known.withColumn(at, F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))))
    return known


def _window(at: str, size: str, slide: str | None) -> Column:
    return F.window(at, size, slide) if slide else F.window(at, size)


def stream_windows(events: DataFrame, output: str, checkpoint: str, at: str, size: str, slide: str | None, delay: str, by: list[str], **sums: Column) -> None:
    """Sliding (or, without ``slide``, tumbling) windows of event time over what has arrived since the last call.

    ``output/windows`` gets each batch's changed windows, with n and ``sums`` (each added up); ``output/arrived`` the
    rows of each window that came, late ones too.  A batch that runs again replaces its part.  Rows with a null time are
    in no window.  Partial sums are made before the shuffle, so a hot key costs a row a task.
    """
    spark = events.sparkSession
    timed = _timed(events, at)

    def keep(name: str):
        def write(batch: DataFrame, number: int) -> None:
            flat = batch.withColumns({"start": F.col("window.start"), "end": F.col("window.end")}).drop("window").withColumn("batch", F.lit(number))
            flat.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/{name}")

        return write

    aggregates = [F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]]
    counted = timed.withWatermark(at, delay).groupBy(_window(at, size, slide), *by).agg(*aggregates)

    def came(batch: DataFrame, number: int) -> None:
        keep("arrived")(batch.groupBy(_window(at, size, slide), *by).agg(F.count("*").alias("n")), number)

    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        _finished(counted.writeStream.outputMode("update").foreachBatch(keep("windows")).option("checkpointLocation", f"{checkpoint}/windows"))
        _finished(timed.writeStream.foreachBatch(came).option("checkpointLocation", f"{checkpoint}/arrived"))


def current_windows(spark: SparkSession, output: str, by: list[str], *sums: str) -> DataFrame:
    """start, end, ``by``, n, ``sums`` and n_late of each window: its last state, and the rows that came too late for it."""
    key = ["start", "end", *by]
    columns = ["n", *sums]
    last = spark.read.parquet(f"{output}/windows").groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("_s")).select(*key, *[F.col("_s")[c].alias(c) for c in columns])
    came = spark.read.parquet(f"{output}/arrived").groupBy(*key).agg(F.sum("n").alias("_came")).select(*[F.col(c).alias(f"_{c}") for c in key], "_came")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    out = came.join(last, same, "left").select(*[F.col(f"_{c}").alias(c) for c in key], *columns, "_came")  # a window all of whose rows came late has no state
    return out.select(*key, F.coalesce("n", F.lit(0)).alias("n"), *sums, (F.col("_came") - F.coalesce("n", F.lit(0))).alias("n_late"))


def stream_sessions(events: DataFrame, output: str, checkpoint: str, at: str, gap: str, delay: str, by: list[str]) -> None:
    """Sessions of event time that are over, as start, end (the last event and the gap), ``by`` and n, appended to ``output``: rows of a key that follow each other within the gap.

    A session is over when the watermark has passed its end; those still open stay in the state for later calls.  A row is
    late when its own time and the gap are not after the watermark, whichever task has it, so sessions are not merged
    before the shuffle.  A row that isn't may still follow within the gap of a session that has been given out; it
    begins another one, and ``current_sessions`` puts them together.  Rows with a null time have no session.
    """
    timed = _timed(events, at)
    found = timed.withWatermark(at, delay).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    flat = found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
    with _settings(events.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition="false"):
        _finished(flat.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint))


def current_sessions(spark: SparkSession, output: str, checkpoint: str, by: dict[str, str]) -> DataFrame:
    """start, end, ``by`` (name -> type) and n of the sessions of ``stream_sessions`` that are over: those given out, put together where one begins before another's end, without those that reach into a session still in the state."""
    kinds = ", ".join(["start timestamp", "end timestamp", *[f"`{k}` {v}" for k, v in by.items()], "n long"])
    over = spark.read.schema(kinds).parquet(output).withColumn("_open", F.lit(False))
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        state = spark.read.format("statestore").load(checkpoint)
    kept = state.select(F.col("value.session_window.start").alias("start"), F.col("value.session_window.end").alias("end"), *[F.col(f"value.{k}").alias(k) for k in by], F.lit(0).cast("long").alias("n"), F.lit(True).alias("_open"))
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = over.unionByName(kept).withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    pieces = pieces.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = pieces.groupBy(*by, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.max("_open").alias("_open"))
    return whole.where(~F.col("_open")).select("start", "end", *by, "n")


class _Packer(StatefulProcessor):
    """Per key: the tokens that don't fill a sequence yet and the next sequence's number."""

    def __init__(self, keys: list[str], whole: list[bool], length: int, flush_ms: int | None):
        self.keys, self.whole, self.length, self.flush_ms = keys, whole, length, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.tail = handle, handle.getValueState("tail", "tokens array<string>, next long")

    def _rows(self, key: tuple, sequences: list[list[str]], first: int) -> pd.DataFrame:
        n = range(len(sequences))
        return pd.DataFrame({**{k: [v] * len(n) for k, v in zip(self.keys, key, strict=True)}, "seq_id": [first + k for k in n], "input_ids": sequences})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        before = self.tail.get() if self.tail.exists() else None
        held, first = (list(before[0]), int(before[1])) if before is not None else ([], 0)
        parts = [(*order, body.split("\0")) for pdf in rows for *order, body in zip(*[pdf[c] for c in pdf.columns if c not in self.keys], strict=True)]
        there = lambda v: v is not None and v == v  # noqa: E731 (pandas' nulls aren't equal to themselves)
        parts.sort(key=lambda x: tuple((there(v), (int(v) if whole else v) if there(v) else 0) for v, whole in zip(x[:-1], self.whole, strict=True)))
        full: list[list[str]] = []
        for part in parts:
            held.extend(part[-1])
            whole = len(held) // self.length
            full.extend(held[k * self.length : (k + 1) * self.length] for k in range(whole))
            held = held[whole * self.length :]
        self.tail.update((held, first + len(full)))
        if self.flush_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)
        if full:
            yield self._rows(key, full, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, first = self.tail.get()
        if len(held):
            self.tail.update(([], int(first) + 1))
            yield self._rows(key, [list(held)], int(first))

    def close(self) -> None:
        pass


def stream_pack_by(docs: DataFrame, by: list[str], output: str, checkpoint: str, length: int, order_by: list[str], end: str = "<eos>", tokens=words, flush_ms: int | None = None) -> None:
    """Packs what has arrived since the last call, each key of ``by`` by itself: ``by``, seq_id (from 0 for each key) and input_ids of ``length`` tokens, appended to ``output``.

    A document is ``end`` and its tokens; a key's documents of one batch go by ``order_by`` (nulls first), batch after
    batch.  No token holds a NUL.  What doesn't fill a sequence waits in the key's state; with ``flush_ms`` a key to which nothing has been added
    for so long gives it out as a shorter sequence (in the next batch that runs).  A task holds a key's documents of one
    batch: a key that many documents share should have a shard of them beside it in ``by``.
    """
    spark = docs.sparkSession
    body = F.concat(F.array(F.lit(end)), tokens(F.col("text")))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "seq_id long", "input_ids array<string>"])
    # whole numbers and times go as text: pandas would make them floats beside a null
    whole = [not isinstance(docs.schema[c].dataType, (StringType, FractionalType)) for c in order_by]
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(docs.schema[c].dataType, DatetimeType) else F.col(c).cast("bigint")
    places = [(number(c).cast("string") if w else F.col(c)).alias(f"_o{k}") for k, (c, w) in enumerate(zip(order_by, whole, strict=True))]
    # timers of processing time would keep a query that ends with its data going for ever by batches without any
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__noDataMicroBatches__enabled="false"):
        grouped = docs.select(*by, *places, F.array_join(body, "\0").alias("_body")).groupBy(*by)  # shuffled as one text
        packed = grouped.transformWithStateInPandas(_Packer(by, whole, length, flush_ms), schema, "append", "none" if flush_ms is None else "processingtime")
        _finished(packed.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint))


def run_folder(spark: SparkSession) -> tuple[str, str]:
    """A new output and a new checkpoint in the shared folder, for a run of its own."""
    base = f"{new_folder(spark, 'stream')}/{uuid.uuid4().hex}"
    return f"{base}/output", f"{base}/checkpoint"
