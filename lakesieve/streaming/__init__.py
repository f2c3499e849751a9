"""Incremental runs over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg, tokens
from ..operators.cascade import cascade, verdict_columns
from ..operators.stages import Stage
from ..sources import files, readers
from ..sources.shared import written


def stream_cascade(docs: DataFrame, stages: list[Stage], output: str, checkpoint: str):
    """Judge what has arrived since the last call and append the verdicts; exactly once, by the checkpoint.  Returns the finished query.

    The cascade needs no key and keeps no state, so each micro-batch is judged on its own.
    """

    def judge(batch: DataFrame, number: int) -> None:
        judged = verdict_columns(cascade(batch, stages)).withColumn("batch", F.lit(number))
        judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    query = docs.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_retained(docs: DataFrame, removed_ids: DataFrame, output: str, checkpoint: str, id_col: str = "id"):
    """Stream-static anti join: documents whose id isn't removed are appended as JSON lines."""
    kept = docs.join(removed_ids, id_col, "left_anti")
    query = kept.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()
    return query


def stream_gram(vectors: DataFrame, output: str, checkpoint: str, vector: str = "x", layer: str = "layer"):
    """Each micro-batch's Gram sums become a part of ``output``; ``current_gram`` adds the parts.  A batch that runs again replaces its part."""

    def add(batch: DataFrame, number: int) -> None:
        part = linalg.gram(batch, vector, layer).withColumn("batch", F.lit(number))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    query = vectors.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_gram(spark: SparkSession, output: str, until: int | None = None, layer: str = "layer") -> DataFrame:
    """The Gram matrix over all parts, or over the batches up to ``until``: a snapshot."""
    parts = spark.read.parquet(output)
    parts = parts if until is None else parts.where(F.col("batch") <= until)
    return parts.groupBy(layer, "i", "j").agg(F.sum("g").alias("g"))


def stream_pack(docs: DataFrame, output: str, checkpoint: str, length: int, order_by: list[str], end: str = "<eos>"):
    """Packs what has arrived since the last call to sequences of ``length`` tokens under ``output/sequences`` (seq_id, input_ids), batch after batch; returns the finished query.

    The tokens that a batch leaves, fewer than ``length``, and the next sequence's number are its state, a row under
    ``output/tail``; the next batch begins with them.  A batch that runs again replaces its part and its tail.
    Documents of a batch are in the order of ``order_by``.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tails = f"{output}/tail"
        before = spark.read.parquet(tails).where(F.col("batch") < number).orderBy(F.col("batch").desc()).limit(1).collect() if files.exists(spark, tails) else []
        head, next_id = (before[0]["tokens"], before[0]["next_id"]) if before else ([], 0)
        every = written(tokens.cut(batch, length, order_by, end, head=head))
        full = every.where(F.size("input_ids") == length).select((F.col("seq_id") + next_id).alias("seq_id"), "input_ids", F.lit(number).alias("batch"))
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/sequences")
        rest = every.where(F.size("input_ids") < length).first()  # one row at most
        n = every.agg(F.count_if(F.size("input_ids") == length)).first()[0]
        tail = spark.createDataFrame([(list(rest["input_ids"]) if rest else [], next_id + n, number)], "tokens array<string>, next_id long, batch int")
        tail.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(tails)

    query = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


__all__ = ["current_gram", "readers", "stream_cascade", "stream_gram", "stream_pack", "stream_retained"]
