"""Sinks: verdicts, corpora, token counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cascade import verdict_columns
from . import files


def write_verdicts(judged: DataFrame, run: str, by: tuple[str, ...] = ("split", "chunk_idx"), id_col: str = "id") -> None:
    """Verdict columns under ``run/verdicts``, partitioned by those of ``by`` that exist; only the chunks written are replaced."""
    by = tuple(c for c in by if c in judged.columns)
    names = [c for c in verdict_columns(judged, id_col).columns if c not in by]
    writer = judged.select(*names, *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(f"{run}/verdicts")


def write_sample(judged: DataFrame, path: str, order_by: str = "id", most: int = 10_000) -> None:
    """The first ``most`` rows as one CSV; structs, arrays and maps as JSON."""
    nested = ("struct", "array", "map")
    columns = [F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in judged.dtypes]
    judged.orderBy(order_by).limit(most).select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def jsonl_path(path: str) -> str:
    return path if path.endswith(".jsonl") else f"{path}.jsonl"


def write_jsonl(df: DataFrame, path: str, skip: bool = False) -> str | None:
    """A folder of JSON lines parts; nothing if it is to be skipped."""
    if skip:
        return None
    df.write.mode("overwrite").json(jsonl_path(path))
    return jsonl_path(path)


def write_parquet(df: DataFrame, path: str, *columns: str) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """A run's combined result to its published place; there is no network."""
    df.write.mode("overwrite").parquet(path)


def report(spark: SparkSession, one_row: DataFrame | dict, path: str) -> dict:
    """One row, or a dict, as a JSON file in any file system that Spark writes."""
    content = one_row if isinstance(one_row, dict) else one_row.first().asDict(recursive=True)
    files.write_json(spark, path, content)
    return content


def judgments(judged: DataFrame, path: str, stage: str = "lm_filter", id_col: str = "id") -> str:
    """What the judge said, for each document that reached it, as JSON lines: id, text, judgment, completion, error."""
    said = judged.where(F.col(f"{stage}_metadata.completion").isNotNull() & (F.col(f"{stage}_metadata.completion") != ""))
    return write_jsonl(said.select(id_col, *[c for c in ("text",) if c in judged.columns], f"{stage}_metadata.*"), path)


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, object]:
    """``df`` with counters that fill while it is written, and where to read them: a tracker's numbers without a second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen
