"""The cascade: a stage judges only what the one before it escalated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import BlocklistStage, ClassifierStage, Stage

SKIP = "skip"


def chosen(stages: list[Stage | str | None]) -> list[Stage]:
    """Without those that are None or the word ``skip`` in any case."""
    return [s for s in stages if s is not None and not (isinstance(s, str) and s.lower() == SKIP)]


def strong(keywords: list[str], threshold: int = 2) -> list[Stage]:
    """The strong policy removes whatever the blocklist flags."""
    return [BlocklistStage(keywords, threshold)]


def weak(keywords: list[str], classifier: Stage, threshold: int = 2) -> list[Stage]:
    """The weak policy removes what the blocklist flags and the classifier confirms."""
    return [BlocklistStage(keywords, threshold), classifier]


def cascade(docs: DataFrame, stages: list[Stage | str | None]) -> DataFrame:
    """``docs`` (text and anything else) with ``<name>``, ``<name>_metadata`` for each stage and ``combined_filter``.

    One narrow pass without a key, a join or a shuffle.  A stage whose ``gated`` is true, as all of this package are,
    takes the gate and judges the other rows' place only: null goes to its model, which isn't called for nulls
    (``when(gate, udf)`` would call it for all).  So each model sees an escalated row once, however many stages follow.

    Documents are split at the gate of any other stage, which reads the escalated part; both parts are put together
    again by a union.  As the union reads what is before it once for each part, it is checkpointed first if a model
    has judged it.
    """
    stages = chosen(stages)
    previous, modelled = None, False
    for stage in stages:
        kept = docs.columns
        verdict = [F.col("_should").alias(stage.name), F.col("_metadata").alias(f"{stage.name}_metadata")]
        if previous is None:
            docs = stage.judge(docs).select(*kept, *verdict)
        elif getattr(stage, "gated", False):
            docs = stage.judge(docs, F.coalesce(F.col(previous), F.lit(False))).select(*kept, *verdict)
        else:
            if modelled:
                from ..sources.shared import pinned

                docs = pinned(docs)
            gate = F.coalesce(F.col(previous), F.lit(False))
            judged = stage.judge(docs.where(gate)).select(*kept, *verdict)
            passed = docs.where(~gate).select(*kept, F.lit(False).alias(stage.name), stage.default_metadata().cast(judged.schema[f"{stage.name}_metadata"].dataType).alias(f"{stage.name}_metadata"))
            docs = judged.unionByName(passed)
        previous, modelled = stage.name, modelled or getattr(stage, "costly", True)
    return docs.withColumn("combined_filter", F.col(previous) if previous else F.lit(False))


def verdict_columns(judged: DataFrame, id_col: str = "id") -> DataFrame:
    """The id, if there is one, and every column with ``_filter`` in its name."""
    return judged.select(*[c for c in judged.columns if c == id_col or "_filter" in c])


__all__ = ["BlocklistStage", "ClassifierStage", "cascade", "chosen", "strong", "verdict_columns", "weak"]
