"""Corpus assembly: verdicts are joined back and documents retained, removed, added again or inserted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import first_rows, row_index, seeded_shuffle


def rethreshold(verdicts: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """Set the classifier's verdict anew by ``highest_score >= threshold``.

    ``compat``: only ``bert_filter`` changes, for every row.  Otherwise only rows that reached the classifier change
    (the blocklist flagged them), and ``combined_filter`` follows where no later stage overrode it.
    """
    over = F.coalesce(F.nanvl(F.col("bert_filter_metadata.highest_score"), F.lit(None).cast("double")) >= threshold, F.lit(False))
    if compat:
        return verdicts.withColumn("bert_filter", over)
    reached = F.coalesce("word_filter", F.lit(True)) if "word_filter" in verdicts.columns else F.lit(True)
    out = verdicts.withColumn("bert_filter", F.when(reached, over).otherwise(False))
    last = F.col("bert_filter") & F.coalesce("lm_filter", F.lit(True)) if "lm_filter" in verdicts.columns else F.col("bert_filter")
    return out.withColumn("combined_filter", last)


def ids_of(verdicts: DataFrame, decision: str | None = None, id_col: str = "id") -> DataFrame:
    """Distinct ids, of the rows that ``decision`` removes if one is named."""
    chosen = verdicts if decision is None else verdicts.where(F.col(decision))
    return chosen.select(id_col).distinct()


def judged_documents(base: DataFrame, verdicts: DataFrame, id_col: str = "id", keep_unjudged: bool = False) -> DataFrame:
    """Documents with a verdict; the others drop out unless they are to be kept."""
    return base if keep_unjudged else base.join(ids_of(verdicts, None, id_col), id_col, "left_semi")


def retained(base: DataFrame, verdicts: DataFrame, decision: str = "combined_filter", id_col: str = "id", keep_unjudged: bool = False) -> DataFrame:
    """Judged documents that ``decision`` doesn't remove; an anti join, so null ids do no harm."""
    return judged_documents(base, verdicts, id_col, keep_unjudged).join(ids_of(verdicts, decision, id_col), id_col, "left_anti")


def removed(base: DataFrame, verdicts: DataFrame, decision: str = "combined_filter", id_col: str = "id") -> DataFrame:
    return base.join(ids_of(verdicts, decision, id_col), id_col, "left_semi")


def approved_escalations(base: DataFrame, verdicts: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents that the blocklist flagged and the classifier passed."""
    approved = verdicts.where(F.col("word_filter") & ~F.col("bert_filter")).select(id_col).distinct()
    return base.join(approved, id_col, "left_semi")


def reappend(kept: DataFrame, base: DataFrame, verdicts: DataFrame, id_col: str = "id") -> DataFrame:
    """UNION ALL with the approved escalations: up-weighted (twice) if the decision kept them, restored (once) if it didn't."""
    return kept.unionByName(approved_escalations(base, verdicts, id_col))


def insert(kept: DataFrame, extra: DataFrame, name: str, order_by: str, id_col: str = "id", seed: int | None = 42) -> DataFrame:
    """UNION ALL of both as (id string, source, text); missing ids become ``name-i`` by ``order_by``, missing sources ``name``; shuffled by ``seed`` unless it is None."""
    if id_col not in extra.columns:
        extra = row_index(extra, order_by, "_i").withColumn(id_col, F.concat(F.lit(f"{name}-"), F.col("_i").cast("string")))
    if "source" not in extra.columns:
        extra = extra.withColumn("source", F.lit(name))
    base = kept if "source" in kept.columns else kept.withColumn("source", F.lit(None).cast("string"))
    narrow = lambda df: df.select(F.col(id_col).cast("string").alias(id_col), "source", "text")
    out = narrow(base).unionByName(narrow(extra))
    return out if seed is None else seeded_shuffle(out, id_col, seed)


def coverage(base: DataFrame, verdicts: DataFrame) -> DataFrame:
    """n_base, n_verdicts, coverage_percent (null without documents), status: equal, partial or larger."""
    n = base.agg(F.count("*").alias("n_base")).crossJoin(verdicts.agg(F.count("*").alias("n_verdicts")))
    status = F.when(F.col("n_base") == F.col("n_verdicts"), "equal").when(F.col("n_verdicts") < F.col("n_base"), "partial").otherwise("larger")
    return n.withColumn("coverage_percent", F.try_divide(100.0 * F.col("n_verdicts"), F.col("n_base"))).withColumn("status", status)


def check_coverage(base: DataFrame, verdicts: DataFrame) -> dict:
    found = coverage(base, verdicts).first().asDict()
    if found["status"] == "larger":
        raise ValueError(f"more verdicts ({found['n_verdicts']}) than documents ({found['n_base']})")
    return found


def assembly_stats(base: DataFrame, verdicts: DataFrame, result: DataFrame, decision: str = "combined_filter", n_inserted: int = 0) -> DataFrame:
    """One row: sizes, percent removed, and the retention percentage, which counts inserted and re-appended rows and so can pass 100."""
    one = base.agg(F.count("*").alias("original_dataset_size"))
    two = verdicts.agg(F.count_if(F.col(decision)).alias("filtered_records_size"))
    three = result.agg(F.count("*").alias("retained_dataset_size"))
    out = one.crossJoin(two).crossJoin(three).withColumn("num_insert_samples", F.lit(n_inserted).cast("bigint"))
    ratio = lambda c: F.try_divide(100.0 * F.col(c), F.col("original_dataset_size"))
    return out.withColumn("filtered_percentage", ratio("filtered_records_size")).withColumn("retention_percentage", ratio("retained_dataset_size"))


def appended_sources(appended: DataFrame) -> DataFrame:
    """Documents by source."""
    return appended.groupBy("source").agg(F.count("*").alias("n"))


def counterfactual_sources(kept: DataFrame, appended: DataFrame, order_by: str = "id") -> DataFrame:
    """The sources of as many retained documents, the first in the order, as were appended: what the appended ones are held against."""
    return first_rows(kept, order_by, appended.count()).groupBy("source").agg(F.count("*").alias("n"))
