"""Filtering reports, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIOS = ("precision", "recall", "f1")


def _ratio(top: Column, bottom: Column) -> Column:
    """0.0 on a division by zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, predicted: str, actual: str | None = None, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """n, tn, fp, fn, tp, num_filtered, percent_filtered (a fraction) and fpr, of all rows or of groups.

    Without an actual column every label is false.  All counts are there also with one class only.
    """
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False)) if actual and actual in df.columns else F.lit(False)
    cells = [F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in (("tn", ~p & ~a), ("fp", p & ~a), ("fn", ~p & a), ("tp", p & a)))]
    out = (df.rollup(*by) if rollup else df.groupBy(*(by or []))).agg(*cells)
    out = out.withColumn("num_filtered", F.col("fp") + F.col("tp")).withColumn("percent_filtered", _ratio(F.col("num_filtered"), F.col("n")))
    return out.withColumn("fpr", _ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def class_report(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """label (false, true, macro avg, weighted avg), precision, recall, f1, support, and the accuracy in every row."""
    c = confusion(df, predicted, actual)
    one = lambda label, hit, guessed, support: F.struct(
        F.lit(label).alias("label"), _ratio(F.col(hit), guessed).alias("precision"), _ratio(F.col(hit), support).alias("recall"), support.alias("support"))
    no = one("false", "tn", F.col("tn") + F.col("fn"), F.col("tn") + F.col("fp"))
    yes = one("true", "tp", F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    rows = c.select(_ratio(F.col("tn") + F.col("tp"), F.col("n")).alias("accuracy"), F.inline(F.array(no, yes)))
    rows = rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.sum("support")
    macro = rows.groupBy("accuracy").agg(*[F.avg(k).alias(k) for k in RATIOS], n.alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = rows.groupBy("accuracy").agg(*[_ratio(F.sum(F.col(k) * F.col("support")), n).alias(k) for k in RATIOS], n.alias("support")).withColumn("label", F.lit("weighted avg"))
    order = ["label", *RATIOS, "support", "accuracy"]
    return rows.select(*order).unionByName(macro.select(*order)).unionByName(weighted.select(*order))


def boolean_filters(df: DataFrame) -> list[str]:
    """Boolean columns with ``filter`` in their name, in any case."""
    return [c for c, kind in df.dtypes if kind == "boolean" and "filter" in c.lower()]


def profile(df: DataFrame) -> DataFrame:
    """column_name, n_true, n_false, n_null, percent_true for every boolean filter column, in one scan."""
    columns = boolean_filters(df)
    cells = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c)).alias("n_true"), F.count_if(~F.col(c)).alias("n_false"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in columns]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_true long, n_false long, n_null long, percent_true double")
    out = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    return out.withColumn("percent_true", F.try_divide(100.0 * F.col("n_true"), F.col("n_true") + F.col("n_false") + F.col("n_null")))


def failures(judged: DataFrame) -> DataFrame:
    """n_errors (verdicts of classifier and judge that come from an error rather than an answer) and n."""
    known = [c for c in ("bert_filter_metadata", "lm_filter_metadata") if c in judged.columns and "error" in judged.schema[c].dataType.names]
    wrong = sum((F.col(f"{c}.error").isNotNull().cast("int") for c in known), F.lit(0))
    return judged.agg(F.coalesce(F.sum(wrong), F.lit(0)).cast("bigint").alias("n_errors"), F.count("*").alias("n"))


def failures_by_kind(judged: DataFrame) -> DataFrame:
    """stage, kind, n: failed verdicts of classifier and judge by the error's kind, which is what stands before the first colon: a model that never loads shows as one kind with all rows."""
    known = [c for c in ("bert_filter_metadata", "lm_filter_metadata") if c in judged.columns and "error" in judged.schema[c].dataType.names]
    cells = F.array(*[F.struct(F.lit(c.removesuffix("_metadata")).alias("stage"), F.substring_index(F.col(f"{c}.error"), ":", 1).alias("kind")) for c in known])
    if not known:
        return judged.sparkSession.createDataFrame([], "stage string, kind string, n long")
    return judged.select(F.inline(cells)).where("kind IS NOT NULL").groupBy("stage", "kind").agg(F.count("*").alias("n"))
