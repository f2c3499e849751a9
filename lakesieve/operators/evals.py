"""Scoring multiple-choice evaluations from log-likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField

from ..functions.text import choice_list
from ..functions.vectors import argmax
from .rows import first_rows, row_index

#: Of a sample log's rows.
LOG_SCHEMA = (
    "doc_id int, doc struct<custom_id:string,style:string,index:int,original:string,rewritten:string,options:string,correct:int>, "
    "target string, filtered_resps array<array<string>>, acc double"
)


def scored(items: DataFrame, loglik: str = "loglik", target: str = "answer", choices: str | None = "choices") -> DataFrame:
    """``items`` with acc and, if there are choices, acc_norm (log-likelihood a character); ties go to the first."""
    hit = lambda scores: (argmax(scores) == F.col(target)).cast("double")
    out = items.withColumn("acc", hit(F.col(loglik)))
    if choices:
        out = out.withColumn("acc_norm", hit(F.zip_with(loglik, choices, lambda x, c: F.try_divide(x, F.length(c)))))
    return out


def from_log(log: DataFrame) -> DataFrame:
    """doc_id, loglik, target, choices, logged_acc, acc of a sample log, whose numbers are strings and whose options are a list as text."""
    rows = log.select("doc_id", F.transform("filtered_resps", lambda r: r[0].cast("double")).alias("loglik"), F.col("target").cast("int").alias("target"), choice_list(F.col("doc.options")).alias("choices"), F.col("acc").alias("logged_acc"))
    return scored(rows, "loglik", "target", None)


def selected(items: DataFrame, subset: str | None = None, split: str | None = None, category: str | None = None) -> DataFrame:
    """The items of a subset, a split and a category, as far as they are named; columns of these names."""
    for column, value in (("subset", subset), ("split", split), ("category", category)):
        items = items if value is None else items.where(F.col(column) == value)
    return items


def inherited(templates: dict[str, dict], name: str) -> dict:
    """A task's configuration with those it includes (``include``: a name) filled in below its own; an error on a circle."""
    seen, found = [], {}
    while name is not None:
        if name in seen:
            raise ValueError(f"templates include each other: {' -> '.join([*seen, name])}")
        seen.append(name)
        own = dict(templates[name])
        name = own.pop("include", None)
        found = own | found
    return found


def few_shot(items: DataFrame, shots: DataFrame, prompt: str, answer: str, n: int, order_by: str, between: str = "\n\n") -> DataFrame:
    """``items`` with n worked examples before their ``prompt``: the first n rows of ``shots`` in the order, each its prompt, a space and its answer.

    n rows come to the driver; with 0 the items stay as they are.
    """
    if not n:
        return items
    worked = [f"{r[prompt]} {r[answer]}" for r in shots.orderBy(order_by).limit(n).select(prompt, answer).collect()]
    return items.withColumn(prompt, F.concat(F.lit(between.join(worked) + between), F.col(prompt)))


def limited(items: DataFrame, most: int | None, order_by: str, by: list[str] | None = None) -> DataFrame:
    """The first ``most`` items in the order, of all or of each task of ``by``; None: all."""
    if most is None:
        return items
    if not by:
        return first_rows(items, order_by, most)
    return row_index(items, order_by, "_i", by).where(F.col("_i") < most).drop("_i")


def check_choices(items: DataFrame, column: str = "choices") -> DataFrame:
    """Refuses choices that are text: indexing it would show single characters."""
    field: StructField = items.schema[column]
    if not isinstance(field.dataType, ArrayType):
        raise TypeError(f"{column} is {field.dataType.simpleString()}, not an array; parse it first")
    return items


def task_accuracy(items: DataFrame, by: list[str], metric: str = "acc") -> DataFrame:
    """n, acc and its standard error (null for a single item) for each task."""
    return items.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("acc"), (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("stderr"))


def _pooled(tasks: DataFrame, by: list[str]) -> DataFrame:
    n = F.sum("n")
    spread = F.sum((F.col("n") - 1) * F.col("stderr") * F.col("stderr") * F.col("n"))
    return tasks.groupBy(*by).agg(
        n.alias("n"), F.count("*").alias("n_tasks"), F.try_divide(F.sum(F.col("n") * F.col("acc")), n).alias("acc"),
        F.sqrt(F.try_divide(spread, (n - F.count("*")) * n)).alias("stderr"),
    )


def group_accuracy(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Size-weighted mean and pooled standard error of tasks (n, acc, stderr) for each group of ``by`` (none: of all)."""
    return _pooled(tasks, by)


def nested_accuracy(items: DataFrame, subset: str = "subset", category: str = "category", metric: str = "acc") -> DataFrame:
    """Leaves, subsets and the total in one table: subset, category (null: all), n, acc, stderr (of groups: pooled), level.

    The items are read and shuffled once, as counts, means and squared deviations of each leaf.  These moments add up:
    grouping sets over the leaves' rows give every level, the error of a leaf being that of a group of one.
    """
    n, spread = F.sum("_n"), F.sum("_m2")
    leaves = items.groupBy(subset, category).agg(F.count(metric).alias("_n"), F.avg(metric).alias("_mean"), (F.var_pop(metric) * F.count(metric)).alias("_m2"))
    sets = leaves.groupingSets([[F.col(subset), F.col(category)], [F.col(subset)], []], F.col(subset), F.col(category)).agg(
        n.alias("n"), F.try_divide(F.sum(F.col("_n") * F.col("_mean")), n).alias("acc"), F.sqrt(F.try_divide(spread, (n - F.count("*")) * n)).alias("stderr"),
        (F.grouping(subset).cast("int") + F.grouping(category).cast("int")).alias("level"),
    )
    return sets.select(subset, category, "n", "acc", "stderr", "level").where((F.col("level") < 2) | (F.col("n") > 0))


def without_shortcuts(items: DataFrame, guesses: DataFrame, models: int = 3, key: str = "item") -> DataFrame:
    """Items that not all of ``models`` models answer right from the choices alone (guesses: item, model, correct)."""
    easy = guesses.groupBy(key).agg(F.count_if("correct").alias("_n")).where(F.col("_n") >= models).select(key)
    return items.join(easy, key, "left_anti")


def compared(results: DataFrame, baseline: str, model: str = "model", metrics: tuple[str, ...] = ("acc",)) -> DataFrame:
    """``results`` with ``<metric>_delta`` against the baseline model's row."""
    base = results.where(F.col(model) == baseline).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    out = results.crossJoin(F.broadcast(base.limit(1)))  # one row
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(m) - F.col(f"_{m}")).drop(f"_{m}")
    return out
