"""Mergeable summaries: quantiles and distinct counts of chunks, stored once and merged for any set of them.

A chunk's summary is one row a group: counts, bounds, a KLL sketch of the values and a theta sketch of the items.  Tasks
make partial sketches before the shuffle, so a hot group costs one sketch a task.  A stored chunk is never read again:
what is asked of any set of chunks comes from their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Size of a KLL sketch: a quantile's rank is within QUANTILE_ERROR of the one asked for in over 99 of 100 cases.
QUANTILES, QUANTILE_ERROR = 800, 0.005
#: Binary logarithm of a theta sketch's size, and three times its relative standard error.
ITEMS, DISTINCT_ERROR = 14, 3 / 2**7


def sketched(df: DataFrame, by: list[str], value: str, item: str) -> DataFrame:
    """``by``, n (rows), n_values, low, high, quantiles (sketch) and items (sketch) of each group.

    Null and NaN values and null items are in no sketch; a group without any has a null sketch.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    text = F.col(item).cast("string")
    out = df.withColumns({"_x": x, "_item": text}).groupBy(*by).agg(
        F.count("*").alias("n"), F.count("_x").alias("n_values"), F.min("_x").alias("low"), F.max("_x").alias("high"),
        F.kll_sketch_agg_double("_x", QUANTILES).alias("quantiles"), F.theta_sketch_agg("_item", ITEMS).alias("items"), F.count("_item").alias("_items"),
    )
    some = F.when(F.col("n_values") > 0, F.col("quantiles")).alias("quantiles")
    return out.select(*by, "n", "n_values", "low", "high", some, F.when(F.col("_items") > 0, F.col("items")).alias("items"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The summary of each group of ``by`` from the rows of any chunks and finer groups."""
    out = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", QUANTILES).alias("quantiles"), F.theta_union_agg("items", ITEMS).alias("items"), F.count("items").alias("_items"),
    )
    some = F.when(F.col("n_values") > 0, F.col("quantiles")).alias("quantiles")
    return out.select(*by, "n", "n_values", "low", "high", some, F.when(F.col("_items") > 0, F.col("items")).alias("items"))


def summary(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """The rows with their sketches told: quantile_values (null without values; the ends are exact) and n_distinct (0 without items)."""
    told = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(float(p)) for p in probabilities]))
    return sketches.withColumn("quantile_values", F.when(F.col("quantiles").isNotNull(), told)).withColumn(
        "n_distinct", F.when(F.col("items").isNotNull(), F.theta_sketch_estimate("items")).otherwise(F.lit(0)).cast("bigint")).drop("quantiles", "items")


def rank_of(sketches: DataFrame, value: float) -> DataFrame:
    """``sketches`` with the share of values that are not above ``value``, about."""
    return sketches.withColumn("rank", F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_rank_double("quantiles", F.lit(float(value)))))


def shared_items(sketches: DataFrame, key: str) -> DataFrame:
    """first, second, n_shared: distinct items that pairs of rows have in common, about; a row a pair of groups, of which there are few."""
    known = sketches.where(F.col("items").isNotNull())
    left, right = known.select(F.col(key).alias("first"), F.col("items").alias("_a")), known.select(F.col(key).alias("second"), F.col("items").alias("_b"))
    return left.join(right, F.col("first") < F.col("second")).select("first", "second", F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).cast("bigint").alias("n_shared"))


def add_chunk(df: DataFrame, path: str, chunk: str, by: list[str], value: str, item: str) -> bool:
    """Stores a chunk's summary under ``path``; a chunk that is there is left alone, its rows unread.  Returns whether it was new."""
    spark = df.sparkSession
    place = f"{path}/chunk={chunk}"
    if files.exists(spark, f"{place}/_SUCCESS"):
        return False
    sketched(df, by, value, item).write.mode("overwrite").parquet(place)
    return True


def stored(spark: SparkSession, path: str, chunks: list[str] | None = None) -> DataFrame:
    """The rows of all chunks under ``path`` or of those named; other chunks' files aren't opened."""
    found = spark.read.option("basePath", path).parquet(path)
    return found if chunks is None else found.where(F.col("chunk").cast("string").isin(chunks))
