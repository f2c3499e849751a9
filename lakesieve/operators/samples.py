"""Deterministic stratified samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .rows import _content

#: Rows of a group that are looked at for each that is taken, and some more.
SPARE, MORE = 4, 40
#: Groups up to which their sizes are broadcast, so that no row is shuffled to be compared with them.
GROUPS = 100_000


def draw(key: list[str], seed: int) -> Column:
    """What a row is drawn by: the MD5 of seed and key as text (null: empty), so that any engine draws the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).cast("binary"))


def _same(columns: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(columns)]


def stratified(df: DataFrame, by: list[str], k: int, key: list[str], seed: int = 42) -> DataFrame:
    """``k`` rows of each group of ``by`` (all, if there are fewer): those least by ``draw``, however the rows are partitioned.

    Groups are counted, and only rows whose draw is below about SPARE * k of the group's n are ranked, so no group is
    sorted.  Where that leaves too few, as when many rows share a key, the group is ranked whole.  Rows that share a key
    go by a hash of what they hold; null groups are groups; rows that repeat are drawn each.
    """
    if not by:
        return stratified(df.withColumn("_all", F.lit(0)), ["_all"], k, key, seed).drop("_all")
    group = [f"_g{i}" for i in range(len(by))]
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(g) for c, g in zip(by, group, strict=True)], "_n")
    sizes = written(sizes)
    near = F.broadcast if sizes.count() <= GROUPS else lambda rows: rows
    drawn = _content(df).withColumn("_draw", draw(key, seed))
    unit = F.conv(F.substring("_draw", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    place = Window.partitionBy(*by).orderBy("_draw", "_h1", "_h2")
    ranked = lambda rows: rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).select(*df.columns)
    few = ranked(drawn.join(near(sizes), _same(by)).where(unit * F.col("_n") < SPARE * k + MORE))
    found = few.groupBy(*by).agg(F.count("*").alias("_found")).select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(by)], "_found")
    known = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_f{i}")) for i, g in enumerate(group)])
    short = sizes.join(found, known, "left").where(F.coalesce("_found", F.lit(0)) < F.least(F.col("_n"), F.lit(k))).select(*group)
    whole = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, group, strict=True)]
    return few.join(near(short), whole, "left_anti").unionByName(ranked(drawn.join(near(short), whole, "left_semi")))
