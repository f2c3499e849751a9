"""Order-dependent row operators; each takes its order explicitly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.text import percent_label
from ..sources.shared import written

#: Rows at most that an ordered limit takes; more are taken by their number.
FEW = 10_000


def _content(df: DataFrame) -> DataFrame:
    """With _h1 and _h2, 128 bits that stand for all that a row holds, nulls and where they are included."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [F.to_json(F.struct(c), {"ignoreNullFields": "false"})] if isinstance(f.dataType, (ArrayType, MapType, StructType)) else [c, c.isNull()]
    return df.withColumns({"_h1": F.xxhash64(F.lit(1), *parts), "_h2": F.xxhash64(F.lit(2), *parts)})


def places(df: DataFrame, order_by: list[str], value: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """A narrow table, a row for each different row of ``df``: _h1 and _h2 (its content), _c (how often it is there), _v (its ``value``, a whole number), _first and _before (rows, and values' sum, before it in the order), and the columns ``keep``.

    Rows that tie in the order go by their content, so that they are as many ranges as others.  Only keys, hashes and
    counts are dealt, sorted and written; a broadcast row a partition makes places within partitions places in the whole.
    """
    order = [f"_o{k}" for k in range(len(order_by))]
    kept = [f"_k{k}" for k in range(len(keep or []))]
    narrow = _content(df).select(
        *[F.col(c).alias(o) for c, o in zip(order_by, order, strict=True)], *[F.col(c).alias(k) for c, k in zip(keep or [], kept, strict=True)], "_h1", "_h2", (F.lit(0) if value is None else value).cast("bigint").alias("_v"),
    )
    known = narrow.groupBy(*order, *kept, "_h1", "_h2").agg(F.count("*").alias("_c"), F.max(F.coalesce("_v", F.lit(0))).alias("_v"))
    dealt = known.repartitionByRange(*order, "_h1", "_h2").sortWithinPartitions(*order, "_h1", "_h2").select(*kept, "_h1", "_h2", "_c", "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if batch.num_rows:
                n = batch.column("_c").to_numpy()
                sums = np.cumsum(n), np.cumsum(n * batch.column("_v").to_numpy())
                before = [np.r_[start, start + x[:-1]] for start, x in zip((rows, total), sums, strict=True)]
                rows, total = rows + int(sums[0][-1]), total + int(sums[1][-1])
                columns = [pa.array(np.full(batch.num_rows, part, dtype=np.int32)), *map(pa.array, before)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", "_n", "_s"])

    table = written(dealt.mapInArrow(run, StructType([*dealt.schema.fields, *StructType.fromDDL("_part int, _n long, _s long").fields])))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = table.groupBy("_part").agg(F.sum("_c").alias("_rows"), F.sum(F.col("_c") * F.col("_v")).alias("_sum"))
    before = parts.select("_part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}0") for c in ("_rows", "_sum")])
    out = table.join(F.broadcast(before), "_part").withColumns({"_first": F.col("_n") + F.col("_rows0"), "_before": F.col("_s") + F.col("_sum0")})
    return out.select("_h1", "_h2", "_c", "_v", "_first", "_before", *[F.col(k).alias(c) for c, k in zip(keep or [], kept, strict=True)])


def _placed(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df`` with the columns of ``places`` and _k, which counts rows that are the same: each row meets its place by its content."""
    same = Window.partitionBy("_h1", "_h2").orderBy("_h1")
    return _content(df).join(found, ["_h1", "_h2"]).withColumn("_k", F.row_number().over(same) - 1)


def running_sum(df: DataFrame, value: Column, order_by: list[str], name: str) -> DataFrame:
    """``df`` with the running total of ``value`` (whole numbers; this row included; null counts as 0) in the order ``order_by``; rows that tie go by a hash of what they hold."""
    placed = _placed(df, places(df, order_by, value))
    return placed.withColumn(name, F.col("_before") + (F.col("_k") + 1) * F.col("_v")).select(*[c for c in df.columns if c != name], name)


def row_index(df: DataFrame, order_by: str | list[str], name: str = "id", within: list[str] | None = None) -> DataFrame:
    """0-based place in the order, of the table or of each group of ``within``; no group is ever in one task.  Rows that tie go by a hash of what they hold."""
    order = [order_by] if isinstance(order_by, str) else order_by
    found = places(df, [*(within or []), *order], keep=within)
    if within:
        first = found.groupBy(*within).agg(F.min("_first").alias("_least"))
        first = first.select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], "_least")
        same = [F.col(c).eqNullSafe(F.col(f"_w{k}")) for k, c in enumerate(within)]
        found = found.join(first, same).withColumn("_first", F.col("_first") - F.col("_least"))
    placed = _placed(df, found.select("_h1", "_h2", "_first"))
    return placed.withColumn(name, F.col("_first") + F.col("_k")).select(*[c for c in df.columns if c != name], name)


def ensure_id(df: DataFrame, order_by: str | list[str], split: str | None = None) -> DataFrame:
    """``df`` as it is if it has an id; else with one from its order, counted anew in each split."""
    return df if "id" in df.columns else row_index(df, order_by, "id", [split] if split else None)


def first_rows(df: DataFrame, order_by: str | list[str], n: int) -> DataFrame:
    """The first ``n`` rows of the order, or all if there are fewer.  Over FEW rows are taken by their number, so that no task holds them all."""
    order = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*order).limit(n) if n <= FEW else row_index(df, order, "_place").where(F.col("_place") < n).drop("_place")


def percent_chunks(df: DataFrame, order_by: str, fraction: float, split: str = "train") -> DataFrame:
    """chunk_idx and chunk_label: chunks of max(1, int(n * fraction)) rows in the order.  The index is the key; labels of narrow chunks repeat."""
    n = df.count()
    size = max(1, int(n * fraction))
    start = F.col("chunk_idx") * size
    label = percent_label(split, start, F.least(start + size, F.lit(n)), F.lit(n))
    out = row_index(df, order_by, "_i").withColumn("chunk_idx", F.floor(F.col("_i") / size).cast("bigint"))
    return out.withColumn("chunk_label", label).drop("_i")


def shard(df: DataFrame, world_size: int, rank: int, order_by: str) -> DataFrame:
    """Every ``world_size``-th row of the order from ``rank`` on; Spark itself needs no shards."""
    return row_index(df, order_by, "_i").where(F.col("_i") % world_size == rank).drop("_i")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Ordered by a hash of key and seed: the same order however the rows are partitioned."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def grid(left: DataFrame, right: DataFrame, seed: int | None = None, most: int = 100_000) -> DataFrame:
    """All combinations of two small parameter tables (of ``most`` rows together, else an error), in seeded order if a seed is given."""
    if left.limit(most + 1).count() * right.limit(most + 1).count() > most:
        raise ValueError(f"a grid of over {most} combinations")
    out = left.crossJoin(right)
    return out if seed is None else out.orderBy(F.xxhash64(*out.columns, F.lit(seed)))


def chunk_order(label: Column, rank: Column) -> list[Column]:
    """Sort keys of result parts: start percent, then rank, as numbers."""
    return [F.regexp_extract(label, r"\[(\d+)%", 1).cast("int"), rank.cast("int")]


def layer_order(name: Column) -> list[Column]:
    """Sort keys of layer names: the first number (without one: 100), then the rest."""
    number = F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int")
    return [F.coalesce(number, F.lit(100)), F.regexp_replace(name, r"^.*?\d+\.?", "")]


def kept_layers(name: Column, every: int = 6) -> Column:
    """Layers whose number is a multiple of ``every``, and names without a number."""
    number = F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int")
    return number.isNull() | (number % every == 0)
