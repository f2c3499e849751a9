"""What the operators of this subpackage share: reading, Arrow mapping, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import discard, pinned, written

__all__ = ["checkpoint", "discard", "map_parts", "map_rows", "map_sorted_groups", "project", "table", "text_key", "written"]

#: Rows of output that one Arrow batch holds at most.
OUT_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names."""
    return pinned(df)


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names, so that extra columns never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """``make()`` is called once a task and returns a function from one row's values to its output rows."""

    def parts():
        convert = make()

        def rows(*columns: list) -> Iterator[tuple]:
            for row in zip(*columns, strict=True):
                yield from convert(*row)

        return rows

    return map_parts(df, parts, schema)


def map_parts(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, most: int = 256) -> DataFrame:
    """``make()`` is called once a task and returns a function from the columns of at most ``most`` rows, as lists, to output rows.

    Rows stream through in Arrow batches (64 MB at most by Spark's own setting) and leave in batches of OUT_ROWS.
    """

    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert, out = make(), []

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                for row in convert(*[c.to_pylist() for c in batch.slice(start, most).columns]):
                    out.append(row)
                    if len(out) >= OUT_ROWS:
                        yield flush()
                        out = []
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def map_sorted_groups(
    rows: DataFrame, keys: list[str], work: Callable[[tuple, dict[str, np.ndarray]], tuple | None], schema: str,
    lists: tuple[str, ...] = (), ragged: tuple[str, ...] = (), carry: tuple[str, ...] = (), order: tuple[str, ...] = (), least: int = 2,
) -> DataFrame:
    """``work(key, columns)`` for each group of ``least`` rows and more, as numpy arrays, to arrays of the output columns or None.

    ``lists``: columns of lists of one length within a group, given as matrices.  ``ragged``: columns of lists, given
    flat, with their lengths under the name and ``_n``.  ``carry``: columns of any type, nulls included, that aren't
    given; ``work``'s first array then chooses rows of the group, whose values stand first in the output.  ``order``:
    columns by which a group's rows are sorted.

    Rows are dealt by the keys and sorted within partitions, so a group is a run of neighbours; the group that a batch
    breaks off in is held over.  Unlike a pandas call for each group this costs microseconds for a small group.
    """
    names = [c for c in rows.columns if c not in carry]
    others = [c for c in names if c not in keys]
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> tuple[list, int]:
            parts = {c: t.column(c).combine_chunks() for c in names}
            flat = {c: (parts[c].flatten() if c in lists or c in ragged else parts[c]).to_numpy(zero_copy_only=False) for c in names}
            sizes = {c: parts[c].value_lengths().to_numpy(zero_copy_only=False) for c in (*lists, *ragged)}
            ends = {c: np.r_[0, np.cumsum(n)] for c, n in sizes.items()}
            changed = np.zeros(t.num_rows - 1, dtype=bool)
            for k in keys:
                changed |= flat[k][1:] != flat[k][:-1]
            bounds, out = [0, *(np.flatnonzero(changed) + 1).tolist(), *([t.num_rows] if last else [])], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a >= least:
                    own = {c: flat[c][a:b] if c not in ends else flat[c][ends[c][a] : ends[c][b]] for c in others}
                    own |= {c: own[c].reshape(b - a, -1) for c in lists} | {f"{c}_n": sizes[c][a:b] for c in ragged}
                    if (got := work(tuple(flat[k][a] for k in keys), own)) is not None:
                        out.append((got[0] + a, *got[1:]) if carry else got)
            return out, bounds[-1]

        def batch_of(out: list, t: pa.Table) -> pa.RecordBatch:
            arrays = [np.concatenate(c) for c in zip(*out, strict=True)]
            taken = [t.column(c).combine_chunks().take(pa.array(arrays[0])) for c in carry]
            made = [pa.array(x, type=f.type) for x, f in zip(arrays[1:] if carry else arrays, list(out_schema)[len(carry) :], strict=True)]
            return pa.RecordBatch.from_arrays([*taken, *made], names=out_schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            out, done = groups(t, False)
            held = t.slice(done)
            if out:
                yield batch_of(out, t)
        if held is not None and held.num_rows:
            out, _ = groups(held, True)
            if out:
                yield batch_of(out, held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text (null: empty); equal texts have equal keys."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
