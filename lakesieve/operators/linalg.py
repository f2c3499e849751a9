"""Gram matrices of vector columns and their spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


#: Cells of a Gram matrix that leave a task in one batch.
CELLS = 1 << 20
#: Triangles that one task folds into one.
FAN = 16


def gram(df: DataFrame, vector: str = "x", layer: str = "layer") -> DataFrame:
    """layer, i, j, g: the sum of x_i * x_j over the layer's rows, uncentred, in long form.

    Each task multiplies Arrow batches as matrices and emits one d * d sum a layer, so the shuffle moves d * d values a
    layer and task, whatever the number of rows, and a row costs d * d multiplications but no d * d cells.  Rows whose
    vector is null or empty fall out; a null component counts as zero.  Vectors of several lengths add up where both
    have a component.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                codes = part.column(0).dictionary_encode()
                sizes, names = part.column(1).value_lengths().to_numpy(zero_copy_only=False), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                flat = pc.fill_null(part.column(1).flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for code, d in sorted(set(zip(names.tolist(), sizes.tolist(), strict=True))):
                    if d:
                        rows = np.flatnonzero((names == code) & (sizes == d))
                        x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                        key = (None if code < 0 else codes.dictionary[code].as_py(), d)
                        sums[key] = sums.get(key, 0) + x.T @ x
        for (name, d), g in sums.items():
            for top in range(0, d, max(1, CELLS // d)):
                slab = g[top : top + max(1, CELLS // d)]
                i, j = np.indices(slab.shape, dtype=np.int32)
                label = pa.array([name], type=layer_type)
                yield pa.RecordBatch.from_arrays([label.take(pa.array(np.zeros(slab.size, dtype=np.int32))), pa.array((i + top).ravel()), pa.array(j.ravel()), pa.array(slab.ravel())], names=[layer, "i", "j", "p"])

    from pyspark.sql.pandas.types import to_arrow_type

    layer_type = to_arrow_type(df.schema[layer].dataType)
    kind = df.schema[layer].dataType.simpleString()
    part = df.where(F.col(vector).isNotNull()).select(layer, vector).mapInArrow(run, f"`{layer}` {kind}, i int, j int, p double")
    return part.groupBy(layer, "i", "j").agg(F.sum("p").alias("g"))


def described(spectra: DataFrame) -> DataFrame:
    """With condition_number (largest / smallest; null if that is zero) and top5."""
    first, last = F.get("singular_values", F.lit(0)), F.try_element_at("singular_values", F.lit(-1))
    return spectra.withColumn("condition_number", F.try_divide(first, last)).withColumn("top5", F.slice("singular_values", 1, 5))


def _packed(r: np.ndarray) -> bytes:
    return r[np.triu_indices(len(r))].astype("<f8").tobytes()


def _unpacked(raw: bytes, d: int, width: int) -> np.ndarray:
    """A triangle as a square of ``width``; the columns that it lacks are zero."""
    out = np.zeros((width, width))
    i, j = np.triu_indices(d)
    out[i, j] = np.frombuffer(raw, dtype="<f8")
    return out


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    """R of the QR decomposition of stacked rows, as a square: what lies below it is of no account for the spectrum."""
    stack = np.vstack(rows)
    r = np.linalg.qr(stack, mode="r")
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def triangles(df: DataFrame, by: list[str], vector: str = "x") -> DataFrame:
    """``by``, n, d and r (the upper triangle of R, row by row): the R of the QR decomposition of each group's rows.

    Each task folds its Arrow batches into one R a group; R's of FAN tasks are folded into one, and so on in a tree, so
    that no task sees more than FAN of them.  A null vector falls out, an empty one counts only where there are others; a
    null component counts as zero, and so do those that a shorter vector lacks.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from ..sources.shared import written

    schema = StructType([df.schema[c] for c in by] + StructType.fromDDL("slot long, n long, d int, r binary").fields)
    out_schema = to_arrow_schema(schema)
    k = len(by)

    def fold(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        if held is None:
            return _triangle([x])
        width = max(held.shape[1], x.shape[1])
        return _triangle([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (held, x)])

    def batch_of(key: tuple, slot: int, n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*key, slot, n, r.shape[1], _packed(r)), out_schema, strict=True)], schema=out_schema)

    def first(batches):
        held: dict[tuple, list] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                part = whole.slice(start, 4096)
                keys = list(zip(*[c.to_pylist() for c in part.columns[:k]], strict=True)) if k else [()] * part.num_rows
                sizes = part.column(k).value_lengths().to_numpy(zero_copy_only=False)
                flat = pc.fill_null(part.column(k).flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                ends, groups = np.cumsum(sizes), {}
                for row, (key, d) in enumerate(zip(keys, sizes.tolist(), strict=True)):
                    groups.setdefault((key, d), []).append(row)
                for (key, d), rows in groups.items():
                    own = held.setdefault(key, [0, None])
                    own[0] += len(rows)
                    if d:
                        own[1] = fold(own[1], flat[(ends[rows] - d)[:, None] + np.arange(d)])
        for key, (n, r) in held.items():
            yield batch_of(key, TaskContext.get().partitionId(), n, np.zeros((0, 0)) if r is None else r)

    def merge(batches):
        now, n, r, slot = None, 0, None, 0
        for batch in batches:
            for row in range(batch.num_rows):
                *key, own_slot, m, d, raw = [c[row].as_py() for c in batch.columns]
                if now is not None and now != (*key, own_slot):
                    yield batch_of(now[:-1], slot, n, r)
                    n, r = 0, None
                now, slot, n = (*key, own_slot), own_slot, n + m
                square = _unpacked(raw, d, d)
                r = square if r is None else r if not d else fold(r, square)
        if now is not None:
            yield batch_of(now[:-1], slot, n, r)

    out = written(df.where(F.col(vector).isNotNull()).select(*by, vector).mapInArrow(first, schema))
    most = out.agg(F.max("slot")).first()[0] or 0
    while most > 0:
        most //= FAN
        out = out.withColumn("slot", F.expr(f"slot div {FAN}"))
        out = out.repartition(*by, "slot").sortWithinPartitions(*by, "slot").mapInArrow(merge, schema)
    return out.drop("slot")


def _values(factors: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n_samples, hidden_dim and the singular values of the triangles, one row at a time."""
    @F.pandas_udf("array<double>")
    def solve(d: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.svd(_unpacked(raw, n, n), compute_uv=False).tolist() if n else [] for n, raw in zip(d, r, strict=True)])

    return factors.select(*by, F.col("n").alias("n_samples"), F.col("d").alias("hidden_dim"), solve("d", "r").alias("singular_values"))


def spectrum(df: DataFrame, vector: str = "x", layer: str = "layer") -> DataFrame:
    """layer, n_samples, hidden_dim, singular_values, condition_number, top5, by tall-skinny QR.

    The singular values are those of each layer's rows themselves, not square roots of a Gram matrix's eigenvalues, so
    values far below the largest keep their digits; a layer is one triangle, never d * d rows.
    """
    return described(_values(triangles(df, [layer], vector), [layer]))


def checkpointed_spectrum(df: DataFrame, batch: str, points: list[int], vector: str = "x", layer: str = "layer") -> DataFrame:
    """checkpoint, layer, n_samples, hidden_dim, singular_values, condition_number, top5 of all rows up to and with each checkpoint's batch.

    The rows are read once: those between two checkpoints are one triangle a layer, and a checkpoint's is folded from these.
    """
    at = F.element_at(F.filter(F.array(*map(F.lit, sorted(points))), lambda p: p >= F.col(batch)), 1)
    steps = triangles(df.where(F.col(batch) <= max(points)).withColumn("_c", at), [layer, "_c"], vector)
    upto = steps.withColumn("checkpoint", F.explode(F.array(*map(F.lit, sorted(points))))).where(F.col("checkpoint") >= F.col("_c"))
    kind = df.schema[layer].dataType.simpleString()

    def fold(pdf):
        width = int(pdf["d"].max())
        squares = [_unpacked(raw, d, width) for d, raw in zip(pdf["d"], pdf["r"], strict=True)]
        r = _triangle(squares) if width else np.zeros((0, 0))
        return pdf[["checkpoint", layer]].head(1).assign(n=pdf["n"].sum(), d=width, r=[_packed(r)])

    folded = upto.select("checkpoint", layer, "n", "d", "r").groupBy("checkpoint", layer).applyInPandas(fold, f"checkpoint int, `{layer}` {kind}, n long, d int, r binary")  # a row a step
    return described(_values(folded, ["checkpoint", layer]))


def checkpoint_schedule(last: int) -> list[int]:
    """Distinct int(2 ** (i / 2)) up to ``last``, and ``last``: 1, 2, 4, 5, 8, 11, 16, ..."""
    out, i = set(), 0
    while (b := int(2 ** (i / 2))) <= last:
        out.add(b)
        i += 1
    return sorted(out | {last}) if last > 0 else []


def checkpointed_grams(df: DataFrame, batch: str, points: list[int], vector: str = "x", layer: str = "layer") -> DataFrame:
    """checkpoint, layer, i, j, g: the Gram matrix of all rows up to and with each checkpoint's batch (1-based).

    Rows are summed once for the checkpoint that they first belong to; the sums up to each checkpoint are added from these.
    """
    at = F.element_at(F.filter(F.array(*map(F.lit, sorted(points))), lambda p: p >= F.col(batch)), 1)
    known = df.withColumn("_c", F.when(F.col(batch) <= max(points), at)).where(F.col("_c").isNotNull())
    step = known.withColumn("_l", F.to_json(F.struct(F.col(layer).alias("layer"), F.col("_c").alias("c")), {"ignoreNullFields": "false"}))
    back = F.from_json("_l", f"layer {df.schema[layer].dataType.simpleString()}, c int")
    sums = gram(step, vector, "_l").withColumn("_k", back).select(F.col("_k.layer").alias(layer), F.col("_k.c").alias("checkpoint"), "i", "j", "g")
    parts = sums.groupBy(layer, "i", "j").agg(F.collect_list(F.struct("checkpoint", "g")).alias("_parts"))  # one for each point at most
    each = parts.withColumn("checkpoint", F.explode(F.array(*map(F.lit, sorted(points)))))
    upto = F.filter("_parts", lambda p: p["checkpoint"] <= F.col("checkpoint"))
    each = each.withColumn("_upto", upto).where(F.size("_upto") > 0)
    return each.select(layer, "i", "j", "checkpoint", F.aggregate("_upto", F.lit(0.0), lambda a, p: a + p["g"]).alias("g"))


def mean_square(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """The mean square of a vector column's values for each group, such as (layer, position)."""
    return df.select(*by, F.explode(vector).alias("v")).groupBy(*by).agg(F.avg(F.col("v").cast("double") * F.col("v").cast("double")).alias("mean_square"))


def layer_losses(pairs: DataFrame, student: str = "student", teacher: str = "teacher", by: str = "layer") -> DataFrame:
    """mse and the three cosine losses in use, averaged over each layer's pairs of vectors."""
    x, y = F.col(student), F.col(teacher)
    cells = {"mse": vectors.mean_squared_error(x, y), "cos_cubed": vectors.cosine_loss(x, y, 1, 3), "cos_30": vectors.cosine_loss(x, y, 30, 1), "cos_cubed_10": vectors.cosine_loss(x, y, 10, 3)}
    return pairs.select(by, *[c.alias(k) for k, c in cells.items()]).groupBy(by).agg(*[F.avg(k).alias(k) for k in cells])
