"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with its sign,
of the largest component.  Several such turns side by side name a bucket of a table.  A vector enters its own bucket
and, as multiprobing, the PROBES - 1 next best ones: those that change the hash with the closest runner-up.  Turns
grow with the logarithm of the number of vectors, so that those that have nothing in common seldom meet; tables are
as many as it takes to find RECALL of pairs planted at the threshold, measured for the vectors' length.

Only ids and buckets move until a bucket has two vectors; then these go there.  They are compared by cosine in double
precision, block by block as matrix products; a pair that meets more than once counts in the least bucket number the
two have in common.  Blocks return link counts and a spanning forest, never the pairs.  Equal vectors are compared
once and counted by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_sorted_groups, project
from .components import connected_components
from .suffix_dedup import mixed

LEAST = 0.95
PROBES = 3
#: Share of pairs planted at the threshold that the tables find; pairs above it are found more often.
RECALL = 0.995
#: Vectors without anything in common that a bucket holds on average, at most.
LOAD = 1.0
#: Vectors of a block; two blocks at a time are in a task's memory.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row; the length is a power of two."""
    x, half = np.array(x, dtype=np.float64, order="C"), 1
    n = x.shape[1]
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        upper, lower = pairs[:, :, 0], pairs[:, :, 1]
        difference = upper - lower
        upper += lower
        lower[:] = difference
        half *= 2
    x /= np.sqrt(n)
    return x


def padded_size(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def turns_for(rows: int, dim: int) -> int:
    """Turns of a bucket's name, so that ``rows`` vectors without anything in common meet LOAD others at most."""
    names, turns = 2 * padded_size(dim), 1
    while rows * PROBES > LOAD * float(names) ** turns and turns < 62 // names.bit_length():
        turns += 1
    return turns


def planted(dim: int, cosine: float, n: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of random unit vectors at one cosine."""
    r = np.random.default_rng([3, dim])
    a = r.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.where(norm > 0, norm, 1)


def tables_for(dim: int, turns: int, least: float = LEAST, recall: float = RECALL, most: int = 64) -> int:
    """Tables that find ``recall`` of pairs planted at the threshold; an error if ``most`` don't, as for thresholds far below 0.9."""
    if dim < 2 or least >= 1:
        return 1
    a, b = planted(dim, least)
    missed = np.ones(len(a), dtype=bool)
    for t in range(most):
        x, y = (buckets(v, 1, turns, first=t)[:, 0] for v in (a, b))
        missed &= ~(x[:, :, None] == y[:, None, :]).any((1, 2))
        if missed.mean() <= 1 - recall:
            return t + 1
    raise ValueError(f"{most} tables find {1 - missed.mean():.4f} of the pairs at cosine {least} in {dim} dimensions, not {recall}; raise the threshold, or lower the recall that is asked for")


def buckets(x: np.ndarray, tables: int, turns: int, probes: int = PROBES, seed: int = 7, first: int = 0) -> np.ndarray:
    """(rows, tables, probes) bucket numbers of unit vectors from the ``first`` table on, the own bucket first."""
    rows, dim = x.shape
    size = padded_size(dim)
    padded = np.zeros((rows, size))
    padded[:, :dim] = x
    probes = min(probes, 1 + turns * (size - 1))
    out = np.empty((rows, tables, probes), dtype=np.int64)
    at = np.arange(rows)
    for t in range(tables):
        signs = np.random.default_rng([seed, size, first + t]).choice([-1.0, 1.0], size=(turns, 3, size))
        best, change, loss = [], [], []
        for k in range(turns):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[k, r])
            heights, axes, values = np.abs(y), [], []
            for _ in range(min(probes, size)):
                top = heights.argmax(1)
                axes.append(top * 2 + (y[at, top] < 0))
                values.append(heights[at, top])
                heights[at, top] = -1
            best.append(axes[0])
            for runner, value in zip(axes[1:], values[1:], strict=True):
                change.append((runner - axes[0]) * (2 * size) ** k)
                loss.append(values[0] - value)
        base = sum(b * (2 * size) ** k for k, b in enumerate(best))
        out[:, t, 0] = base
        # single changes, by what they lose against the own bucket
        if probes > 1:
            change, loss = np.stack(change, 1), np.stack(loss, 1)
        for p in range(1, probes):
            pick = loss.argmin(1)
            out[:, t, p] = base + change[at, pick]
            loss[at, pick] = np.inf
    with np.errstate(over="ignore"):  # a number for each table, size and name; equal ones of different names only cost a comparison
        mark = (np.arange(first, first + tables, dtype=np.uint64) * np.uint64(64) + np.uint64(size.bit_length())) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(out.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mark[None, :, None]).view(np.int64)


def _hashed(df: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """From (id, v): id, codes (array<long>, tables * PROBES); all vectors are finite and not zero.  ``plan``: padded length -> (tables, turns).  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                vectors = part.column(1)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    same = part.take(pa.array(np.flatnonzero(sizes == dim)))
                    x = same.column(1).flatten().to_numpy(zero_copy_only=False).reshape(same.num_rows, dim)
                    codes = buckets(unit(x), *plan[padded_size(int(dim))]).reshape(same.num_rows, -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(same.num_rows + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([same.column(0), lists], names=["id", "codes"])

    return df.select("id", "v").mapInArrow(run, "id long, codes array<bigint>")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length 1; first scaled by their largest component, so that no square is lost."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def compare(v: np.ndarray, ids: np.ndarray, copies: np.ndarray, codes: np.ndarray, block: np.ndarray, bucket: int, i: int, j: int, least: float = LEAST):
    """Links within a block (i = j) or between two: (ids, links found here, an id that leads to what each is linked with), or None.

    ``bucket`` is the place of this comparison; pairs whose least common bucket is another one are left to that one.
    """
    v = unit(v)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    found = parent = None

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for at in range(0, len(left), 256):
        mine = left[at : at + 256]
        a, b = np.nonzero(v[mine] @ v[right].T >= least)
        a, b = mine[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for part in range(0, len(a), 65_536):
            x, y = a[part : part + 65_536], b[part : part + 65_536]
            first = np.full(len(x), np.iinfo(np.int64).max)
            for k in range(codes.shape[1]):
                code = codes[x, k]
                both = (codes[y] == code[:, None]).any(1)
                first = np.where(both & (code < first), code, first)
            x, y = x[first == bucket], y[first == bucket]
            if not len(x):
                continue
            if found is None:
                found, parent = np.zeros(len(v), dtype=np.int64), list(range(len(v)))
            np.add.at(found, x, copies[y])
            np.add.at(found, y, copies[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    if found is None:
        return None
    linked = np.flatnonzero(found)
    return ids[linked], found[linked], ids[[root(k) for k in linked.tolist()]]


def near_vectors(df: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links (other rows whose vector has a cosine of ``least`` and more, as far as they meet in a bucket), component_id (the least vec_id reachable by links), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold a null or non-finite component, and those of different lengths, link
    with nothing.  Equal vectors (by 128 bits of hash; also of rows that repeat an id) are linked.  Rows of one id with
    other vectors are judged each by its vector.  Rows with a null id link with nothing: component null, kept.  Other
    columns are ignored; an empty table gives no rows.  Ids must fit a long.

    Shuffled: each different vector once, then ids and buckets, then the vectors that share a bucket to these.
    """
    rows = project(df, id=id_col, v=vector_col)
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.withColumn("good", good).withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0).cast("float"))))  # -0.0 becomes 0.0
    # rows that take no part spread over the partitions by their ids and meet nothing
    marked = rows.select("id", "good", "v", F.when(F.col("good"), F.xxhash64("v")).otherwise(F.xxhash64("id", F.lit(77))).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    nodes = marked.where("good").groupBy("h1", "h2").agg(F.min("id").cast("long").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = checkpoint(nodes.withColumn("id", F.monotonically_increasing_id()))
    power = F.greatest(F.ceil(F.log2(F.size("v"))), F.lit(1)).cast("int")
    sizes = {1 << int(r["p"]): int(r["rows"]) for r in nodes.groupBy(power.alias("p")).agg(F.count("*").alias("rows")).collect()}  # a row a power of two
    plan = {}
    for size, count in sizes.items():
        turns = turns_for(count, size)
        plan[size] = (max(tables_for(dim, turns, least) for dim in (size // 2 + 1, size)), turns)  # the shortest and the longest vectors that are padded to it
    hashed = checkpoint(_hashed(nodes, plan))
    codes = hashed.select("id", F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = codes.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.hash("id").cast("bigint")).alias("s")).where("size > 1")
    # of buckets with the same vectors the least is enough: it's the least that any two of them have in common
    sizes = sizes.groupBy("size", "x", "s").agg(F.min("bucket").alias("_bucket")).select("_bucket", "size")
    met = codes.join(sizes, F.col("bucket") == F.col("_bucket")).select("bucket", "id", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # only vectors that share a bucket move, each to its buckets' blocks
    vectors = nodes.select(F.col("id").alias("_id"), "copies", "v").join(hashed.withColumnRenamed("id", "_hid"), F.col("_id") == F.col("_hid")).drop("_hid")
    dealt = met.join(vectors, F.col("id") == F.col("_id")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "copies", "v", "codes", "block")

    def work(key: tuple, t: dict[str, np.ndarray]):
        if len(np.unique(t["v_n"])) > 1:  # vectors of different lengths link with nothing
            parts = [compare_same(key, t, n) for n in np.unique(t["v_n"])]
            parts = [p for p in parts if p is not None]
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None
        return compare_same(key, t, t["v_n"][0])

    def compare_same(key: tuple, t: dict[str, np.ndarray], dim: int):
        chosen = t["v_n"] == dim
        v = t["v"][np.repeat(chosen, t["v_n"])].reshape(-1, dim)
        c = t["codes"][np.repeat(chosen, t["codes_n"])].reshape(len(v), -1)
        return compare(v, t["id"][chosen], t["copies"][chosen], c, t["block"][chosen], int(key[0]), int(key[1]), int(key[2]), least)

    found = checkpoint(map_sorted_groups(dealt, ["bucket", "i", "j"], work, "id long, found long, to long", ragged=("v", "codes")))
    counts = found.groupBy("id").agg(F.sum("found").alias("found")).withColumnRenamed("id", "_nid")
    classes = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "_cid")
    of_vector = nodes.select("id", "h1", "h2", "first", "copies").join(counts, F.col("id") == F.col("_nid"), "left").join(classes, F.col("id") == F.col("_cid"), "left")
    of_vector = checkpoint(of_vector.select("h1", "h2", "first", "component", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links")))
    smallest = of_vector.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("least")).withColumnRenamed("component", "_c")
    of_vector = checkpoint(of_vector.join(smallest, F.col("component") == F.col("_c"), "left").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n_links", F.coalesce("least", "first").alias("component_id")))
    out = marked.select("id", "h1", "h2").join(of_vector, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    own = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id").cast("long") == own, F.lit(True)).alias("kept"))
