"""Hard negatives by blocked dense products.

Vectors are floored to whole numbers, so that inner products in float64 are exact below 2^53 (more is an error).
Anchors are packed into blocks in the tasks that read them, and a pass takes blocks of at most ANCHORS anchors and
ANCHOR_BYTES bytes, whatever the number of anchors, and broadcasts them; every task multiplies its candidates, a batch
at a time, with TILE anchors at a time.

First pass: each task keeps the first few positives of each anchor, and lists of all tasks merge into one, as the first
few of a union are the first few of the parts' first few.  They go out with the anchors again.  Second pass: of the
candidates of other labels whose score lies in a positive's window, each task keeps the first few, which merge alike.
A list's last entry is the mark that later candidates have to pass, so few cells of a product are ever sorted.

The work is anchors times rows by the task that is set; memory isn't: a task holds one batch, the pass's anchors and
their short lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bounds of a pass: what is broadcast at a time.
ANCHORS, ANCHOR_BYTES = 32_768, 64 << 20
#: Anchors and candidates that are multiplied at a time.
TILE, BATCH = 512, 4096
#: Whole numbers up to here are exact in float64.
EXACT = 2.0**53


def whole_vectors(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * components) as a matrix) for each length of vectors; rows with a null or non-finite component fall out."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = []
    for d in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        out.append((rows[fine], np.floor(x[fine] * scale)))
    return out


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))


class FirstFew:
    """The first ``k`` entries of each slot: by falling score, then by rising id; equal entries count once."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.id, self.score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.mark, self.mark_id = np.full(slots, -np.inf), np.full(slots, np.iinfo(np.int64).max)

    def offer(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        """Candidates ``ids`` with a row of ``scores`` for each of ``slots``, where ``fits``."""
        fits &= scores >= self.mark[slots][:, None]
        n = scores.shape[1]
        if np.count_nonzero(fits) > 4 * self.k * len(slots) and n > self.k:
            shown = np.where(fits, scores, -np.inf)
            fits &= shown >= np.partition(shown, n - self.k, axis=1)[:, n - self.k, None]
        r, c = np.nonzero(fits)
        slot, score, name = slots[r], scores[r, c], ids[c]
        passed = (score > self.mark[slot]) | (name < self.mark_id[slot])
        if not passed.any():
            return
        slot, score, name = np.r_[self.slot, slot[passed]], np.r_[self.score, score[passed]], np.r_[self.id, name[passed]]
        order = np.lexsort((name, -score, slot))
        slot, score, name = slot[order], score[order], name[order]
        new = np.r_[True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (name[1:] != name[:-1])]
        slot, score, name = slot[new], score[new], name[new]
        at = np.arange(len(slot))
        place = at - np.maximum.accumulate(np.where(np.r_[True, slot[1:] != slot[:-1]], at, 0))
        few, last = place < self.k, place == self.k - 1
        self.slot, self.score, self.id = slot[few], score[few], name[few]
        self.mark[slot[last]], self.mark_id[slot[last]] = score[last], name[last]


def _packed(anchors: DataFrame, scale: float) -> DataFrame:
    """Blocks of TILE anchors: n, dim, ids, labels, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                batch = whole.slice(start, TILE)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for rows, x in whole_vectors(batch.column(2), scale):
                    if len(rows):
                        yield pa.RecordBatch.from_pydict({
                            "n": pa.array([len(rows)], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids[rows].astype("<i8").tobytes()], pa.binary()),
                            "labels": pa.array([batch.column(1).take(pa.array(rows)).to_pylist()], pa.list_(pa.string())), "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()),
                        })

    return anchors.mapInArrow(run, "n int, dim int, ids binary, labels array<string>, vectors binary")


def _passes(blocks: DataFrame) -> Iterator[dict]:
    """Anchors of a pass, of which the driver holds one at a time: label -> code, and for each length of vectors ids, codes, vectors and the places of the anchors in the pass."""
    held, n, size = [], 0, 0

    def joined() -> dict:
        codes: dict[str, int] = {}
        parts: dict[int, list] = {}
        for b in held:
            own = np.array([codes.setdefault(x, len(codes)) for x in b["labels"]], dtype=np.int64)
            parts.setdefault(b["dim"], []).append((np.frombuffer(b["ids"], dtype="<i8"), own, np.frombuffer(b["vectors"], dtype="<f8").reshape(b["n"], b["dim"])))
        out, first = [], 0
        for group in parts.values():
            ids, own, x = (np.concatenate(c) for c in zip(*group, strict=True))
            out.append({"ids": ids, "codes": own, "x": x, "first": first, "longest": _longest(x)})
            first += len(ids)
        return {"codes": codes, "groups": out, "n": first}

    for b in blocks.toLocalIterator():
        if held and (n + b["n"] > ANCHORS or size + len(b["vectors"]) > ANCHOR_BYTES):
            yield joined()
            held, n, size = [], 0, 0
        held.append(b)
        n, size = n + b["n"], size + len(b["vectors"])
    if held:
        yield joined()


def _candidates(batches: Iterator[pa.RecordBatch], codes: dict[str, int], groups: list[dict], scale: float):
    """(group of anchors, ids, codes, vectors) of candidates of that length, BATCH at most."""
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            names = batch.column(1).dictionary_encode()
            code = np.array([codes.get(x, -1) for x in names.dictionary.to_pylist()], dtype=np.int64)[names.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else np.empty(0, dtype=np.int64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, x in whole_vectors(batch.column(2), scale):
                for g, group in enumerate(groups):
                    if len(rows) and group["x"].shape[1] == x.shape[1]:
                        if group["longest"] * _longest(x) >= EXACT:
                            raise ValueError("inner products of 2^53 and more aren't exact; lower the scale or leave such vectors out")
                        yield g, ids[rows], code[rows], x


def _output(few: FirstFew, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v[few.slot] for k, v in columns.items()} | {"id": few.id, "score": few.score.astype(np.int64)})


def _first_positives(rows: DataFrame, shared, k: int, scale: float) -> DataFrame:
    """anchor (its place in the pass), id, score: the first ``k`` other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, groups = shared.value["codes"], shared.value["groups"]
        few: dict[tuple, FirstFew] = {}
        own = [{c: np.flatnonzero(g["codes"] == c) for c in np.unique(g["codes"]).tolist()} for g in groups]  # anchors by label
        for g, ids, code, x in _candidates(batches, codes, groups, scale):
            a = groups[g]
            for c, members in own[g].items():
                mine = np.flatnonzero(code == c)
                for top in range(0, len(members) if len(mine) else 0, TILE):
                    chosen = members[top : top + TILE]
                    best = few.setdefault((g, c, top), FirstFew(len(chosen), k))
                    best.offer(np.arange(len(chosen)), ids[mine], a["x"][chosen] @ x[mine].T, a["ids"][chosen][:, None] != ids[mine])
        for (g, c, top), best in few.items():
            yield _output(best, anchor=groups[g]["first"] + own[g][c][top : top + TILE])

    return _merged(rows.mapInArrow(run, "anchor long, id long, score long"), ["anchor"], k)


def _merged(found: DataFrame, slot: list[str], k: int) -> DataFrame:
    """The first ``k`` of each slot with their rank; before the shuffle each task drops what can't be among them."""
    place = Window.partitionBy(*slot).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(place)).where(F.col("rank") <= k).distinct()


def _first_negatives(rows: DataFrame, shared, k: int, low: int, high: int, scale: float) -> DataFrame:
    """anchor_id, positive_id, positive_score, id, score, rank of the first ``k`` rows of other labels in each positive's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, groups, positives = shared.value["codes"], shared.value["groups"], shared.value["positives"]
        few: dict[tuple, FirstFew] = {}
        for g, ids, code, x in _candidates(batches, codes, groups, scale):
            a = groups[g]
            for top in range(0, len(a["ids"]), TILE):
                part = slice(top, top + TILE)
                own = slice(a["first"] + top, a["first"] + min(top + TILE, len(a["ids"])))
                score, least, most = (positives[c][own] for c in ("score", "least", "most"))
                n, width = score.shape
                best = few.setdefault((g, top), FirstFew(n * width, k))
                product = a["x"][part] @ x.T
                product[a["codes"][part][:, None] == code] = np.nan  # never in a window
                for j in range(width):
                    r = np.flatnonzero(least[:, j] <= most[:, j])
                    if len(r):
                        p = product[r]
                        best.offer(r * width + j, ids, p, (p >= least[r, j, None]) & (p <= most[r, j, None]))
        for (g, top), best in few.items():
            first, stop = groups[g]["first"] + top, groups[g]["first"] + min(top + TILE, len(groups[g]["ids"]))
            width = positives["id"].shape[1]
            yield _output(best, anchor=np.repeat(np.arange(first, stop), width), anchor_id=np.repeat(groups[g]["ids"][top : top + TILE], width), positive_id=positives["id"][first:stop].ravel(), positive_score=positives["score"][first:stop].ravel())

    found = rows.mapInArrow(run, "anchor long, anchor_id long, positive_id long, positive_score long, id long, score long")
    return _merged(found, ["anchor", "anchor_id", "positive_id", "positive_score"], k)


def _windows(found: pa.Table, n: int, k: int, low: int, high: int) -> dict[str, np.ndarray]:
    """The positives of each anchor of the pass, ``k`` columns wide, and the least and most score in the window of each; an empty window where there is none."""
    out = {"id": np.zeros((n, k), dtype=np.int64), "score": np.zeros((n, k), dtype=np.int64), "least": np.ones((n, k)), "most": np.zeros((n, k))}
    anchor, place, name, score = (found.column(c).to_numpy() for c in ("anchor", "rank", "id", "score"))
    at = (anchor, place - 1)
    out["id"][at], out["score"][at] = name, score
    out["least"][at], out["most"][at] = -((-low * score) // 100), (high * score) // 100
    return out


def hard_negatives(
    df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which ``anchor`` is true and each of its ``positives`` first other rows of its label, the ``negatives`` first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    A score is the inner product of the vectors, each component x as floor(scale * x); higher scores come first, ties by
    the smaller id, and fewer rows are returned where there are fewer.  Rows with a null id, label or vector, or a null
    or non-finite component, take no part; vectors of other lengths than an anchor's don't meet it.  "Other" rows are
    those with another id; of rows that repeat an id, those with the same score for an anchor count once, others each.
    An anchor without positives, or whose windows are empty (as with scores below zero), gives no rows; an empty table
    gives none.  Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("string").alias("label"), F.col(f"`{vector_col}`").alias("v"), anchor.alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    blocks = written(_packed(rows.where("anchor").select("id", "label", "v"), scale))
    # a task's lists cost the same however many candidates it sees, so there are no more tasks than run at a time
    candidates = rows.select("id", "label", "v").coalesce(spark.sparkContext.defaultParallelism)
    out = None
    for block in _passes(blocks):
        shared = spark.sparkContext.broadcast(block)
        found = _first_positives(candidates, shared, positives, scale).toArrow()  # at most ``positives`` rows for each anchor of the pass
        both = spark.sparkContext.broadcast(block | {"positives": _windows(found, block["n"], positives, low, high)})
        part = written(_first_negatives(candidates, both, negatives, low, high, scale))
        for used in (shared, both):
            used.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "anchor long, anchor_id long, positive_id long, positive_score long, id long, score long, rank int")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).distinct()


ORACLE_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER () AS anchor FROM (SELECT DISTINCT * FROM e WHERE id % 100 = 0)),
s AS (SELECT DISTINCT anchor, a.id AS anchor_id, e.id, a.label = e.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score FROM a JOIN e ON len(a.q) = len(e.q)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same AND id <> anchor_id) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, place ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT DISTINCT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
