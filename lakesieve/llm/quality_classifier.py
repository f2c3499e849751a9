"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks; each block is compressed with the dictionary built from good texts, with the one from bad
texts and with none.  The features are the normalised difference (bad - good) / plain of the summed sizes, for the
whole text and for its worst block, and the log of plain size / length, the text's compressibility without a
dictionary.  Logistic regression on these and their squares, fitted on labelled rows that the dictionaries haven't
seen, turns them into a calibrated score.  The README has the figures with and without the third feature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, project, written

#: Bound of the labelled sample: rows a class.  Whole texts of these are read, by the executors.
SAMPLE_ROWS = 1500
#: Bytes of each dictionary, of a block, and the compression level.
DICTIONARY, BLOCK, LEVEL = 112_640, 1024, 3


def held_out(doc_id: str = "doc_id"):
    """Rows of the held-out fold: crc32 of the id as text, modulo 3, is 1.  A null id is in the training fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def even_share(lengths: list[int], room: int = DICTIONARY) -> int:
    """The most bytes of each text, so that all of them together (with a line break each) fit into ``room``: short texts whole, the others alike."""
    left, share = room - len(lengths), 0
    for k, n in enumerate(sorted(lengths)):
        share = left // (len(lengths) - k)
        if n > share:
            break
        left -= n
        share = n
    return max(share, 1)


def piece(raw: bytes, share: int, mark: int) -> bytes:
    """``share`` bytes of a text in one piece, at a place that ``mark`` (any number) chooses; a shorter text whole."""
    at = mark % (len(raw) - share + 1) if len(raw) > share else 0
    return raw[at : at + share]


@dataclass(frozen=True)
class Model:
    """Dictionaries, the logistic weights and the features' means and scales: a few hundred KB, whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


class Measure:
    """Features of a text under a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for content in (good, bad):
            if content:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
            else:
                self.coders.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def __call__(self, text: str) -> tuple[float, ...]:
        raw = text.encode("utf-8", "replace")
        good = bad = plain = 0
        worst, blocks = math.inf, max(1, round(len(raw) / BLOCK))
        step = max(1, -(-len(raw) // blocks))
        for at in range(0, len(raw), step):
            block = raw[at : at + step]
            g, b = (len(c.compress(block)) for c in self.coders)
            p = len(self.plain.compress(block))
            good, bad, plain = good + g, bad + b, plain + p
            worst = min(worst, (b - g) / p)
        if not raw:
            return (0.0, 0.0, 0.0)
        return ((bad - good) / plain, worst, math.log(plain / len(raw)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weighted logistic regression with a ridge of ``ridge`` a row's mean weight; the last weight is the intercept, which the ridge spares.

    Newton's method, each step halved until the loss falls.  The loss is convex and the ridge keeps it from being
    flat, so it converges also where the classes can be separated; an error if it didn't.
    """
    x = np.c_[x, np.ones(len(x))]
    total = weight.sum()
    penalty = ridge * total * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    sign = 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, -sign * (x @ w)) + 0.5 * penalty @ w**2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        if np.abs(gradient).max() <= 1e-7 * total:
            return w
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12 * total), gradient)
        step = 1.0
        while (new := loss(w - step * move)) > now - 1e-4 * step * (gradient @ move) and step > 1e-10:
            step /= 2
        if step <= 1e-10 or now - new <= 1e-13 * abs(now):  # as low as doubles tell
            if np.abs(gradient).max() <= 1e-4 * total:
                return w
            break
        w, now = w - step * move, new
    raise RuntimeError("the calibration did not converge")


#: Ridges that the calibration chooses from, by the loss on the folds left out of its own rows.
RIDGES, FOLDS = (1e-2, 1e-3, 1e-4, 1e-5), 5


def _chosen_ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The ridge with the least log loss in cross-validation over the rows given; a fold that would leave one class only is skipped."""
    fold = np.empty(len(y), dtype=np.int64)
    for k in (0, 1):  # each class is spread over the folds
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    losses = []
    for ridge in RIDGES:
        total = 0.0
        for f in range(FOLDS):
            seen, left = fold != f, fold == f
            if len(np.unique(y[seen])) > 1 and left.any():
                w = _fit(x[seen], y[seen], weight[seen], ridge)
                total += float(weight[left] @ np.logaddexp(0, -(2 * y[left] - 1) * (x[left] @ w[:-1] + w[-1])))
        losses.append(total)
    return RIDGES[int(np.argmin(losses))]


def _terms(features: np.ndarray) -> np.ndarray:
    """The features and their squares: a text's difference is largest in the middle between plain prose and pure junk."""
    return np.c_[features, features**2]


def calibrated(good: bytes, bad: bytes, features: dict[int, list[tuple[float, ...]]], totals: dict[int, int]) -> Model:
    """The model of two dictionaries and the features of each class's calibration texts, weighed by the classes' rows (``totals``).

    With one class only, or no rows, the score is that class's smoothed share everywhere.
    """
    n = {k: len(features.get(k, [])) for k in (0, 1)}
    if not n[0] or not n[1]:
        odds = math.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
        return Model(good, bad, (0.0,) * 6 + (odds,), (0.0,) * 6, (1.0,) * 6)
    x = _terms(np.array([f for k in (0, 1) for f in features[k]]))
    y = np.r_[np.zeros(n[0]), np.ones(n[1])]
    centre, scale = x.mean(0), x.std(0) + 1e-9
    each = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    z, weight = (x - centre) / scale, each * len(y) / each.sum()
    w = _fit(z, y, weight, _chosen_ridge(z, y, weight))
    return Model(good, bad, tuple(w), tuple(centre), tuple(scale))


def scorer(model: Model):
    measure, w, centre, scale = Measure(model.good, model.bad), np.array(model.weights), np.array(model.centre), np.array(model.scale)

    def score(text: str) -> float:
        z = float(((_terms(np.array([measure(text)]))[0] - centre) / scale) @ w[:-1] + w[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample: of each class the ``rows`` training rows that come first by a hash of their id.

    ``docs``: doc_id, text (null: empty).  ``labels``: doc_id and the label (0 or 1; other values and null don't count;
    of several labels of an id the smallest holds); other columns are ignored, and of rows of ``docs`` that repeat an
    id the text with the least hash counts.  A hash of the id deals the sample's rows in halves: one makes the
    dictionaries, of which every text gets an even share, the other the calibration, whose whole texts the executors
    measure.  The sample's texts are written once to the shared folder.  The driver sees two class counts, at most
    two dictionaries of pieces, and one row of numbers a sampled text; the join broadcasts at most 2 * rows ids.
    """
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    mark = F.xxhash64("doc_id", F.lit(5))
    sample = written(found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "label", "text", F.shiftright(mark, 1).alias("mark"), (F.pmod(mark, F.lit(2)) == 0).alias("content")))

    content = sample.where("content")
    lengths: dict[int, list[int]] = {0: [], 1: []}
    for r in content.select("label", F.octet_length("text").alias("n")).collect():
        lengths[r["label"]].append(int(r["n"]))
    share = {k: even_share(v) if v else 1 for k, v in lengths.items()}

    def cut():
        def row(label, text, mark):
            yield label, mark, piece(text.encode("utf-8", "replace"), share[label], mark)

        return row

    pieces = sorted((r["label"], r["mark"], bytes(r["piece"])) for r in map_rows(content.select("label", "text", "mark"), cut, "label int, mark long, piece binary").collect())
    good, bad = (b"\n".join(x for label, _, x in pieces if label == k)[:DICTIONARY] for k in (1, 0))

    def measured():
        measure = Measure(good, bad)

        def row(label, text):
            yield label, list(measure(text))

        return row

    features: dict[int, list[tuple[float, ...]]] = {0: [], 1: []}
    for r in sorted(map_rows(sample.where("not content").select("label", "text"), measured, "label int, x array<double>").collect()):
        features[r["label"]].append(tuple(r["x"]))
    return calibrated(good, bad, features, totals)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5).

    Whole texts are scored, block by block; a null text counts as empty, and an empty one gets the score of zero
    differences.  Repeated rows are scored each, null ids are carried, other columns are ignored, an empty table gives
    no rows.  Narrow: the model travels with the tasks.
    """

    def make():
        score = scorer(model)

        def row(doc_id, held, text):
            value = score(text or "")
            yield doc_id, held, value, int(value >= 0.5)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    rows = project(docs, doc_id=id_col, text=text_col).select("doc_id", held_out().alias("held"), "text")
    return map_rows(rows, make, f"doc_id {kind}, held_out boolean, score double, predicted int")
