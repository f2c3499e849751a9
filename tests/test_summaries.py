"""Sketches, grouping sets over moments, and QR spectra."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesieve.operators import evals, linalg, sketches

P = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]


def chunk_rows(seed, n):
    r = random.Random(seed)
    return [(f"c{k % 5}", r.choice(["hot", "hot", "cold", None]), r.choice([None, float("nan"), r.gauss(0, 1), r.gauss(0, 1), 7.0]), f"item {r.randrange(n)}" if r.random() < 0.9 else None) for k in range(n)]


def exact(rows):
    values = sorted(x[2] for x in rows if x[2] is not None and not math.isnan(x[2]))
    return len(rows), values, len({x[3] for x in rows if x[3] is not None})


def close(row, rows):
    n, values, items = exact(rows)
    assert row["n"] == n and row["n_values"] == len(values) and row["low"] == values[0] and row["high"] == values[-1]
    for p, q in zip(P, row["quantile_values"], strict=True):
        below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
        assert below - sketches.QUANTILE_ERROR <= p <= upto + sketches.QUANTILE_ERROR
    assert abs(row["n_distinct"] - items) <= sketches.DISTINCT_ERROR * items


def test_any_set_of_chunks_merges_within_the_bounds(spark, tmp_path):
    rows = chunk_rows(1, 30_000)
    df = spark.createDataFrame(rows, "chunk string, source string, x double, item string").repartition(6)
    path = str(tmp_path / "sketches")
    for c in range(5):
        assert sketches.add_chunk(df.where(F.col("chunk") == f"c{c}"), path, f"c{c}", ["source"], "x", "item")
    for chosen in (["c0"], ["c1", "c3", "c4"], None):
        mine = [r for r in rows if chosen is None or r[0] in chosen]
        by = {r["source"]: r for r in sketches.summary(sketches.merged(sketches.stored(spark, path, chosen), ["source"]), P).collect()}
        assert set(by) == {"hot", "cold", None}
        for source, row in by.items():
            close(row, [r for r in mine if r[1] == source])
        close(sketches.summary(sketches.merged(sketches.stored(spark, path, chosen), []), P).first(), mine)
    ranks = sketches.rank_of(sketches.merged(sketches.stored(spark, path), []), 0.0).first()["rank"]
    values = exact(rows)[1]
    assert abs(ranks - sum(v <= 0 for v in values) / len(values)) < sketches.QUANTILE_ERROR
    pairs = sketches.shared_items(sketches.merged(sketches.stored(spark, path), ["source"]).na.fill({"source": "none"}), "source").collect()
    items = lambda s: {r[3] for r in rows if (r[1] or "none") == s and r[3] is not None}
    assert len(pairs) == 3 and all(abs(r["n_shared"] - len(items(r["first"]) & items(r["second"]))) < 0.05 * len(items(r["first"]) | items(r["second"])) for r in pairs)


def test_a_stored_chunk_is_not_read_again(spark, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y")], "source string, x double, item string")
    broken = df.withColumn("x", F.raise_error(F.lit("read")).cast("double"))
    assert sketches.add_chunk(df, path, "one", ["source"], "x", "item")
    assert not sketches.add_chunk(broken, path, "one", ["source"], "x", "item")
    with pytest.raises(Exception, match="read"):
        sketches.add_chunk(broken, path, "two", ["source"], "x", "item")
    assert sketches.add_chunk(df, path, "two", ["source"], "x", "item")
    assert sketches.summary(sketches.merged(sketches.stored(spark, path), ["source"]), [0.5]).first()["n"] == 4


def test_groups_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None), ("a", float("nan"), None), ("b", 2.0, "x"), ("b", 2.0, "x")], "source string, x double, item string")
    out = sketches.summary(sketches.merged(sketches.sketched(df, ["source"], "x", "item"), ["source"]), [0.5])
    by = {r["source"]: r for r in out.collect()}
    assert (by["a"]["n"], by["a"]["n_values"], by["a"]["low"], by["a"]["quantile_values"], by["a"]["n_distinct"]) == (2, 0, None, None, 0)
    assert by["b"]["quantile_values"] == [2.0] and by["b"]["n_distinct"] == 1
    assert sketches.merged(sketches.sketched(df.limit(0), ["source"], "x", "item"), ["source"]).collect() == []


def brute_accuracy(data):
    """(subset, category) -> n, mean, error; groups pool their leaves."""
    leaves = {}
    for s, c, x in data:
        leaves.setdefault((s, c), []).append(x)
    leaves = {k: [x for x in v if x is not None] for k, v in leaves.items()}

    def pooled(keys):
        own = [leaves[k] for k in keys]
        n, k = sum(map(len, own)), len(own)
        spread = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in own if v)
        return n, sum(map(sum, own)) / n if n else None, math.sqrt(spread / ((n - k) * n)) if n > k else None

    out = [(s, c, 0, *pooled([(s, c)])) for s, c in leaves]
    out += [(s, None, 1, *pooled([k for k in leaves if k[0] == s])) for s in {k[0] for k in leaves}]
    return [*out, (None, None, 2, *pooled(list(leaves)))]


def test_nested_accuracy_equals_brute_force_in_one_scan(spark, sf):
    r = random.Random(4)
    data = [(r.choice(["robust", "shortcut", None]), r.choice(["a", "b", None]), r.choice([0.0, 1.0, 1.0, None])) for _ in range(200)] + [("robust", "single", 1.0), ("robust", "nothing", None)]
    out = evals.nested_accuracy(spark.createDataFrame(data, "subset string, category string, acc double").repartition(3))
    plain = lambda x: None if x is None else round(x, 9)
    got = sorted(((x["subset"], x["category"], x["level"], x["n"], plain(x["acc"]), plain(x["stderr"])) for x in out.collect()), key=repr)
    assert got == sorted(((*x[:4], plain(x[4]), plain(x[5])) for x in brute_accuracy(data)), key=repr)
    items = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("subset"), F.col("lang").alias("category"), (F.col("n_chars") % 2).cast("double").alias("acc"))
    plan = evals.nested_accuracy(items)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    assert evals.nested_accuracy(spark.createDataFrame([], "subset string, category string, acc double")).collect() == []


@pytest.mark.parametrize("fan,parts", [(16, 4), (2, 9)])
def test_qr_spectra_equal_numpy_at_64(spark, monkeypatch, fan, parts):
    monkeypatch.setattr(linalg, "FAN", fan)
    r = np.random.default_rng(1)
    layers = {"wide": r.normal(size=(300, 64)), "short": r.normal(size=(20, 64)), "one": r.normal(size=(1, 3)), None: r.normal(size=(50, 8))}
    data = [(k, v.tolist()) for k, m in layers.items() for v in m] + [("wide", None), ("one", [])]
    df = spark.createDataFrame(data, "layer string, x array<double>").repartition(parts)
    got = {x["layer"]: x for x in linalg.spectrum(df).collect()}
    for k, m in layers.items():
        want = np.linalg.svd(m, compute_uv=False)
        values = np.array(got[k]["singular_values"])
        assert got[k]["hidden_dim"] == m.shape[1] == len(values) and np.allclose(values[: len(want)], want, rtol=1e-10) and (values[len(want) :] < 1e-10).all()
        assert got[k]["n_samples"] == len(m) + (k == "one") and np.allclose(got[k]["top5"], want[:5].tolist() + [0] * (min(5, m.shape[1]) - len(want[:5])), atol=1e-10)


def test_qr_keeps_small_values_that_a_gram_matrix_loses(spark):
    r = np.random.default_rng(2)
    u, _ = np.linalg.qr(r.normal(size=(400, 6)))
    v, _ = np.linalg.qr(r.normal(size=(6, 6)))
    want = np.array([1.0, 1e-2, 1e-5, 1e-8, 1e-10, 1e-12])
    x = u * want @ v.T
    df = spark.createDataFrame([("l", row.tolist()) for row in x], "layer string, x array<double>").repartition(5)
    got = np.array(linalg.spectrum(df).first()["singular_values"])
    assert np.allclose(got, want, rtol=1e-2, atol=0)
    assert not np.allclose(np.sqrt(np.clip(np.linalg.eigvalsh(x.T @ x), 0, None))[::-1], want, rtol=1e-1, atol=0)


def test_checkpointed_spectra_equal_numpy(spark):
    r = np.random.default_rng(3)
    x, batch, layer = r.normal(size=(120, 7)), r.integers(1, 12, 120), r.choice(["a", "b"], 120)
    df = spark.createDataFrame([(str(k), int(b), v.tolist()) for k, b, v in zip(layer, batch, x, strict=True)], "layer string, batch int, x array<double>").repartition(4)
    got = {(y["layer"], y["checkpoint"]): y for y in linalg.checkpointed_spectrum(df, "batch", [1, 4, 9]).collect()}
    for name in "ab":
        for c in (1, 4, 9):
            m = x[(layer == name) & (batch <= c)]
            want = np.linalg.svd(m, compute_uv=False)
            assert got[name, c]["n_samples"] == len(m) and np.allclose(got[name, c]["singular_values"][: len(want)], want)
