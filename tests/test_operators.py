import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesieve.functions import text as text_functions
from lakesieve.functions import vectors
from lakesieve.operators import assemble, evals, linalg, report, rows, tokens


def test_assembly_partitions_the_judged_base_and_takes_null_ids(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "id long, text string")
    verdicts = spark.createDataFrame([(1, True), (2, False), (3, False), (None, True)], "id long, combined_filter boolean")
    ids = lambda df: sorted(r["id"] or -1 for r in df.collect())
    assert ids(assemble.retained(base, verdicts)) == [2, 3]
    assert ids(assemble.removed(base, verdicts)) == [1]
    assert ids(assemble.retained(base, verdicts, keep_unjudged=True)) == [-1, 2, 3, 4]
    assert assemble.check_coverage(base, verdicts)["status"] == "partial"
    with pytest.raises(ValueError):
        assemble.check_coverage(verdicts, base)
    stats = assemble.assembly_stats(base.limit(0), verdicts, base.limit(0)).first()
    assert stats["retention_percentage"] is None


def test_insert_synthesises_ids_and_sources(spark):
    base = spark.createDataFrame([(1, "x")], "id long, text string")
    extra = spark.createDataFrame([("b",), ("a",)], "text string")
    out = assemble.insert(base, extra, "more", "text", seed=None)
    assert {(r["id"], r["source"], r["text"]) for r in out.collect()} == {("1", None, "x"), ("more-0", "more", "a"), ("more-1", "more", "b")}


@pytest.mark.parametrize("labels", [[True, False], [True], [False]])
def test_confusion_has_all_cells_with_one_class_too(spark, labels):
    data = [(p, a) for a in labels for p in (True, False, True)]
    c = report.confusion(spark.createDataFrame(data, "p boolean, a boolean"), "p", "a").first()
    assert c["tp"] == 2 * labels.count(True) and c["fn"] == labels.count(True) and c["fp"] == 2 * labels.count(False) and c["tn"] == labels.count(False)
    assert c["percent_filtered"] == pytest.approx(2 / 3)


def test_reports_on_empty_input(spark):
    empty = spark.createDataFrame([], "p boolean, a boolean")
    assert report.confusion(empty, "p", "missing").first()["n"] == 0
    assert {r["f1"] for r in report.class_report(empty, "p", "a").collect()} == {0.0}


@pytest.mark.parametrize("target, index, reached", [(1, 0, True), (5, 1, True), (6, 2, True), (9, 2, True), (10, 2, False)])
def test_budget(spark, target, index, reached):
    counts = spark.createDataFrame([(3, 4), (1, 2), (2, 3)], "id long, num_tokens int")
    got = tokens.budget_cut(counts, target, ["id"]).first()
    assert (got["final_index"], got["reached_target_token_count"], got["num_docs"]) == (index, reached, index + 1)


@pytest.mark.parametrize("length", [1, 3, 4, 7, 100])
def test_packing_is_the_token_stream(spark, length):
    texts = ["a b c d e f g h i", "", "j", None, "k l"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    stream = [t for x in texts for t in ["<eos>", *(x or "").split()]]
    got = [r["input_ids"] for r in tokens.pack(df, length, ["id"]).orderBy("seq_id").collect()]
    assert got == [stream[k : k + length] for k in range(0, len(stream) - length + 1, length)]


def test_packing_keeps_rows_without_an_id_and_those_that_share_one(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (None, "g h i"), (2, "j k l")], "id long, text string")
    got = [r["input_ids"] for r in tokens.pack(df, 4, ["id"]).orderBy("seq_id").collect()]
    assert got[0] == ["<eos>", "g", "h", "i"] and got[3] == ["<eos>", "j", "k", "l"]
    assert sorted(got[1:3]) == [["<eos>", "a", "b", "c"], ["<eos>", "d", "e", "f"]]
    sums = rows.running_sum(df, F.lit(2).cast("bigint"), ["id"], "r").select("text", "r").collect()
    assert sorted(r["r"] for r in sums) == [2, 4, 6, 8] and {r["text"]: r["r"] for r in sums}["g h i"] == 2
    assert rows.running_sum(df.limit(0), F.lit(2).cast("bigint"), ["id"], "r").count() == 0


def test_row_numbers_by_group(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), (None, 9), ("a", 2), (None, 4)], "g string, v int").repartition(3)
    got = {(r["g"], r["v"]): r["id"] for r in rows.row_index(df, "v", "id", ["g"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 0, (None, 4): 0, (None, 9): 1}
    assert sorted(r["i"] for r in rows.row_index(df, ["v", "g"], "i").collect()) == list(range(6))


def test_rows_that_tie_or_repeat_are_numbered_each_and_no_text_is_written(spark):
    from lakesieve.sources import shared

    data = [(None, "x", None), (1, None, "x"), (1, "x", None), (1, "x", None), (1, "x", None), (1, "y", None), (2, "long text " * 50, "z")] + [(3, f"tie {k}", "s") for k in range(40)]
    df = spark.createDataFrame(data, "k int, text string, other string").repartition(5)
    shared.discard(spark)
    got = [(r["k"], r["text"], r["other"], r["i"]) for r in rows.row_index(df, "k", "i").collect()]
    tables = shared._TABLES[spark.sparkContext.applicationId]
    assert len(tables) == 1 and not {"text", "other"} & set(spark.read.parquet(tables[0]).columns) and "string" not in dict(spark.read.parquet(tables[0]).dtypes).values()
    assert sorted((r[:3] for r in got), key=repr) == sorted(data, key=repr) and sorted(r[3] for r in got) == list(range(len(data)))
    by = sorted(got, key=lambda r: r[3])
    assert [r[0] for r in by] == sorted((r[0] for r in data), key=lambda x: (x is not None, x or 0)) and sorted(r[3] for r in got if r[:3] == (1, "x", None)) == [r[3] for r in by if r[:3] == (1, "x", None)]
    sums = sorted((r["s"], r["k"]) for r in rows.running_sum(df, F.coalesce("k", F.lit(5)), ["k"], "s").collect())
    assert sums[0] == (5, None) and sums[-1][0] == 5 + 5 + 2 + 120 and sums[1:6] == [(6, 1), (7, 1), (8, 1), (9, 1), (10, 1)]


def test_large_limits_go_by_number(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("id"), F.lit("t").alias("text")).repartition(6)
    want = list(range(30))
    for few in (10_000, 5):
        monkeypatch.setattr(rows, "FEW", few)
        assert sorted(r["id"] for r in rows.first_rows(df, "id", 30).collect()) == want and rows.first_rows(df, "id", 30).columns == ["id", "text"]
        assert rows.first_rows(df, "id", 1000).count() == 100 and rows.first_rows(df.limit(0), "id", 30).count() == 0


@pytest.mark.parametrize("target", [0, 1, 7, 8, 9, 40, 41, 1000])
def test_budget_cut_with_repeated_and_empty_counts(spark, target):
    data = [(1, 0), (2, 4), (2, 4), (2, 4), (3, 0), (3, 0), (4, 9), (5, 20), (6, None)]
    counts = spark.createDataFrame(data, "id int, num_tokens int").repartition(4)
    running, hit = 0, None
    for k, (_, n) in enumerate(data):
        running += n or 0
        if hit is None and running >= target:
            hit = (k, running)
    got = tokens.budget_cut(counts, target, ["id"]).first()
    assert (got["final_index"], got["actual_token_count"], got["reached_target_token_count"]) == ((*hit, True) if hit else (8, 41, False))
    none = tokens.budget_cut(counts.limit(0), target, ["id"]).first()
    assert tuple(none) == (False, 0, 0, target, 0)


def test_gram_of_awkward_vectors(spark):
    data = [("l", [1.0, None, 2.0]), ("l", [3.0, 1.0]), ("l", []), (None, [2.0]), (None, [3.0])]
    got = {(r["layer"], r["i"], r["j"]): r["g"] for r in linalg.gram(spark.createDataFrame(data, "layer string, x array<float>")).collect()}
    assert got["l", 0, 0] == 10 and got["l", 0, 1] == 3 and got["l", 0, 2] == 2 and got["l", 1, 1] == 1 and got[None, 0, 0] == 13
    assert linalg.gram(spark.createDataFrame([], "layer string, x array<float>")).count() == 0
    wide = np.random.default_rng(1).normal(size=(5, 1100))
    cells = linalg.gram(spark.createDataFrame([("w", v.tolist()) for v in wide], "layer string, x array<double>")).toPandas()
    m = np.zeros((1100, 1100))
    m[cells["i"], cells["j"]] = cells["g"]
    assert len(cells) == 1100**2 and np.allclose(m, wide.T @ wide)


def test_spectra_at_checkpoints_equal_numpy(spark):
    x = np.random.default_rng(2).normal(size=(30, 4))
    df = spark.createDataFrame([("l" if k % 3 else None, v.tolist(), k // 5 + 1) for k, v in enumerate(x)], "layer string, x array<double>, batch int")
    points = linalg.checkpoint_schedule(6)
    for r in linalg.checkpointed_spectrum(df, "batch", points).collect():
        own = np.array([v for k, v in enumerate(x) if k // 5 + 1 <= r["checkpoint"] and ("l" if k % 3 else None) == r["layer"]])
        s = np.linalg.svd(own, compute_uv=False)
        assert r["n_samples"] == len(own) and np.allclose(r["singular_values"][: len(s)], s) and r["hidden_dim"] == 4


def test_articles_padded_to_a_length(spark):
    df = spark.createDataFrame([("t", "a b", "c"), ("t", None, "c"), ("t " * 5, "a", "b")], "title string, abstract string, text string")
    got = [tuple(r) for r in tokens.max_length_articles(df, 5).select("input_ids", "attention_mask", "labels").collect()]
    assert got[0] == (["t", "a", "b", "c", "<pad>"], [1, 1, 1, 1, 0], ["t", "a", "b", "c", "<pad>"]) and got[1] == (None, None, None)
    assert got[2][0] == ["t"] * 5 + ["a", "b"] and got[2][1] == [1] * 7


def test_templates_shots_and_limits(spark):
    templates = {"base": {"metric": "acc", "shots": 0}, "mid": {"include": "base", "shots": 5}, "leaf": {"include": "mid", "task": "x"}, "ring": {"include": "ring"}}
    assert evals.inherited(templates, "leaf") == {"metric": "acc", "shots": 5, "task": "x"} and evals.inherited(templates, "base") == templates["base"]
    with pytest.raises(ValueError):
        evals.inherited(templates, "ring")
    df = spark.createDataFrame([(1, "Q1", "A", "s", "robust"), (2, "Q2", "B", "s", "shortcut"), (3, "Q3", "C", "t", "robust")], "id int, prompt string, answer string, category string, subset string")
    assert [r["id"] for r in evals.selected(df, subset="robust", category="t").collect()] == [3]
    assert evals.few_shot(df, df, "prompt", "answer", 2, "id").orderBy("id").first()["prompt"] == "Q1 A\n\nQ2 B\n\nQ1"
    assert evals.few_shot(df, df, "prompt", "answer", 0, "id") is df and evals.limited(df, None, "id") is df
    assert sorted(r["id"] for r in evals.limited(df, 1, "id", ["category"]).collect()) == [1, 3] and evals.limited(df, 2, "id").count() == 2
    with pytest.raises(ValueError):
        rows.grid(df, df, most=8)


def test_formats(spark):
    got = spark.range(1).select(
        text_functions.replaced(F.lit("a/b/c"), ("/", "-"), ("b", "")).alias("r"), text_functions.decimals(F.lit(2.345), 1).alias("d"), text_functions.exponent(F.lit(1e-4)).alias("e"), text_functions.exponent(F.lit(250)).alias("h"), text_functions.exponent(F.lit(0)).alias("z"), text_functions.decimals(F.lit(0.125)).alias("t"),
        *[text_functions.ceil_div(F.lit(n), 4).alias(f"c{n}") for n in (0, 1, 4, 5)],
    ).first()
    assert tuple(got) == ("a--c", "2.3", "1e-04", "2e+02", "0e+00", "0.12", 0, 1, 1, 2)


def test_chunks_pad_and_bound(spark):
    df = spark.createDataFrame([(1, list(range(1, 8))), (2, []), (3, [9])], "id long, input_ids array<int>")
    got = [(r["id"], r["chunk"], r["input_ids"], r["attention_mask"], r["labels"], r["token_type_ids"]) for r in tokens.chunk_pad(df, 3, 2).orderBy("id", "chunk").collect()]
    assert got == [(1, 0, [1, 2, 3], [1, 1, 1], [1, 2, 3], [0, 0, 0]), (1, 1, [4, 5, 6], [1, 1, 1], [4, 5, 6], [0, 0, 0]), (3, 0, [9, 0, 0], [1, 0, 0], [9, -100, -100], [0, 0, 0])]


def test_epochs_batches_and_a_tokenizer_outside_sql(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "id long, text string")
    counts = tokens.token_counts_by(df, lambda: lambda texts: [t.split() for t in texts])
    assert sorted((r["id"], r["num_tokens"]) for r in counts.collect()) == [(0, 2), (1, 0)]
    packed = spark.createDataFrame([(i, [i]) for i in range(5)], "seq_id long, input_ids array<long>")
    assert tokens.epochs(packed, 3).count() == 15
    assert [r["batch"] for r in tokens.batches(packed, 2).orderBy("seq_id").collect()] == [0, 0, 1, 1, 2]
    assert [r["id"] for r in tokens.within_budget(df, counts, 1, ["id"]).collect()] == [0]


def test_gram_and_spectrum_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame([("l", r.tolist()) for r in x] + [("l", None)], "layer string, x array<double>")
    m = np.zeros((5, 5))
    for r in linalg.gram(df).collect():
        m[r["i"], r["j"]] = r["g"]
    assert np.allclose(m, x.T @ x)
    s = linalg.spectrum(df).first()
    assert np.allclose(s["singular_values"], np.linalg.svd(x, compute_uv=False)) and s["n_samples"] == 40 and len(s["top5"]) == 5
    assert linalg.spectrum(df.limit(0)).collect() == [] and linalg.spectrum(spark.createDataFrame([("l", []), ("l", [])], "layer string, x array<double>")).first()["singular_values"] == []
    assert linalg.checkpoint_schedule(16) == [1, 2, 4, 5, 8, 11, 16] and linalg.checkpoint_schedule(0) == []


def test_losses(spark):
    a, b = np.array([1.0, 2.0, -1.0]), np.array([0.5, 2.0, 3.0])
    df = spark.createDataFrame([("l", a.tolist(), b.tolist())], "layer string, student array<double>, teacher array<double>")
    cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    r = linalg.layer_losses(df).first()
    assert r["mse"] == pytest.approx(((a - b) ** 2).mean()) and r["cos_cubed"] == pytest.approx((1 - cos) ** 3)
    assert r["cos_30"] == pytest.approx(30 * (1 - cos)) and r["cos_cubed_10"] == pytest.approx(10 * (1 - cos) ** 3)
    soft = lambda v: np.exp(v / 2) / np.exp(v / 2).sum()
    kl = df.select(vectors.distillation(F.col("student"), F.col("teacher")).alias("k")).first()["k"]
    assert kl == pytest.approx(4 * (soft(b) * np.log(soft(b) / soft(a))).sum())


def test_scores_ties_and_length_normalisation(spark):
    rows_ = [(0, [-1.0, -1.0], ["a", "bb"], 0), (1, [-3.0, -4.0], ["x", "yyyyyyyy"], 1), (2, [], [], 0)]
    df = spark.createDataFrame(rows_, "id int, loglik array<double>, choices array<string>, answer int")
    assert [(r["acc"], r["acc_norm"]) for r in evals.scored(df).orderBy("id").collect()] == [(1.0, 0.0), (0.0, 1.0), (None, None)]
    with pytest.raises(TypeError):
        evals.check_choices(df.withColumn("choices", F.lit("['a']")))


def test_pooled_errors(spark):
    df = spark.createDataFrame([("t", 811, 0.2651, 0.01551), ("u", 811, 0.27127, 0.01562), ("v", 811, 0.27127, 0.01562)], "task string, n long, acc double, stderr double")
    got = evals.group_accuracy(df, []).first()
    assert got["acc"] == pytest.approx(0.26921, abs=1e-5) and got["stderr"] == pytest.approx(0.0089977, abs=5e-6)
    one = spark.createDataFrame([("t", 1.0)], "task string, acc double")
    assert evals.task_accuracy(one, ["task"]).first()["stderr"] is None


def test_sample_log(spark, tmp_path):
    row = {"doc_id": 0, "doc": {"options": "['a', 'b']"}, "target": "1", "filtered_resps": [["-2.5", "False"], ["-1.5", "True"]], "acc": 1.0}
    (tmp_path / "log.jsonl").write_text(json.dumps(row) + "\n")
    got = evals.from_log(spark.read.schema(evals.LOG_SCHEMA).json(str(tmp_path))).first()
    assert got["acc"] == got["logged_acc"] == 1.0 and got["choices"] == ["a", "b"]


def test_order_keys(spark):
    names = spark.createDataFrame([("layers.10.mlp",), ("layers.2.attn",), ("embed",), ("layers.2.mlp",), ("layers.6.x",)], "name string")
    assert [r["name"] for r in names.orderBy(*rows.layer_order(F.col("name"))).collect()] == ["layers.2.attn", "layers.2.mlp", "layers.6.x", "layers.10.mlp", "embed"]
    assert {r["name"] for r in names.where(rows.kept_layers(F.col("name"))).collect()} == {"embed", "layers.6.x"}
    parts = spark.createDataFrame([("train[10%:20%]", "0"), ("train[2%:10%]", "10"), ("train[2%:10%]", "9")], "label string, rank string")
    assert [r["rank"] for r in parts.orderBy(*rows.chunk_order(F.col("label"), F.col("rank"))).collect()] == ["9", "10", "0"]


def test_text_functions(spark):
    df = spark.createDataFrame([("\t a b \n",), ("x" * 201,), (None,), ("",)], "t string")
    got = df.select(text_functions.strip(F.col("t")).alias("s"), text_functions.shortened(F.col("t")).alias("p"), F.size(text_functions.slices(text_functions.words(F.col("t")), 2)).alias("n")).collect()
    assert got[0]["s"] == "a b" and got[1]["p"] == "x" * 200 + "..." and [r["n"] for r in got] == [1, 1, 0, 0]
    assert spark.range(1).select(text_functions.article(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("x")).first()["x"] is None


def test_rethreshold_and_shortcuts(spark):
    v = spark.createDataFrame([(1, True, False, (0.5,)), (2, False, False, (0.0,)), (3, True, True, (math.nan,))], "id long, word_filter boolean, bert_filter boolean, bert_filter_metadata struct<highest_score:double>")
    assert [r["combined_filter"] for r in assemble.rethreshold(v, 0.5).orderBy("id").collect()] == [True, False, False]
    assert [r["bert_filter"] for r in assemble.rethreshold(v, 0.0, compat=True).orderBy("id").collect()] == [True, True, False]


def test_plans_read_only_what_they_use(spark, sf):
    from lakesieve import queries as q

    plan = q.row_ids(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
    assert os.path.exists(sf)
