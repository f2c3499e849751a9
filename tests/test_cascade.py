import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesieve.operators import blocklist, report
from lakesieve.operators.cascade import cascade, chosen, strong, verdict_columns, weak
from lakesieve.operators.stages import BlocklistStage, ClassifierStage, JudgeStage, ModelStage, chat_messages, judged_by_scores, parse_completion

WORDS = ["apple", "Apple", "pear", "pearls", "fig"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def judged(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_refine_guards_nan_null_equal_and_relevance(spark):
    rows = [("a", 0.9, True), ("b", 0.4, True), ("c", math.nan, True), ("d", None, True), ("e", 0.5, None), ("f", 0.5, False), ("a", 0.9, True), ("A", 0.41, True)]
    table = spark.createDataFrame(rows, "keyword string, pos_ratio double, is_relevant boolean")
    assert blocklist.keyword_list(blocklist.refine(table)) == ["A", "a"]
    assert blocklist.keyword_list(blocklist.refine(table, None)) == ["A", "a", "b", "c", "d"]
    assert blocklist.keyword_list(blocklist.refine(table.drop("is_relevant"))) == ["A", "a", "e", "f"]
    assert blocklist.refine(table.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
@pytest.mark.parametrize("extra", [0, 40])
def test_blocklist_verdicts(spark, threshold, extra):
    words = sorted(WORDS + [f"zz{i}zz" for i in range(extra)])
    texts = ["", None, "an APPLE", "pearls", "nothing here", "apple fig pear", "ÄPFEL", "fig"]
    got = judged(docs(spark, texts).select("id", blocklist.verdict(F.col("text"), words, threshold).alias("v")).select("id", "v.should_filter", "v.metadata.keywords"), "should_filter", "keywords")
    for i, text in enumerate(texts):
        found = [w for w in words if text is not None and w.lower() in text.lower()]
        most = max(threshold, 1)
        assert got[i] == (threshold >= 1 and len(found) >= threshold, ", ".join(found[:most]))


def test_empty_blocklist_flags_nothing(spark):
    assert judged(cascade(docs(spark, ["a", None]), strong([])), "combined_filter") == {0: (False,), 1: (False,)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="apelrs fig", max_size=30), max_size=5))
def test_combined_is_the_conjunction(spark, texts):
    scorer = lambda tokens: F.size(F.filter(tokens, lambda w: F.contains(w, F.lit("g")))) / F.size(tokens)
    out = cascade(docs(spark, texts), weak(WORDS, ClassifierStage(scorer, 0.2, 3), 1)).collect() if texts else []
    for r in out:
        found = any(w.lower() in r["text"].lower() for w in WORDS)
        parts = r["text"].split()
        chunks = [parts[k : k + 3] for k in range(0, len(parts), 3)]
        over = not chunks or any(sum("g" in w for w in c) / len(c) > 0.2 for c in chunks)
        assert r["word_filter"] == found and r["bert_filter"] == (found and over) and r["combined_filter"] == (found and over)


def test_scores_at_the_threshold_nan_and_failure(spark):
    rows = [(0, [0.5]), (1, [0.5, 0.51]), (2, [math.nan]), (3, []), (4, None), (5, [0.9, None])]
    df = spark.createDataFrame(rows, "id long, _scores array<double>")
    default = ClassifierStage(None).default_metadata
    got = judged(judged_by_scores(df, 0.5, default()), "_should")
    assert got == {0: (False,), 1: (True,), 2: (False,), 3: (True,), 4: (True,), 5: (True,)}


def test_gate_calls_the_costly_stage_for_escalated_rows_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            seen.add(len(texts))
            return [0.9 if "fig" in t else 0.1 for t in texts]

        return model

    out = cascade(docs(spark, ["apple", "fig apple", "none", "figs"]), [BlocklistStage(["apple"], 1), ModelStage(load)])
    assert judged(out, "bert_filter") == {0: (False,), 1: (True,), 2: (False,), 3: (False,)}
    assert seen.value == 2


@pytest.mark.parametrize("gated", [True, False])
def test_three_stages_judge_each_escalated_row_once(spark, gated):
    models, judges = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            models.add(len(texts))
            return [0.9 if "fig" in t else 0.1 for t in texts]

        return model

    def connect():
        def client(messages):
            judges.add(1)
            return "[1]" if "ripe" in messages[-1]["content"] else "[0]"

        return client

    class Plain:  # a stage that doesn't know of gates
        name = "lm_filter"

        def __init__(self, stage):
            self.stage = stage

        def default_metadata(self):
            return self.stage.default_metadata()

        def judge(self, docs):
            return self.stage.judge(docs)

    texts = ["apple"] * 4 + ["apple fig"] * 3 + ["apple fig ripe"] * 3 + ["none", "fig", "ripe", None]
    judge = JudgeStage(connect) if gated else Plain(JudgeStage(connect))
    out = cascade(docs(spark, texts), [BlocklistStage(["apple"], 1), ModelStage(load), judge])
    got = judged(out, "word_filter", "bert_filter", "lm_filter", "combined_filter", "lm_filter_metadata")
    assert models.value == 10 and judges.value == 6
    for i, t in enumerate(texts):
        word = "apple" in (t or "")
        bert = word and "fig" in t
        lm = bert and "ripe" in t
        assert got[i][:4] == (word, bert, lm, lm)
        assert (got[i][4]["completion"] == "") == (not bert)


def test_judge_options(spark):
    def connect():
        return lambda messages, max_new_tokens: f"[{max_new_tokens}]"

    assert cascade(docs(spark, ["a"]), [JudgeStage(connect, max_new_tokens=1)]).first()["lm_filter"]
    assert not cascade(docs(spark, ["a"]), [JudgeStage(connect, max_new_tokens=0)]).first()["lm_filter"]
    warm = JudgeStage(lambda: lambda messages, temperature, model: f"{model} [{temperature}]", options={"temperature": 0, "model": "m1"})
    assert cascade(docs(spark, ["a"]), [warm]).first()["lm_filter_metadata"]["completion"] == "m1 [0]"


def test_keywords_that_are_empty_or_lower_alike(spark):
    df = docs(spark, ["Fig tree", "", None, "x"])
    found = judged(df.select("id", blocklist.hits(F.col("text"), ["", "FIG", "fig", "tree"], 9).alias("h")), "h")
    assert found == {0: (["", "FIG", "fig", "tree"],), 1: ([""],), 2: ([],), 3: ([""],)}


def test_model_failure_fails_closed(spark):
    def load():
        raise RuntimeError("no model")

    got = cascade(docs(spark, ["a"]), [ModelStage(load)]).first()
    assert got["bert_filter"] and got["bert_filter_metadata"]["highest_score"] == 0.0


def test_failures_are_counted_by_kind(spark):
    def load():
        def model(parts):
            if "bad" in parts[0]:
                raise KeyError("word")
            return [0.9 if "flag" in p else 0.1 for p in parts]

        return model

    def broken():
        raise OSError("no weights: none")

    def connect():
        def client(messages):
            if "down" in messages[-1]["content"]:
                raise TimeoutError("late")
            return "maybe"

        return client

    texts = ["fine", "bad one", "", None, "flag down", "flag", "bad down"]
    out = cascade(docs(spark, texts), [ModelStage(load), JudgeStage(connect)])
    kinds = {(r["stage"], r["kind"]): r["n"] for r in report.failures_by_kind(out).collect()}
    assert kinds == {("bert_filter", "KeyError"): 2, ("bert_filter", "no tokens"): 2, ("lm_filter", "TimeoutError"): 2, ("lm_filter", "no digit in the completion"): 3, ("lm_filter", "TypeError"): 1}  # a null text is no text to look in
    assert tuple(report.failures(out).first()) == (10, 7)
    never = cascade(docs(spark, ["a", "b"]), [ModelStage(broken)])
    assert [tuple(r) for r in report.failures_by_kind(never).collect()] == [("bert_filter", "OSError", 2)] and never.first()["bert_filter_metadata"]["error"] == "OSError: no weights: none"
    words = cascade(docs(spark, ["a"]), [BlocklistStage(["a"], 1)])
    assert report.failures_by_kind(words).collect() == [] and tuple(report.failures(words).first()) == (0, 1)


def test_judge(spark):
    def connect():
        def client(messages):
            text = messages[-1]["content"]
            if text == "boom":
                raise ValueError("down")
            return {"yes": "so [1]", "no": "[0]"}.get(text, "nothing")

        return client

    out = cascade(docs(spark, ["yes", "no", "boom", "odd", "yes Now that you've seen the example, no"]), [JudgeStage(connect)])
    got = judged(out, "lm_filter", "lm_filter_metadata")
    assert [got[i][0] for i in range(5)] == [True, False, True, True, True]
    assert got[2][1]["error"] == "ValueError: down" and got[0][1]["error"] is None and got[3][1]["error"]


def test_completions(spark):
    cases = {"[1]": True, "[0]": False, "a [0] b [1": True, "12": True, "no digit": True, "": True, "[2]": False}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", parse_completion(F.col("c"))["judgment"].alias("j"))
    assert {r["c"]: r["j"] for r in df.collect()} == cases
    assert spark.range(1).select(parse_completion(F.lit(None).cast("string"))["judgment"].alias("j")).first()["j"] is True


def test_messages_and_skips(spark):
    prefix = [{"role": "system", "content": "x"}, {"role": "user", "content": "y"}]
    m = docs(spark, ["t"]).select(chat_messages(F.col("text"), prefix).alias("m")).first()["m"]
    assert [(r["role"], r["content"]) for r in m] == [("system", "x"), ("user", "y"), ("user", "t")]
    assert chosen([None, "SKIP", "skip"]) == []
    assert judged(cascade(docs(spark, ["t"]), ["skip"]), "combined_filter") == {0: (False,)}
    out = cascade(docs(spark, ["t"]).withColumn("is_filter_target", F.lit(True)), strong(["t"], 1))
    assert verdict_columns(out).columns == ["id", "is_filter_target", "word_filter", "word_filter_metadata", "combined_filter"]
