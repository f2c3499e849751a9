"""Stratified samples and languages against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakesieve import queries as q
from lakesieve.operators import language, samples


@pytest.mark.parametrize("spare,more,groups", [(4, 40, 100_000), (0, 1, 2)])
def test_stratified_equals_brute_force(spark, monkeypatch, spare, more, groups):
    monkeypatch.setattr(samples, "GROUPS", groups)
    monkeypatch.setattr(samples, "SPARE", spare)
    monkeypatch.setattr(samples, "MORE", more)
    r = random.Random(2)
    rows = [(k, r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([1, None])) for k in range(600)] + [(None, "nulls", k) for k in range(30)] + [(7, "same", 1)] * 9 + [(1, "one", 1)]
    df = spark.createDataFrame(rows, "k int, g string, x int").repartition(5)
    out = samples.stratified(df, ["g"], 6, ["k"], seed=9)
    got = Counter((x["k"], x["g"]) for x in out.collect())
    groups = defaultdict(list)
    for k, g, _ in rows:
        groups[g].append((hashlib.md5(f"9:{'' if k is None else k}".encode()).hexdigest(), k))
    want = Counter((k, g) for g, own in groups.items() for _, k in sorted(own, key=lambda x: x[0])[:6])
    assert got == want and out.columns == ["k", "g", "x"]
    again = samples.stratified(df.repartition(2, "x"), ["g"], 6, ["k"], seed=9)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))
    assert samples.stratified(df.limit(0), ["g"], 6, ["k"]).collect() == [] and samples.stratified(df, [], 5, ["k"]).count() == 5
    assert samples.stratified(df, ["g", "x"], 1, ["k"]).count() == len({(g, x) for _, g, x in rows})


def grams(text):
    return [f" {w} "[i : i + 3] for w in (text or "").lower().split() for i in range(len(w))]


def brute_profiles(rows, per_language, most):
    chosen = defaultdict(list)
    for k, text, lang in rows:
        if text is not None and lang is not None:
            chosen[lang].append((hashlib.md5(f"42:{k}".encode()).hexdigest(), text))
    out = {}
    for lang, own in sorted(chosen.items()):
        counts = Counter(g for _, t in sorted(own)[:per_language] for g in grams(t))
        total = sum(counts.values()) + most
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
        if counts:
            out[lang] = ({g: math.log(n + 1) - math.log(total) for g, n in top}, -math.log(total))
    return out


def test_language_equals_brute_force(spark):
    r = random.Random(3)
    alphabet = {"x": "abcde", "y": "defgh", "z": "éàü日x"}
    rows = [(k, " ".join("".join(r.choice(alphabet[lang]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 30))), lang) for k in range(90) for lang in [r.choice("xyz")]]
    rows += [(100, None, "x"), (101, "", "y"), (102, " \n\t", None), (103, "abc DEF", None), (104, "q", "z"), (105, "a b", None), (105, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(4)
    profiles = language.learn(df, per_language=10, most=15)
    want = brute_profiles(rows, 10, 15)
    assert profiles.languages == list(want)
    got = Counter((x["doc_id"], x["language"], None if x["margin"] is None else round(x["margin"], 9)) for x in language.identify(df, profiles).collect())
    expected = Counter()
    for k, text, _ in rows:
        found = grams(text)
        scores = sorted((-sum(table.get(g, unseen) for g in found), lang) for lang, (table, unseen) in want.items())
        expected[(k, scores[0][1], round((scores[1][0] - scores[0][0]) / len(found), 9)) if found else (k, None, None)] += 1
    assert got == expected
    none = language.learn(df.limit(0))
    assert none.languages == [] and {x["language"] for x in language.identify(df, none).collect()} == {None}
    assert language.identify(df.limit(0), profiles).collect() == []


def test_languages_of_held_out_documents(spark, sf):
    out = q.language_of_documents(spark, sf).where("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("language")).alias("right")).first()
    assert out["n"] > 40 and out["right"] >= 0.9 * out["n"]
