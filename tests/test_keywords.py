"""The keyword join against brute force."""

import random

import numpy as np
import pytest

from lakesieve.operators import keywords


@pytest.mark.parametrize("bits,size,chunk", [(27, 5, 4 << 20), (16, 3, 50)])
def test_keyword_matches_equal_brute_force(spark, monkeypatch, bits, size, chunk):
    monkeypatch.setattr(keywords, "BITS", bits)
    monkeypatch.setattr(keywords, "GRAM", size)
    monkeypatch.setattr(keywords, "BYTES", chunk)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abAéß日 ") for _ in range(n))
    words = [word(r.randint(1, 9)) for _ in range(80)] + ["", "", None, "a", "A", "ABA", "Aba", "ende"]
    docs = [(k, word(r.randint(0, 60))) for k in range(60)] + [(None, "xx ABA yy"), (None, None), (61, None), (62, ""), (63, "das Ende"), (63, "das Ende"), (63, "kein"), (64, "ab" * 3000)]
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    k = spark.createDataFrame([(w, 1) for w in words], "keyword string, n int").repartition(2)
    want = [(i, w) for i, t in docs if t is not None for w in {w for w in words if w is not None} if w.lower() in t.lower()]
    got = [tuple(x) for x in keywords.keyword_matches(d, k).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 500
    assert keywords.keyword_matches(d.limit(0), k).collect() == [] and keywords.keyword_matches(d, k.limit(0)).collect() == []


def test_the_bitmap_has_every_gram(spark):
    words = spark.createDataFrame([(f"keyword {k}",) for k in range(500)], "keyword string").selectExpr("keyword", "lower(keyword) AS low")
    index = keywords._index(words)
    bits, grams = keywords._bitmap(index), np.array([r["gram"] for r in index.collect()])
    bit = grams & ((1 << keywords.BITS) - 1)
    assert len(grams) == 500 and ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all() and np.unpackbits(bits).sum() == len(set(bit.tolist()))
