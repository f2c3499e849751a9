"""Hard negatives, record files and the source audit, against brute force, the library and SQL."""

import itertools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakesieve.llm import hard_negatives, queries, record_files, source_divergence

from ..oracle import connect, rows, same
from .cases import frame, prose, texts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def saved(df, folder, name):
    """The frame as a Parquet table, and a DuckDB connection that has it as a view."""
    df.write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return df.sparkSession.read.parquet(f"{folder}/{name}.parquet"), con


# --- op11


def brute_negatives(data, positives=5, negatives=10, low=30, high=90):
    """data: (id, label, vector) of rows that take part as they are."""
    fine = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in data if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, label, v in {(i, label, tuple(v)) for i, label, v in fine if i % 100 == 0}:
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))
        scored = {(-score(w), j, other == label) for j, other, w in fine if len(w) == len(v)}
        for s, j in sorted((s, j) for s, j, own in scored if own and j != i)[:positives]:
            fits = sorted((t, k) for t, k, own in scored if not own and low * -s <= 100 * -t <= high * -s)
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fits[:negatives], 1)}
    return sorted(out)


def vector_frame(spark, data):
    return spark.createDataFrame([(i, label, v, "clash", "clash", 1.5, "clash") for i, label, v in data], "vec_id long, label int, embedding array<float>, id string, v string, score double, anchor string")


def mined(df, **options):
    return hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), **options)


@pytest.mark.parametrize("anchors,tile", [(32_768, 512), (2, 3)])
def test_op11_equals_its_sql(spark, sf, monkeypatch, anchors, tile):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    same(queries.op11_hard_negatives(spark, sf), connect(sf), hard_negatives.ORACLE_SQL)


def test_op11_against_brute_force_with_ties_and_copies(spark):
    r = random.Random(5)
    data = [(i, r.randrange(3), [r.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(0, 900, 3)]
    data += [(i, 1, [1.0, 1.0, 0.5, 0.5]) for i in range(1000, 1400)]  # one very common vector
    data += [(i, 2, [0.5, 1.0, 0.5, 0.5]) for i in range(1400, 1800)]
    got = mined(vector_frame(spark, data).repartition(5)).collect()
    assert sorted(tuple(x) for x in got) == brute_negatives(data) and len(got) > 100


def test_op11_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [2.0, 1.0]), (1, 1, [1.0, 1.5]), (1, 1, [1.0, 1.5]), (1, 1, [1.0, 1.75]), (2, 1, [1.0, 1.0]), (3, 2, [0.5, 1.0]), (3, 2, [0.5, 1.0]), (4, 3, [0.5, 1.0]),
        (5, None, [0.5, 1.0]), (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [nan, 1.0]), (9, 2, [0.5, inf]), (None, 2, [0.5, 1.0]), (10, 2, [0.5]), (11, 2, []), (100, 2, []), (200, 5, [1.0, 1.0]), (300, 1, [-1.0, -2.0]),
        (400, 3, [0.0, 0.0]), (500, 1, [nan, 1.0]), (600, None, [1.0, 1.0]), (12, 2, [0.1, 0.7, 0.9]),
    ]
    out = mined(vector_frame(spark, data))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(x) for x in out.collect())
    assert got == brute_negatives(data) and {x[0] for x in got} >= {0, 400} and not {5, 6, 7, 8, 9, None} & {x[3] for x in got}
    assert mined(vector_frame(spark, [])).collect() == [] and mined(vector_frame(spark, [(1, 1, [1.0])])).collect() == []


def test_op11_refuses_what_it_can_not_tell_apart(spark):
    df = vector_frame(spark, [(0, 1, [3e6, 3e6]), (1, 1, [3e6, 3e6]), (2, 2, [2e6, 2e6])])
    with pytest.raises(Exception, match="2\\^53"):
        mined(df, scale=256.0 * 256).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(-3, 3)), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_lists_of_the_first_few_do_not_depend_on_how_they_are_fed(entries, k, step):
    few = hard_negatives.FirstFew(3, k)
    for start in range(0, len(entries), step):
        part = entries[start : start + step]
        ids, scores = np.array([e[1] for e in part]), np.array([e[2] for e in part], dtype=np.float64)
        few.offer(np.arange(3), ids, np.repeat(scores[None, :], 3, axis=0), np.array([[e[0] == s for e in part] for s in range(3)]))
    want = [(s, j, x) for s in range(3) for x, j in [(-x, j) for x, j in sorted({(-e[2], e[1]) for e in entries if e[0] == s})[:k]]]
    assert list(zip(few.slot.tolist(), few.id.tolist(), few.score.tolist(), strict=True)) == want


# --- op12


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def encoded(library, data, end=2):
    """(id, start, n, crc32) of each row in the order of the ids, nulls first."""
    out, start = [], 0
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_op12_equals_the_library_on_whole_texts(spark, sf, library):
    data = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(x) for x in queries.op12_record_files(spark, sf).collect()]
    assert sorted(got) == encoded(library, data)


@pytest.mark.parametrize("file_bytes,split,read", [(1 << 28, 1 << 25, 1 << 22), (2000, 1500, 700), (1, 1, 1)])
def test_op12_cases_and_small_files(spark, library, monkeypatch, file_bytes, split, read):
    for name, value in (("FILE_BYTES", file_bytes), ("SPLIT_BYTES", split), ("READ_BYTES", read)):
        monkeypatch.setattr(record_files, name, value)
    data = [x for x in texts() if x[0] not in (16, 19, None)] + [(16, "one text"), (16, "one text"), (None, "no id"), (-5, "below zero")]
    manifest = record_files.write_records(frame(spark, data).repartition(4), WORDS, 2)
    got = sorted((tuple(x) for x in record_files.record_digests(manifest).collect()), key=lambda x: x[1])
    assert got == encoded(library, data)
    files = [x.asDict() for x in manifest.collect()]
    assert sum(x["n_docs"] for x in files) == len(data) and (file_bytes > 1 << 20 or len(files) > 4)
    whole = {x["start"]: x for x in record_files.read_records(manifest).collect()}
    assert [whole[s]["ids"] for _, s, _, _ in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0))]
    assert record_files.write_records(frame(spark, []), WORDS, 2).count() == 0
    assert record_files.record_digests(record_files.write_records(frame(spark, []), WORDS, 2)).collect() == []


def test_op12_texts_ids_and_repeats_of_an_id(spark, library):
    data = [("b", "x"), ("a", "y"), ("a", "z"), ("é\n", "w"), ("", "v")]
    manifest = record_files.write_records(spark.createDataFrame(data, "doc_id string, text string"), WORDS, 60_000 * 2)  # an end id that takes four bytes
    got = sorted((x["start"], x["doc_id"], x["ids"]) for x in record_files.read_records(manifest).collect())
    assert [x[1] for x in got] == ["", "a", "a", "b", "é\n"] and {x[2][-1] for x in got} == {120_000} and sorted(x[2][0] for x in got[1:3]) == sorted(library.encode(c, add_special_tokens=False).ids[0] for c in "yz")


def test_op12_shuffled_reads_go_by_the_index(spark):
    data = [(k, prose(k, 20)) for k in range(60)]
    manifest = record_files.write_records(frame(spark, data).repartition(3), WORDS, 2)
    order = lambda seed: [x["doc_id"] for x in record_files.read_shuffled(manifest, seed, 2).collect()]
    assert sorted(map(int, order(1))) == list(range(60)) and order(1) == order(1) != order(2) and order(1) != sorted(order(1))
    assert {(x["doc_id"], tuple(x["ids"])) for x in record_files.read_shuffled(manifest, 1, 2).collect()} == {(x["doc_id"], tuple(x["ids"])) for x in record_files.read_records(manifest).collect()}


def test_op12_damage_is_found_and_leftovers_are_not_read(spark, tmp_path):
    manifest = record_files.write_records(frame(spark, [(k, prose(k, 20)) for k in range(20)]).coalesce(1), WORDS, 2, folder=str(tmp_path / "files"))
    rows_before = record_files.record_digests(manifest).collect()
    (tmp_path / "files" / "part-000000-0000-left.records").write_bytes(b"of a task that was lost")
    assert sorted(record_files.record_digests(manifest).collect()) == sorted(rows_before)
    file = tmp_path / "files" / manifest.first()["file"]
    raw = bytearray(file.read_bytes())
    for at in (3, 9, 40, len(raw) - 1):
        file.write_bytes(bytes(raw[:at]) + bytes([raw[at] ^ 1]) + bytes(raw[at + 1 :]))
        with pytest.raises(Exception, match="ChecksumError"):
            record_files.record_digests(manifest).collect()
    file.write_bytes(bytes(raw))
    assert sorted(record_files.record_digests(manifest).collect()) == sorted(rows_before)


def test_op12_texts_are_encoded_in_lots_of_bounded_size(monkeypatch):
    monkeypatch.setattr(record_files, "TEXTS", 3)
    monkeypatch.setattr(record_files, "TEXT_BYTES", 10)
    assert list(record_files._lots(pa.array(["a" * n for n in (4, 6, 1, 11, 50, 0, 0, 0)] + [None]))) == [(0, 2), (2, 1), (3, 1), (4, 1), (5, 3), (8, 1)]
    assert list(record_files._lots(pa.array([], pa.string()))) == []


def slow_checksum(message):
    register = 0xFFFFFFFF
    for byte in message:
        register ^= byte
        for _ in range(8):
            register = (register >> 1) ^ (record_files.POLYNOMIAL if register & 1 else 0)
    return register ^ 0xFFFFFFFF


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=700), min_size=1, max_size=6))
def test_checksums_and_frames(messages):
    assert record_files.checksums(messages).tolist() == [slow_checksum(m) for m in messages]
    assert record_files.payloads_of(record_files.frames(messages)) == messages
    assert record_files.checksums([b"123456789"]).tolist() == [0xE3069283]  # the public check value


# --- op13


def audit_frame(spark):
    data = [(i, t, lang, source) for k, (i, t) in enumerate(texts()) for lang, source in [(["en", "de", None, ""][k % 4], ["a", "b", None, "c", "é"][k % 5])]]
    data += [(50 + k, "The the THE cat Ünder ünder don't " + "zebra " * (k % 3), "en", "abé"[k % 3]) for k in range(9)]
    data += [(70, None, "xx", "only"), (71, "one two three", "yy", "p"), (72, "", "yy", "q"), (73, None, "yy", None), (74, "x\x00y\x7fz", "en", "a"), (75, "x" * 3000, "en", "a"), (76, "x" * 2999 + "y", "en", "b"), (77, "x" * 3000, "en", "c")]
    data += [(80, "same words here", "zz", "s")] * 3 + [(81, "same other", "zz", "t"), (81, "same other", "zz", "t")]
    return spark.createDataFrame([(*x, "clash", "clash", 7) for x in data], "doc_id long, text string, lang string, source string, item string, rank string, value int")


@pytest.mark.parametrize("range_bytes,sources", [(16 << 20, 1024), (400, 2)])
def test_op13_cases_equal_the_sql(spark, tmp_path, monkeypatch, range_bytes, sources):
    monkeypatch.setattr(source_divergence, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(source_divergence, "SOURCES", sources)
    docs, con = saved(audit_frame(spark).repartition(6), tmp_path, "documents")
    out = source_divergence.source_divergence(docs)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    same(out, con, source_divergence.ORACLE_SQL)
    got = out.collect()
    assert {x["value"] for x in got if x["lang"] == "yy"} == {0} and not [x for x in got if x["lang"] == "xx"] and {x["item"] for x in got if x["lang"] == "zz" and x["part"] == "term"} >= {"words", "here"}
    assert source_divergence.source_divergence(docs.where("false")).collect() == []


@pytest.mark.parametrize("range_bytes", [16 << 20, 2000])
def test_op13_whole_tables_equal_the_sql(spark, sf, monkeypatch, range_bytes):
    monkeypatch.setattr(source_divergence, "RANGE_BYTES", range_bytes)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    same(source_divergence.source_divergence(docs), connect(sf), source_divergence.ORACLE_SQL)


def test_op13_pieces_are_cut_at_paths_and_meet_again(spark, sf, monkeypatch):
    monkeypatch.setattr(source_divergence, "RANGE_BYTES", 2000)
    pieces = source_divergence.written(source_divergence.term_tries(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)))
    paths = source_divergence._paths(pieces)
    assert len(paths) > 5 and paths == sorted(paths, key=lambda p: (p[0].encode(), p[1]))
    merged = source_divergence.merged_tries(pieces, 1).where("kind = 'piece'").collect()
    leaves = [(x["lang"], t) for x in merged for t in source_divergence.unflattened(x["leaves"], 0, np.arange(len(x["sources"]))).term.to_pylist()]
    assert len(leaves) == len(set(leaves))  # no leaf is in two ranges


term = st.lists(st.sampled_from([b"a", b"b", b"ab", "é".encode()]), min_size=1, max_size=5).map(b"".join)


def leaves_of(trie):
    counters = defaultdict(dict)
    for leaf, source, n in zip(trie.leaf.tolist(), trie.source.tolist(), trie.count.tolist(), strict=True):
        assert source not in counters[leaf]
        counters[leaf][source] = n
    return [(lang, t, d, counters[k]) for k, (lang, t, d) in enumerate(zip(trie.lang.tolist(), trie.term.to_pylist(), trie.docs.tolist(), strict=True))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 1), term, st.integers(0, 3), st.integers(1, 9)), min_size=1, max_size=15), min_size=1, max_size=4))
def test_tries_merge_and_flatten(parts):
    """Each entry is one document that has a term so often."""
    tries, want = [], defaultdict(lambda: [0, Counter()])
    for part in parts:
        for lang, t, source, n in part:
            want[lang, t][0] += 1
            want[lang, t][1][source] += n
        columns = [np.array(c) for c in zip(*[(x[0], x[2], x[3]) for x in part], strict=True)]
        tries.append(source_divergence.Tries.of(columns[0], pa.array([x[1] for x in part], pa.binary()).dictionary_encode(), np.ones(len(part), dtype=np.int64), np.arange(len(part)), columns[1], columns[2]))
    whole = source_divergence.Tries.merged(tries)
    expected = [(lang, t, docs, dict(counts)) for (lang, t), (docs, counts) in sorted(want.items())]
    assert leaves_of(whole) == expected
    names = ["w", "x", "y", "z"]
    back = []
    for lang in (0, 1):
        a, b = np.searchsorted(whole.lang, (lang, lang + 1)).tolist()
        for start, stop in itertools.pairwise([a, (a + b) // 2, b]):
            if stop > start:
                used, blob = source_divergence.flattened(whole.part(start, stop), names)
                back += leaves_of(source_divergence.unflattened(blob, lang, np.array([names.index(u) for u in used])))
    assert back == expected


def test_shares_are_exact():
    counts = np.array([0, 5, 10**10, 10**17])
    for total in (1, 7, 10**18):
        if 10**9 * (10**17 + 1) // total < 2**62:
            assert source_divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_new_queries_are_registered_with_sql_where_there_is_one(spark, sf):
    assert {"op11_hard_negatives", "op13_source_divergence"} <= set(queries.oracle_sql()) and "op12_record_files" in queries.queries()
    assert rows(["a"], [(1,)]) == [[1]]
