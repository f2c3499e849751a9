import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesieve.llm import embedding_dedup, line_dedup, minhash_dedup, suffix_dedup
from lakesieve.llm.components import connected_components

from ..oracle import connect, same
from .cases import frame, lines, prose, texts


def classes(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)], [(5, 3), (9, 7), (7, 5), (20, 21)]])
def test_components(spark, edges):
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(60, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


# --- op4


def test_op4_equals_its_sql(spark, sf):
    same(line_dedup.line_dedup(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed"), connect(sf), line_dedup.ORACLE_SQL)


def brute_lines(rows, run=3):
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t})
    seen, gone = set(), defaultdict(set)
    for _, i, t in docs:
        solid = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        for k in range(len(solid) - run + 1):
            window = tuple(solid[k : k + run])
            if window in seen:
                gone[i, t] |= set(range(k, k + run))
            seen.add(window)
    return {k: len(v) for k, v in gone.items()}


@pytest.mark.parametrize("words", [None, 50])
def test_op4_hot_fingerprints_in_blocks(spark, sf, monkeypatch, words):
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(line_dedup.line_dedup(docs, words=words).select("doc_id", "text", "n_lines", "n_removed"), connect(sf), line_dedup.WORDS_ORACLE_SQL if words else line_dedup.ORACLE_SQL)


def test_op4_cases(spark):
    rows = [*texts(), (30, "\n".join(["same"] * 9)), (31, "\n".join(lines(1, 6)))]
    out = line_dedup.line_dedup(frame(spark, rows))
    assert out.columns == [*frame(spark).columns, "n_lines", "n_removed"]
    got = out.collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    texts_of = dict(rows)
    for r in got:
        expected = max((n for (i, t), n in want.items() if i == r["doc_id"]), default=0)
        if r["doc_id"] not in (19,):
            assert r["n_removed"] == expected, r["doc_id"]
    by = {r["doc_id"]: r for r in got}
    assert by[12]["text"].count("line 1") == 0 and by[12]["text"].count("\n\n") == 1 and by[12]["n_removed"] == 4
    assert by[31]["text"] == "" and by[6]["text"] is None and by[7]["text"] == "" and by[30]["n_removed"] == 8
    assert by[11]["text"] == texts_of[11] and by[9]["score"] == "clash"
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def repeated_rows():
    """Rows that repeat id and text, of several lines, with and without an earlier copy under another id."""
    six, other = "\n".join(lines(1, 6)), "\n".join(lines(2, 4))
    long = " ".join(f"word{k}" for k in range(60)) + "."
    return [
        *[(1, six)] * 5, *[(2, six)] * 3, (3, other), (3, other), (4, other + "\n" + lines(3, 1)[0]), *[(5, f"{long}\n{long}")] * 2, (6, long), *[(None, six)] * 2, (7, "\n".join(["again"] * 7)), (7, "\n".join(["again"] * 7)),
        (8, other), (8, six), (9, None), (9, None), (10, ""),
    ]


@pytest.mark.parametrize("words", [None, 50])
@pytest.mark.parametrize("block,seen", [(256, 1 << 19), (2, 1)])
def test_op4_rows_that_repeat_id_and_text_count_as_one_document(spark, tmp_path, monkeypatch, words, block, seen):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "SEEN", seen)
    frame(spark, repeated_rows()).select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = line_dedup.line_dedup(docs, words=words).select("doc_id", "text", "n_lines", "n_removed")
    same(out, con, line_dedup.WORDS_ORACLE_SQL if words else line_dedup.ORACLE_SQL)
    by = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect())
    six = "\n".join(lines(1, 6))
    assert by[None, six, 0] == 2 and by[1, "", 6] == 5 and by[2, "", 6] == 3 and by[3, "\n".join(lines(2, 4)), 0] == 2 and by[4, lines(3, 1)[0], 4] == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=3, max_size=30))
def test_fingerprints_are_window_minima_by_content(values):
    hashes = np.array(values, dtype=np.uint64)
    at = line_dedup.fingerprints(hashes, 3)
    assert len(at) == len(values) - 2
    for k, line in enumerate(at):
        window = values[k : k + 3]
        assert line == k + max(j for j in range(3) if window[j] == min(window))


# --- op2


def brute_passages(rows, window=50):
    rows = [(i, t) for i, t in rows if t]
    spans = lambda t: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    copies = Counter(t for _, t in rows)
    count = Counter()
    for t in copies:
        s = spans(t)
        w = [t[a:b] for a, b in s]
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    want = Counter()
    for t, n in copies.items():
        s = spans(t)
        if n > 1 and len(s) >= window:
            want.update((i, 0, len(t), len(s), True) for i, x in rows if x == t)
            continue
        w = [t[a:b] for a, b in s]
        hits = [k for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1]
        runs = []
        for k in hits:
            if runs and k - runs[-1][1] <= window:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        doc = next(i for i, x in rows if x == t)  # shorter copies have no runs
        want.update((doc, s[a][0], s[b + window - 1][1], b - a + window, False) for a, b in runs)
    return want


def found_passages(df):
    return Counter((r["doc_id"], r["start"], r["stop"], r["n_words"], r["whole"]) for r in suffix_dedup.repeated_passages(df).collect())


def test_op2_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found_passages(docs) == brute_passages(rows)


@pytest.mark.parametrize("block", [256, 3])
def test_op2_cases_and_planted_passages(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)  # 3: most minimisers are dealt to blocks
    shared = prose(77, 51)
    rows = [*texts(), *[(100 + k, f"{prose(200 + k, 30)} {shared} {prose(300 + k, 30)}") for k in range(20)], (130, prose(5, 20) + " " + " ".join(shared.split(" ")[:49])), (131, prose(500, 300))]
    got = found_passages(frame(spark, rows))
    want = brute_passages(rows)
    assert got == want
    assert {i for i, *_ in got} >= {*range(100, 120), 4, 5, 1, 3} and not {i for i, *_ in got} & {130, 131, 6, 7, 8}
    assert found_passages(frame(spark, [])) == Counter()


def test_op2_repeats_inside_one_text_and_at_its_ends(spark):
    p = prose(61, 70)
    q = p.split(" ")
    rows = [(1, f"{p} {p} {p}"), (2, " ".join(q[:50])), (3, " ".join(q[20:]) + " " + prose(62, 40)), (4, "la " * 300), (5, "  \t" + "  \n ".join(q[5:60]) + "  "), (None, prose(63, 10) + " " + " ".join(q[10:66]))]
    assert found_passages(frame(spark, rows)) == brute_passages(rows)


# --- op5


def links(rows, least=0.8):
    """Aligned similarity of all pairs of different texts, by the full dynamic programme."""
    out = []
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        x, y = ([tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] for w in (a.split(), b.split()))
        if not a.split() or not b.split():
            continue
        table = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for p in range(len(x)):
            for q in range(len(y)):
                table[p + 1, q + 1] = table[p, q] + 1 if x[p] == y[q] else max(table[p, q + 1], table[p + 1, q])
        m = table[-1, -1]
        if m >= least * (len(x) + len(y) - m) - 1e-9:
            out.append((i, j))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=25), st.lists(st.sampled_from("abc"), min_size=1, max_size=25))
def test_banded_alignment_is_exact_above_the_threshold(a, b):
    value = minhash_dedup.similarity(a, b)
    assert (value >= 0.8) == bool(links([" ".join(a), " ".join(b)]))


def near_copies(n=12, words=120):
    rows = []
    for family in range(4):
        base = prose(900 + family, words).split(" ")
        for k in range(n):
            w = list(base)
            for e in range(k % 5):
                w[(17 * k + 31 * e) % len(w)] = f"edit{k}x{e}"
            rows.append(" ".join(w))
    return [*rows, prose(1, 40), prose(2, 40), "short text", "short text", "", "   "]


def test_op5_equals_brute_force(spark):
    rows = near_copies()
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(frame(spark, list(enumerate(rows)))).collect()}
    want = classes(len(rows), links(rows))
    assert [got[i]["class_id"] for i in range(len(rows))] == want
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())


@pytest.mark.parametrize("texts_a_block, few, most", [(4, 1, 1000), (4, 1, 1), (7, 100, 100)])
def test_op5_hot_buckets_and_components_in_blocks(spark, monkeypatch, texts_a_block, few, most):
    monkeypatch.setattr(minhash_dedup, "FEW_BLOCKS", few)
    monkeypatch.setattr(minhash_dedup, "SKETCH_BLOCK", texts_a_block)
    monkeypatch.setattr(minhash_dedup, "TEXT_BLOCK", texts_a_block)
    monkeypatch.setattr(minhash_dedup, "MOST_BLOCKS", most)
    rows = [*near_copies(16), *loose_family()]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(frame(spark, list(enumerate(rows)))).collect()}
    want = classes(len(rows), links(rows))
    assert [got[i] for i in range(len(rows))] == want
    assert len(set(want[-30:])) > 3  # a candidate component of several classes


@pytest.mark.parametrize("most", [1, 1000])
def test_op5_large_components_compare_all_pairs(spark, monkeypatch, most):
    """Links between texts that share no bucket, in a component of many blocks."""
    monkeypatch.setattr(minhash_dedup, "MOST_BLOCKS", most)
    n = 24

    def pairs(t, least):
        may, x, y = minhash_dedup.meets(t), [], []
        for i in range(len(t["id"])):
            for j in np.flatnonzero((t["v"] == t["v"][i]) & (t["c"] != t["c"][i]) & may(i)).tolist():
                x.append(t["id"][i])
                y.append(t["id"][j])
        return (np.array(x), np.array(y)) if x else None

    groups = spark.createDataFrame([(0, k, 6) for k in range(n)], "g long, id long, blocks int")
    data = spark.createDataFrame([(k, k % 12) for k in range(n)], "id long, v long")
    finer = spark.createDataFrame([(100 + k // 2, k, 1) for k in range(n)], "g long, id long, blocks int")
    found = minhash_dedup.joined(groups, data, pairs, 0.8, 4, finer)
    got = {r["id"]: r["component"] for r in minhash_dedup.connected_components(found).collect()}
    assert got == {k: k % 12 for k in range(n)}


@pytest.mark.parametrize("block", [2, 4096])
def test_op5_hot_buckets_lose_no_candidates(spark, monkeypatch, block):
    """Two sketches that agree in eleven buckets and in no other mark, each bucket with three more."""
    monkeypatch.setattr(minhash_dedup, "SKETCH_BLOCK", block)
    own = iter(range(-30_000, 30_000))
    rows = []
    for k in range(2 + 33):
        marks = [next(own) for _ in range(minhash_dedup.SKETCHES)]
        for p in range(11):
            if k < 2 or (k - 2) // 3 == p:
                marks[p] = p
        rows.append((k, 100, [m * 100 + p for p, m in enumerate(marks[: minhash_dedup.BUCKETS])], marks))
    nodes = spark.createDataFrame(rows, "id long, n int, buckets array<long>, marks array<short>")
    assert sorted(map(tuple, minhash_dedup.candidate_components(nodes)[0].collect())) == [(0, 0), (1, 0)]


def loose_family(n=30, words=120):
    """Copies of one text with 0 to 7 edits apart: some pairs are links, some are candidates only."""
    base = prose(1234, words).split(" ")
    out = []
    for k in range(n):
        w = list(base)
        for e in range(k % 8):
            w[(29 * e + 3 * k) % len(w)] = f"own{k}x{e}"
        out.append(" ".join(w))
    return out


def near_edges(texts_):
    """Pairs of places of equal texts, and of texts that share so many shingles that they can be links and whose alignment says so."""
    rows = list(enumerate(texts_))
    bags = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.split() for _, t in rows)]
    where = defaultdict(list)
    for i, bag in enumerate(bags):
        for shingle in bag:
            where[shingle].append(i)
    shared = Counter(pair for found in where.values() for pair in itertools.combinations(found, 2))
    edges = []
    for (i, j), n in shared.items():
        x, y = bags[i], bags[j]
        total = x.total() + y.total()
        if rows[i][1] == rows[j][1] or (x & y).total() >= 0.8 / 1.8 * total - 1e-9 and minhash_dedup.similarity(rows[i][1].split(), rows[j][1].split()) >= 0.8:
            edges.append((i, j))
    return edges


def test_op5_finds_every_class_of_the_drivers_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    edges = near_edges([t for _, t in rows])
    want = classes(len(rows), edges)
    assert len(edges) > 50
    linked = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in edges)
    assert linked >= 0.99 * len(edges)  # recall over all links; 3e-4 is the chance of a miss at the threshold
    assert all(want[[r[0] for r in rows].index(c)] == want[k] for k, (i, _) in enumerate(rows) for c in [got[i]])  # no false class


def test_op5_tells_rows_of_one_id_apart(spark):
    a, u = prose(41, 200), prose(42, 200)
    near = " ".join([*a.split(" ")[:90], "edit", *a.split(" ")[91:]])
    df = frame(spark, [(1, a), (1, u), (0, near), (1, a), (2, u), (None, u)])
    got = Counter((r["doc_id"], r["class_id"], r["kept"], r["n_copies"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == Counter([(1, 0, False, 2), (1, 0, False, 2), (0, 0, True, 1), (1, 1, True, 2), (2, 1, False, 2), (None, None, True, 1)])
    left = minhash_dedup.without_near_duplicates(df)
    assert left.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(0, near), (1, u), (None, u)])


def test_op5_very_long_texts(spark):
    a = prose(43, 60_000).split(" ")
    b = list(a)
    for k in range(0, len(b), 60):
        b[k] = f"edit{k}"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[:30_000])), (4, "la " * 50_000), (5, "la " * 49_000), (6, "la " * 30_000)]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=20, unique=True), min_size=1, max_size=9))
def test_common_members_of_all_pairs(sets):
    got = minhash_dedup.in_common([np.array(s, dtype=np.uint64) for s in sets])
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert got[i, j] == len(set(sets[i]) & set(sets[j]))


def long_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.lists(st.integers(0, 40), max_size=60), st.lists(st.integers(0, 1), max_size=200))
def test_alignment_by_chain_and_by_cells(a, b, c):
    for x, y in ((a, b), (c[: len(c) // 2], c[len(c) // 2 :])):
        x, y = np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64)
        assert minhash_dedup.aligned(x, y, max(len(x), len(y), 1)) == long_common(x.tolist(), y.tolist())


def test_op5_cases(spark):
    out = minhash_dedup.near_duplicates(frame(spark))
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["class_id"], r["kept"]))
    assert sum(map(len, got.values())) == len(texts())
    assert got[1] == [(1, True)] and got[3] == [(1, False)] and got[16] == [(1, False)] * 2 and got[2] == [(1, False)]
    assert got[10] == [(9, False)] and all(got[i] == [(i, True)] for i in (4, 5, 6, 7, 8, 11, 13, 14, 15, 17, 18)) and got[None] == [(None, True)] * 2
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


# --- op6


def brute_vectors(rows, least=0.95):
    x = np.array(rows, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    return hit.sum(1), classes(len(rows), list(zip(*np.nonzero(np.triu(hit)), strict=True)))


@pytest.mark.parametrize("block", [1024, 8])
def test_op6_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 64))
    rows = np.concatenate([centres, centres[:10] + 0.15 * r.normal(size=(10, 64)), np.repeat(centres[:2], 20, 0) + 0.05 * r.normal(size=(40, 64)), np.repeat(centres[5:6], 15, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, "x", "y") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, id string, v string")
    got = {x["vec_id"]: x for x in embedding_dedup.near_vectors(df).collect()}
    n, c = brute_vectors(rows)
    found = sum(x["n_links"] for x in got.values())
    assert 0.9 * n.sum() <= found <= n.sum() and all(got[i]["n_links"] <= n[i] for i in range(len(rows)))
    assert np.mean([got[i]["component_id"] == c[i] for i in range(len(rows))]) > 0.95


@pytest.mark.parametrize("dim, rows", [(64, 50_000), (64, 10**10), (16, 1000), (768, 10**6)])
def test_op6_recall_at_the_threshold(dim, rows):
    turns = embedding_dedup.turns_for(rows, dim)
    tables = embedding_dedup.tables_for(dim, turns)
    r = np.random.default_rng(11)  # other pairs than those that chose the tables
    a = r.normal(size=(1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = r.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    x, y = (embedding_dedup.buckets(z, tables, turns).reshape(len(a), -1) for z in (a, b))
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.98


def test_op6_finds_links_planted_in_the_drivers_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    have = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()])
    r = np.random.default_rng(5)
    base = have[:300] / np.linalg.norm(have[:300], axis=1, keepdims=True)
    side = r.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    cosine = r.uniform(0.9, 1.0, size=(300, 1))  # about half of them links
    new = (cosine * base + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)) * r.uniform(0.1, 30, size=(300, 1))
    rows = np.concatenate([have, new.astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows.astype(float))], "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in embedding_dedup.near_vectors(df).collect()}
    n, c = brute_vectors(rows)
    assert n.sum() > 200 and sum(x["n_links"] for x in got.values()) >= 0.99 * n.sum()
    assert all(got[i]["n_links"] <= n[i] for i in range(len(rows)))
    assert np.mean([got[i]["component_id"] == c[i] for i in range(len(rows))]) > 0.995


def test_op6_tells_rows_of_one_id_apart(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (0, [1.0, 0.01, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect())
    assert got == Counter([(1, 2, 0, False), (1, 0, 1, True), (0, 2, 0, True), (2, 2, 0, False), (3, 0, 3, True)])


def test_op6_cases(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, [2.0, 0.0, -0.0]), (3, one), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, nan, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, None, 0.0]), (10, [1.0, 0.0]), (None, one), (11, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(3, 16))
    y = embedding_dedup.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(x, y)
