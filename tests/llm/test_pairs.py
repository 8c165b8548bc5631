import random
import re

import numpy as np
import pytest

from lumagrid.llm import ngram_join, pivot_index
from lumagrid.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def least_reachable(ids, linked):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("links", [1_000_000, 10])
def test_components(spark, links):
    rng = random.Random(links)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(4), links).collect()}
    ids = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == least_reachable(ids, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    items = list(sets.items())
    links = [(a, b) for k, (a, s) in enumerate(items) for b, t in items[k + 1 :] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return sets, least_reachable(sets, links)


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=30)
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t + (passage if rng.random() < 0.5 else [])))
    rows += ["", None, "   \n", "One two", "one TWO", "a b c d e", "é ß ñ", "é ß ñ"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("long", [64, 3])
def test_ngram_join_equals_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join._verify_within, "__defaults__", (5,))
    rows = corpus(long)
    sets, want = brute(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, sid int")
    got = ngram_join.classes(docs).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.classes(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "q r s t u v")], schema)
    got = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.classes(same).collect())
    assert got == [(0, None), (3, 3), (5, 3), (5, 3)]
    assert sorted(r.doc_id or 0 for r in ngram_join.first_of_each(same).collect()) == [0, 3]


def vectors(seed, n=400, groups=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for g in range(groups):
        own = rng.choice(n, 5)
        x[own] = x[own[0]] + rng.normal(size=(5, 64)) * rng.uniform(0.05, 0.35)
    x[n - 40 :] = x[0] + 0.1 * rng.normal(size=(40, 64))
    x[7] = x[8]
    return x.astype(np.float32)


def brute_vectors(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    m = u @ u.T >= 0.95
    np.fill_diagonal(m, False)
    return m


@pytest.mark.parametrize("block", [1024, 16])
def test_pivot_index(spark, block):
    x = vectors(block)
    m = brute_vectors(x)
    rows = [(k, v.tolist(), 1, "x") for k, v in enumerate(x)]
    rows += [(1000, None, 1, "x"), (1001, [0.0] * 64, 1, "x"), (1002, [float("nan")] * 64, 1, "x"), (1003, [None] + [1.0] * 63, 1, "x"), (1004, [], 1, "x"), (1005, [float("inf")] + [1.0] * 63, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, key string")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df, block=block).collect()}
    found = sum(got[k].n_links for k in range(len(x)))
    assert found <= m.sum() and found >= 0.9 * m.sum()
    assert all(got[k].n_links <= m[k].sum() for k in range(len(x)))
    if found == m.sum():
        want = least_reachable(range(len(x)), list(zip(*np.nonzero(m))))
        assert {k: got[k].component_id for k in want} == want
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(1000, 1006))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pivot_index_recall_at_the_limit(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=(600, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.99, (600, 1))
    b = c * a + np.sqrt(1 - c * c) * o
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    recall = sum(r.n_links for r in got) / 1200
    assert recall >= 0.9


def test_pivot_index_empty(spark):
    assert pivot_index.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in pivot_index.near_duplicates(one).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_rows_without_an_id_link(spark):
    base = [f"w{k}" for k in range(60)]
    near = base[:30] + ["x"] + base[31:]
    far = [f"z{k}" for k in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(near)), (None, " ".join(base)), (9, " ".join(far)), (9, " ".join(base[::-1])), (9, " ".join(far)), (4, " ".join(near)), (5, ""), (None, ""), (None, "q r s t u"), (None, "q r s t u")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __id int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.classes(docs).collect())
    assert got == sorted([(0, 4)] * 3 + [(9, 9)] * 3 + [(4, 4), (5, 5), (0, 0), (0, 0), (0, 0)])
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(4, " ".join(near)), (9, " ".join(far)), (9, " ".join(base[::-1])), (5, ""), (0, ""), (0, "q r s t u")])


def test_vectors_without_an_id_link(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 64))
    rows = [(None, a), (None, a + 0.01), (9, a), (None, b), (None, b + 0.01), (4, -a), (4, -a)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in pivot_index.near_duplicates(df).collect())
    assert got == sorted([(0, 2, 9, False), (0, 2, 9, False), (9, 2, 9, True), (0, 1, 0, True), (0, 1, 0, True), (4, 1, 4, True), (4, 1, 4, True)])


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(4)
    pruned = 0
    for n in (1, 4, 9, 30, 120, 127, 130, 700, 3000):
        base = np.unique(rng.integers(0, 2**64, n, np.uint64))
        others = [base] + [np.unique(np.concatenate([base[: len(base) - k], rng.integers(0, 2**64, more, np.uint64)])) for k in (0, n // 12, n // 9, n // 5, n // 3) for more in (0, n // 12, n // 9, n // 5, n // 4)]
        sets = [base, *others]
        sketches = [ngram_join.sketch(s) for s in sets]
        linked = np.array([[9 * len(np.intersect1d(s, t)) >= 4 * (len(s) + len(t)) for t in sets] for s in sets])
        may = np.array([[ngram_join.may_link(x, y) for y in sketches] for x in sketches])
        assert (may | ~linked).all()
        pruned += int((~may).sum())
        apart = ~np.eye(len(sets), dtype=bool)
        assert (ngram_join._may_link_within(sketches, apart) | ~(linked & apart).any(1)).all()
        assert (ngram_join._may_link_within(sketches, apart) == (may & apart).any(1)).all()
    far = [ngram_join.sketch(np.unique(rng.integers(0, 2**64, 100, np.uint64))) for _ in range(6)]
    assert pruned and not ngram_join._may_link_within(far, ~np.eye(6, dtype=bool)).any()


def test_whole_sets_are_sent_only_for_possible_links(spark, monkeypatch):
    """Candidates that share three quarters of their shingles are told apart before their shingles are shuffled."""
    rng = random.Random(8)
    rows = []
    for g in range(8):
        base = [f"w{g}x{k}" for k in range(200)]
        for changes in (0, 7, 7, 7) if g else (0, 1, 1, 1):
            t = list(base)
            for k in range(changes):
                t[k * 200 // changes + rng.randrange(10)] = f"z{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    sent, sets = [], ngram_join._sets

    def counted(roles, slim, reps, *made):
        if not made:
            sent.append(roles.count())
        return sets(roles, slim, reps, *made)

    monkeypatch.setattr(ngram_join, "_sets", counted)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)[1]
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 29
    assert 0 < sum(sent) <= 8


@pytest.mark.parametrize("told", [0, 5])
def test_long_lists_that_were_not_told(spark, monkeypatch, told):
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "TOLD", told)
    monkeypatch.setattr(ngram_join._verify_within, "__defaults__", (5,))
    rows = corpus(20 + told)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)[1]
