import re
from itertools import permutations

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumagrid.llm import filter_audit as A
from lumagrid.llm.oracle import FILTER_AUDIT
from lumagrid.llm.queries import op13_filter_audit

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order applied to the documents, one step after another."""
    fails = []
    for doc, text, part in docs:
        x, words = text or "", WORD.findall(text or "")
        smaller = any(d is not None and doc is not None and d < doc and (t or "") == x for d, t, _ in docs)
        own = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), bool(re.search("[#$%&*|]", x)), smaller]
        good, toxic = (any(d == doc and d is not None and m[k] == 1 for d, *m in labels) for k in (0, 1))
        fails.append((part or "", own, good, toxic))
    out = []
    for part in {f[0] for f in fails}:
        rows, steps = [f[1:] for f in fails if f[0] == part], []
        for order in permutations(range(5)):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                steps.append((f, (part, "".join("ABCDE"[i] for i in order), k + 1, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), sum(r[0][f] and sum(r[0]) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))))
        total = [sum(row[4] for g, row in steps if g == f) for f in range(5)]
        out += [(*row, total[f]) for f, row in steps]
    return sorted(out)


def test_query_equals_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = op13_filter_audit(spark, SF)
    theirs = db.sql(FILTER_AUDIT)
    assert ours.columns == theirs.columns
    rows = sorted(map(tuple, ours.collect()))
    assert rows == sorted(theirs.fetchall()) and len(rows) == 600 * len({r[0] for r in rows})


def test_edges_equal_brute_force(spark):
    long = "word " * 60
    docs = [(1, None, "x"), (2, "", "x"), (None, "", "x"), (3, "A & B", None), (3, "A & B", ""), (4, "A & B", "y"), (5, long, "y"), (6, long, "x"), (None, long, None), (7, " ".join(f"w{i}" for i in range(90)), "y"), (8, "É ß 日 " * 30, "x"), (9, "tab\tand\x0bother space #", "y"), (10, "w " * 40000, "x")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (4, 0, 0)]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, source string, row int, part string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, A.audit(d, said).collect())) == brute(docs, labels)
    assert A.audit(d.where("false"), said).count() == 0
    assert sorted(map(tuple, A.audit(d, said.where("false")).select("part", "kept").collect())) == [(r[0], r[3]) for r in sorted(brute(docs, []), key=lambda r: (r[0], r[3]))]


def test_ranges_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i) + (int(i) % 3 << 32), f"p{i % 4}", *map(bool, rng.integers(0, 2, 4))) for i in range(5000)]
    d = spark.createDataFrame(rows, "row long, part string, A boolean, B boolean, C boolean, m boolean")
    got = A.interactions(A.posting_lists(d, ("A", "B", "C"), ("m",)), ("A", "B", "C"), ("m",)).collect()
    assert len(got) == 4 * 12
    for r in got:
        own = [x for x in rows if x[1] == r.part]
        before = [k for k in range(3) if r.before >> k & 1]
        removed = [x for x in own if x[2 + r["filter"]] and not any(x[2 + k] for k in before)]
        assert (r.total, r.removed, r.lost_m, r.fails) == (len(own), len(removed), sum(x[5] for x in removed), sum(x[2 + r["filter"]] for x in own))
        assert r.gone == sum(any(x[2 + k] for k in before) for x in own)


IDS = st.sets(st.integers(0, 3000), max_size=300).map(lambda s: np.array(sorted(s), np.int64))


@settings(max_examples=200, deadline=None)
@given(st.lists(IDS, max_size=4), IDS, st.sampled_from([64, 128, 4096]))
def test_merges_equal_sets(lists, other, window):
    all_ = sorted(set().union(*(x.tolist() for x in lists)))
    assert A.union(lists, window).tolist() == all_
    assert A.difference(np.array(all_, np.int64), other, window).tolist() == sorted(set(all_) - set(other.tolist()))


