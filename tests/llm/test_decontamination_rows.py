from collections import Counter

import pytest

from lumagrid.llm import decontamination


@pytest.mark.parametrize("piece", [8_000_000, 40])
def test_each_row_and_items_without_id(spark, piece):
    item = " ".join(f"w{k}" for k in range(12))
    docs = [(7, item), (7, "clean words"), (None, "clean words"), (None, "more clean words here"), (1, f"x {item}"), (2, "all of no id"), (7, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(5, item), (None, "all of no id"), (6, "other"), (8, item + " and")], "item_id long, text string")
    got = decontamination.contamination(d, b, piece_chars=piece).collect()
    want = [(7, 12, 12, ("5", "8"))] * 2 + [(7, 2, 0, ()), (None, 2, 0, ()), (None, 4, 0, ()), (1, 13, 12, ("5", "8")), (2, 4, 4, ())]
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(want)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    clean = decontamination.decontaminate(d, b, piece_chars=piece).collect()
    assert Counter(tuple(r) for r in clean) == Counter(docs[1:4])
