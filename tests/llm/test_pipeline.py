import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumagrid.llm import quality
from lumagrid.llm.bpe import ByteBpe
from lumagrid.llm.queries import tokenizer_path
from lumagrid.llm.shared import clean, scratch, scratch_folder, shared_dir, table
from tests.llm.test_pairs import brute
from tests.llm.test_text import ALNUM, LOW, reference_spans

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_equal_plain_versions(spark):
    """Each stage on what its predecessor kept, held against a plain version of its operator."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    names = docs.columns
    text_at, id_at = names.index("text"), names.index("doc_id")
    start = rows_of(docs)

    good = stages["quality"](spark, docs, SF)
    labels = table(spark, SF, "labels")
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert good.columns == names and Counter(rows_of(good)) == Counter(r for r in start if r[id_at] in kept)
    judged = {r.doc_id: r for r in quality.classify(docs, labels, broadcast=0).collect()}
    assert {i for i, r in judged.items() if r.kept} == kept and 0.5 * len(start) < len(kept) < len(start)

    good = spark.createDataFrame(good.collect(), docs.schema)
    one = stages["near_duplicates"](spark, good, SF)
    _, classes = brute([(r[id_at], r[text_at]) for r in rows_of(good)])
    assert one.columns == names and Counter(rows_of(one)) == Counter(r for r in rows_of(good) if classes[r[id_at]] == r[id_at])

    one = spark.createDataFrame(one.collect(), docs.schema)
    apart = stages["decontamination"](spark, one, SF)
    split = lambda t: ALNUM.findall((t or "").encode().translate(LOW))
    windows = {tuple(w[k : k + 10]) for r in table(spark, SF, "benchmark").collect() for w in [split(r.text)] for k in range(max(min(1, len(w)), len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    assert apart.columns == names and Counter(rows_of(apart)) == Counter(r for r in rows_of(one) if not hit(split(r[text_at])))

    apart = spark.createDataFrame(apart.collect(), docs.schema)
    safe = stages["personal_data"](spark, apart, SF)
    assert safe.columns == names
    before, after = {r[id_at]: r for r in rows_of(apart)}, {r[id_at]: r for r in rows_of(safe)}
    assert before.keys() == after.keys()
    for i, row in before.items():
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in reference_spans(row[text_at]).split(",") if s]
        out, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                out += [row[text_at][at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        plain = "".join([*out, row[text_at][at:]])
        # terms are replaced beside the values: with them put aside, only words of three letters or more are gone
        terms = re.escape(after[i][text_at]).replace(re.escape("[TERM]"), r"[^\W\d_]{3,}")
        assert re.fullmatch(terms, plain), i
        assert row[:text_at] + row[text_at + 1 :] == after[i][:text_at] + after[i][text_at + 1 :]

    safe = spark.createDataFrame(safe.collect(), docs.schema)
    bpe = ByteBpe(tokenizer_path())
    for r in stages["encoding"](spark, safe, SF).collect():
        ids = bpe.tokenizer.encode(after[r.doc_id][text_at], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == after[r.doc_id][text_at]

    whole = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: r[text_at] for i, r in after.items()}


def test_stages_on_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words to keep here", "en", 1, "x", 2), (None, None, None, None, "y", 3)], "doc_id long, text string, lang string, seen int, own_id string, spans int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 2


def test_scratch_is_deleted_and_a_cluster_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    import os

    df = spark.range(5)
    with scratch(spark) as keep:
        kept = keep(df)
        gone = scratch_folder(spark)
        df.write.parquet(gone)
    assert kept.count() == 5 and not os.path.exists(gone)
    path = kept.scratch_path
    with pytest.raises(KeyError), scratch(spark) as keep:
        lost = keep(df)
        raise KeyError
    assert not os.path.exists(lost.scratch_path) and os.path.exists(path)
    clean(spark)
    assert not os.path.exists(path)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None if key == "spark.checkpoint.dir" else default)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(spark)
