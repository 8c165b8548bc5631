import random

import numpy as np

from lumagrid.llm import quality


def test_labels_and_languages(spark):
    """Labelled rows of low quality go, although one odd trusted text is as odd; trusted rows stay in rare languages too."""
    rng = random.Random(4)
    words = {g: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(300)] for g, letters in (("en", "etaoinshr"), ("es", "aeoslrndñ"))}
    text = lambda g, n: " ".join(rng.choices(words[g], k=n))
    odd = lambda g, n, share: " ".join(w if rng.random() > share else "".join(rng.choices("etaoinshrdlu", k=len(w))) for w in rng.choices(words[g], k=n))
    rows, labels = [], []
    for g, n in (("en", 700), ("es", 90)):
        for k in range(n):
            labels.append((len(rows), 1, 0))
            rows.append((len(rows), odd(g, 100, 0.9) if g == "en" and k % 140 == 7 else text(g, rng.randint(40, 400)), g))
    poor = range(len(rows), len(rows) + 150)
    for _ in poor:
        labels.append((len(rows), 0, 0))
        rows.append((len(rows), odd("en", rng.randint(60, 300), 0.5), "en"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([got[k].kept for k in poor]) < 0.05
    assert np.mean([got[k].kept for k in range(700)]) > 0.95
    assert np.mean([got[k].kept for k in range(700, 790)]) > 0.95
    limits = [{r.upper for r in got.values() if r.lang == g} for g in ("en", "es")]
    assert not limits[0] & limits[1]
