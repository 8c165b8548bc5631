"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte 1-, 2- and 3-grams (lower case). Embeddings and softmax are
learned together on a bounded sample of labelled documents (`per_language` and `rows`); a part of the sample is kept back
to set the temperature and the limit under which a prediction is rejected. Prediction runs over whole texts, in slices of
bounded size or one long text, and uses nothing but the text.

Defined results: texts that are null or have no letter are `und` with score 0; other texts get a learned language with
its probability, and accepted says whether it passed the limit. Rows of one id are each predicted. If nothing can be
learned, all texts are `und`. An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm import text as T

ORDERS = (1, 2, 3)
BUCKETS = 1 << 13
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _grams(low: np.ndarray):
    """For each order: bucket of the gram at each position."""
    key = np.zeros(len(low), np.uint32)
    for k, n in enumerate(ORDERS):
        key = key[: max(0, len(low) - n + 1)] | low[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))
        yield n, (key * np.uint32(_ODD[k]) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - 13)


def _histograms(batches):
    for batch in batches:
        for rows, buf, off in T.slices(batch, "text"):
            low = T.LOWER[buf]
            keys, counts = [], []
            for a, b in zip(off[:-1], off[1:]):
                h = sum(np.bincount(g, minlength=BUCKETS) for _, g in _grams(low[a:b]))
                seen = np.flatnonzero(h)
                keys.append(T.blob(seen.astype("<i4")))
                counts.append(T.blob((h[seen] / max(1, h.sum())).astype("<f4")))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["lang", "keys", "weights"])


class Model:
    """Languages, per-bucket scores and how to read them."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, limit: float):
        self.languages, self.table, self.bias, self.temperature, self.limit = languages, table, bias, temperature, limit

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.zeros((len(off) - 1, len(self.languages)))
        grams = np.zeros(len(off) - 1)
        for n, g in _grams(T.LOWER[buf]):
            end = np.maximum(off[1:] - n + 1, off[:-1])
            start = np.minimum(off[:-1], len(g))
            end = np.minimum(end, len(g))
            grams += end - start
            for c in range(total.shape[1]):
                run = np.concatenate([[0.0], np.cumsum(self.table[c][g])])
                total[:, c] += run[end] - run[start]
        return softmax((total / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(x: list[tuple[bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(x), BUCKETS), np.float32)
    for r, (k, w) in enumerate(x):
        out[r, np.frombuffer(k, "<i4")] = np.frombuffer(w, "<f4")
    return out


def fit(samples: list[tuple[str, bytes, bytes]], size: int = 16, epochs: int = 12, rate: float = 0.5, reject: float = 0.005, seed: int = 7) -> Model | None:
    """samples: language, buckets, weights. Adagrad steps over shuffled minibatches."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = order[: len(order) // 8] if len(order) >= 40 else order
    own = order[len(order) // 8 :] if len(order) >= 40 else order
    y = np.array([languages.index(s[0]) for s in samples])
    e = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    w = rng.normal(0, 0.1, (size, len(languages))).astype(np.float32)
    b = np.zeros(len(languages), np.float32)
    past = [np.full_like(v, 1e-6) for v in (e, w, b)]
    for _ in range(epochs):
        own = rng.permutation(own)
        for at in range(0, len(own), 64):
            rows = own[at : at + 64]
            x = _rows([samples[r][1:] for r in rows])
            hidden = x @ e
            g = softmax(hidden @ w + b).astype(np.float32)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            for v, s, step in zip((e, w, b), past, (x.T @ (g @ w.T), hidden.T @ g, g.sum(0))):
                s += step * step
                v -= rate * step / np.sqrt(s)
    z = np.concatenate([_rows([samples[r][1:] for r in held[at : at + 64]]) @ e @ w + b for at in range(0, len(held), 64)])
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    t = min((0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = softmax(z / t)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(languages, np.ascontiguousarray((e @ w).T.astype(np.float64)), b.astype(np.float64), t, float(np.quantile(right, reject)) if len(right) else 0.0)


def train(docs: DataFrame, per_language: int = 1000, rows: int = 16_000, lang: str = "lang", text: str = "text", doc: str = "doc_id") -> Model | None:
    """Fit on a sample of labelled rows of docs: about per_language distinct texts of each language, or fewer if there are
    so many languages that this would be more than rows in all; chosen by a hash, so that the sample does not depend on
    how rows are dealt out. Its size is bounded by twice rows, whatever the input."""
    known = docs.select(F.col(doc).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return None
    each = min(per_language, max(1, rows // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, each / r["count"]) * (1 << 40))) for r in counts], "lang string, share long")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    chosen = known.join(F.broadcast(shares), "lang").withColumn("place", place).where("place < share or share = 0")
    # copies of a text are one sample
    chosen = chosen.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("place").alias("place"), F.first("text").alias("text")).orderBy("place", "lang", "h").limit(2 * rows)
    got = chosen.select("lang", "text").mapInArrow(_histograms, "lang string, keys binary, weights binary").collect()
    return fit([(r.lang, bytes(r["keys"]), bytes(r.weights)) for r in sorted(got, key=lambda r: (r.lang, bytes(r["keys"]), bytes(r.weights)))])


def predict(docs: DataFrame, model: Model | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    def work(batches):
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for part, buf, off in T.slices(batch, "text"):
                p = model.probabilities(buf, off)
                letters = np.array(part.column(2).to_pylist(), bool)
                best, score = np.where(letters, p.argmax(1), -1), np.where(letters, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(letters & (score >= model.limit))], ["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, accepted boolean")
