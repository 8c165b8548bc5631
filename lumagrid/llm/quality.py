"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts of n-grams are gathered over all trusted text; continuation counts, context totals, discounts and the
interpolated probabilities then come from joins of the count tables, sharded by context and by suffix. A document's
perplexity is the geometric mean of its bytes' inverse probabilities. Limits are quantiles of the perplexities of trusted
documents left out of the counts, for each language and length class; documents outside them are rejected. Labelled
documents of low quality choose the level of the quantiles. Each group's median and the distance of its quantiles from
it are drawn towards those of its language, its length class and all documents, the more the fewer documents it has.
Texts that stand in the counts are more predictable than others: the lower limit does not hold for them.

The mean hides a few words that no trusted text would use. So the same model also counts a document's surprises, bytes
that cost ODD bits or more, and their number is held to its own upper quantile of the same groups.

A table of up to BROADCAST probabilities goes to the tasks; a larger one is joined to the documents' n-grams by shuffle.
Both give the same results.

Defined results: null and empty texts have no perplexity (1, without surprises) and are rejected; documents with a
language without trusted text, or without a language, are held to the quantiles over all languages; if there is no
trusted text, all with text are kept; an empty table gives an empty result. Long texts are judged whole. Rows of one id
are judged each; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lumagrid.llm import text as T
from lumagrid.llm.mixing import _merge, sixes
from lumagrid.llm.shared import SMALL, fresh, only, saved, scratch

ORDER = 5
#: Bytes of text that are worked on at once.
SLICE = 1 << 19
BROADCAST = 4_000_000
#: Levels of the lower and upper quantile that labelled rows choose from, the widest first.
LEVELS = ((0.001, 0.005, 0.01, 0.02, 0.03), (0.999, 0.995, 0.99, 0.98, 0.97))
#: Bytes that part the length classes.
CLASSES = (200, 800, 3200)
#: Held-out documents that weigh as much as the wider group: for a group's median, and for its quantiles' distance from it.
MEDIAN_PRIOR, SPREAD_PRIOR = 5, 100
#: Steps of a doubling of perplexity in which held-out documents are counted.
STEPS = 128
#: One trusted document in so many is left out of the counts and sets the limits.
ASIDE = 4
#: Bits from which on a byte is a surprise, and the quantile of their number in trusted documents that is the limit.
ODD, ODD_LEVEL = 11.0, 0.999
#: Languages, the most frequent ones, that may have limits of their own; what each needs in the driver is bounded.
LANGUAGES = 50_000


def _grams(batches):
    """Distinct n-grams of the highest order with counts, added up within the task."""
    keys, counts = [], []
    for batch in batches:
        for _, buf, off in T.slices(batch, "text", SLICE):
            k, n = _merge([sixes(buf, off) & np.uint64((1 << 8 * ORDER) - 1)], [np.ones(len(buf))])
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > 4_000_000:
                k, n = _merge(keys, counts)
                keys, counts = [k], [n]
                if len(k) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["gram", "c"])
                    keys, counts = [], []
    k, n = _merge(keys, counts)
    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["gram", "c"])


def kneser_ney(text: DataFrame, order: int = ORDER) -> DataFrame:
    """text (text): k, gram, p (probability of the last byte after the others) and k, gram, g (weight that a context leaves to shorter ones); gram holds k bytes, the last one lowest."""
    counts = [saved(text.select("text").mapInArrow(_grams, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))]
    for k in range(order - 1, 0, -1):  # continuation counts: how many different bytes stand before
        counts.insert(0, saved(counts[0].groupBy(F.expr(f"gram & {(1 << 8 * k) - 1}L").alias("gram")).agg(F.count("*").alias("c"))))
    out, lower = None, None
    for k, table in enumerate(counts, 1):
        n1, n2, n3, n4 = table.agg(*(F.coalesce(F.sum((F.col("c") == r).cast("long")), F.lit(0)) for r in (1, 2, 3, 4))).first()
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        d = [min(max(r - (r + 1) * y * b / a, 0.05 * r), 0.95 * r) if a and b else 0.5 * min(r, 1.5) for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        table = table.select("gram", F.shiftright("gram", 8).alias("ctx"), F.expr(f"gram & {(1 << 8 * (k - 1)) - 1}L").alias("tail"), "c", cut.alias("d"))
        context = table.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        joined = table.join(context, "ctx")
        below = F.lit(1 / 256) if lower is None else F.col("below")
        if lower is not None:
            joined = joined.join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
        lower = saved(joined.select("gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * below).alias("p")))
        rows = lower.select(F.lit(k).alias("k"), "gram", "p", F.lit(None).cast("double").alias("g")).unionByName(context.select(F.lit(k).alias("k"), F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("p"), "g"))
        out = rows if out is None else out.unionByName(rows)
    return saved(out)


class Model:
    """A table of kneser_ney as sorted arrays."""

    def __init__(self, rows: pa.Table, order: int = ORDER):
        self.order, self.p, self.g = order, [], []
        kind, gram = rows["k"].to_numpy(), rows["gram"].to_numpy()
        for name, to in (("p", self.p), ("g", self.g)):
            value = rows[name].to_numpy()  # null is not a number here
            for k in range(1, order + 1):
                own = np.flatnonzero((kind == k) & ~np.isnan(value))
                own = own[np.argsort(gram[own])]
                to.append((gram[own], np.log2(value[own])))

    @staticmethod
    def _find(table, keys):
        where, values = table
        if not len(where):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(where, keys), len(where) - 1)
        return where[at] == keys, values[at]

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each n-gram."""
        keys, out, open_ = keys.view(np.int64), np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            own = keys[open_] & ((1 << 8 * k) - 1)
            seen, p = self._find(self.p[k - 1], own)
            out[open_[seen]] -= p[seen]
            open_, own = open_[~seen], own[~seen]
            there, g = self._find(self.g[k - 1], own >> 8)
            out[open_] -= np.where(there, g, 0.0)
        out[open_] += 8.0
        return out

    def bits(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text, and how many of its bytes cost ODD or more."""
        code, found = pd.factorize(sixes(buf, off) & np.uint64((1 << 8 * self.order) - 1))
        cost = self.cost(found)[code]
        run, odd = np.concatenate([[0.0], np.cumsum(cost)]), np.concatenate([[0], np.cumsum(cost >= ODD)])
        return run[off[1:]] - run[off[:-1]], odd[off[1:]] - odd[off[:-1]]


def joined_bits(rows: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """rows (key, text) with n_bytes, bits and odd, by joins with a table of kneser_ney of any size."""

    def grams(batches):
        for batch in batches:
            for part, buf, off in T.slices(batch, "text", SLICE):
                key = sixes(buf, off) & np.uint64((1 << 8 * order) - 1)
                row = np.repeat(np.arange(part.num_rows), np.diff(off))
                o = np.lexsort([key, row])
                key, row = key[o], row[o]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[new])), pa.array(key[new].view(np.int64)), pa.array(np.diff(np.append(new, len(key))))], ["key", "gram", "n"])

    pairs = rows.select("key", "text").mapInArrow(grams, "key long, gram long, n long")
    cost = pairs.select("gram").distinct().withColumns({"bits": F.lit(0.0), "open": F.lit(True)})
    for k in range(order, 0, -1):
        own = F.expr(f"gram & {(1 << 8 * k) - 1}L")
        p = table.where(f"k = {k} and p is not null").select(F.col("gram").alias("at"), F.log2("p").alias("lp"))
        g = table.where(f"k = {k} and g is not null").select(F.col("gram").alias("before"), F.log2("g").alias("lg"))
        if k <= 2:  # at most 256 ** k rows, of which a shuffle would make hot keys
            p, g = F.broadcast(p), F.broadcast(g)
        cost = cost.withColumns({"at": own, "before": F.shiftright(own, 8)}).join(p, "at", "left").join(g, "before", "left")
        more = F.when(~F.col("open"), 0.0).when(F.col("lp").isNotNull(), -F.col("lp")).otherwise(-F.coalesce("lg", F.lit(0.0)))
        cost = cost.select("gram", (F.col("bits") + more).alias("bits"), (F.col("open") & F.col("lp").isNull()).alias("open"))
    cost = cost.select("gram", (F.col("bits") + F.when(F.col("open"), 8.0).otherwise(0.0)).alias("bits"))
    odd = F.sum(F.when(F.col("bits") >= ODD, F.col("n")).otherwise(0))
    return pairs.join(cost, "gram").groupBy("key").agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.col("bits")).alias("bits"), odd.alias("odd"))


def _quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    o = np.argsort(values)
    run = np.cumsum(n[o])
    return float(values[o][min(np.searchsorted(run, q * run[-1] * (1 - 1e-12)), len(o) - 1)])


def _drawn(part: pd.DataFrame, column: str, q: float, prior: float, weight: float) -> float:
    """A group's quantile, drawn towards the prior."""
    n = part["n"].sum()
    return (n * _quantile(part[column].to_numpy(), part["n"].to_numpy(), q) + weight * prior) / (n + weight) if n else prior


def _by_group(good: pd.DataFrame, qs: list[float]) -> dict:
    """Quantiles of each language and length class, as steps."""
    kinds = range(len(CLASSES) + 1)
    good = good[good["lang"].notna()].copy()
    if not len(good):
        return {}
    all_ = _quantile(good["step"].to_numpy(), good["n"].to_numpy(), 0.5)
    by_size = {k: good[good["size"] == k] for k in kinds}
    by_lang = dict(list(good.groupby("lang")))
    size_mid = {k: _drawn(part, "step", 0.5, all_, MEDIAN_PRIOR) for k, part in by_size.items()}
    mid = {}
    for lang, part in by_lang.items():
        own = _drawn(part, "step", 0.5, all_, MEDIAN_PRIOR)
        for k in kinds:
            mid[lang, k] = _drawn(part[part["size"] == k], "step", 0.5, own + size_mid[k] - all_, MEDIAN_PRIOR)
    good["off"] = good["step"] - [mid[g] for g in zip(good["lang"], good["size"])]
    by_size = {k: good[good["size"] == k] for k in kinds}
    out = {g: [] for g in mid}
    for q in qs:
        off = _quantile(good["off"].to_numpy(), good["n"].to_numpy(), q)
        size_off = {k: _drawn(part, "off", q, off, SPREAD_PRIOR) for k, part in by_size.items()}
        for lang, part in good.groupby("lang"):
            own = _drawn(part, "off", q, off, SPREAD_PRIOR)
            for k in kinds:
                out[lang, k].append(mid[lang, k] + _drawn(part[part["size"] == k], "off", q, own + size_off[k] - off, SPREAD_PRIOR))
    return out


def limits_by_group(rows: pd.DataFrame, levels=LEVELS) -> dict:
    """rows (lang, size, ok, step, n): counts of held-out documents. Lower and upper perplexity by language (None: any) and length class."""
    lower, upper = levels
    good = rows[rows["ok"]]
    if not len(good):
        return {}
    found = {(None, k): v for (_, k), v in _by_group(good.assign(lang=""), [*lower, *upper]).items()}
    found |= _by_group(good, [*lower, *upper])
    at = np.array([found.get((g, k)) or found[None, k] for g, k in zip(rows["lang"], rows["size"])])
    step, n, ok = rows["step"].to_numpy(), rows["n"].to_numpy(), rows["ok"].to_numpy()
    best = None
    for i in range(len(lower)):
        for j in range(len(upper)):
            kept = (step >= np.floor(at[:, i])) & (step <= np.floor(at[:, len(lower) + j]))
            gain = n[ok & kept].sum() / n[ok].sum() - (n[~ok & kept].sum() / n[~ok].sum() if n[~ok].sum() else 0)
            if best is None or gain > best[0] + 1e-9:
                best = gain, i, j
    _, i, j = best
    return {g: (float(2 ** (np.floor(v[i]) / STEPS)), float(2 ** ((np.floor(v[len(lower) + j]) + 1) / STEPS))) for g, v in found.items()}


def odd_limits(rows: pd.DataFrame, level: float = ODD_LEVEL) -> dict:
    """rows (lang, size, ok, odd, n): most surprises by language (None: any) and length class."""
    good = rows[rows["ok"]].rename(columns={"odd": "step"})
    if not len(good):
        return {}
    found = {(None, k): v for (_, k), v in _by_group(good.assign(lang=""), [level]).items()} | _by_group(good, [level])
    return {g: float(np.ceil(max(v[0], 0.0))) for g, v in found.items()}


class Judge:
    """All that a decision needs."""

    def __init__(self, model: Model | None, limits: dict, most: dict):
        self.model, self.limits, self.most = model, limits, most

    def measure(self, buf: np.ndarray, off: np.ndarray):
        """Perplexity and surprises of each text."""
        size = np.diff(off)
        if not self.model:
            return np.ones(len(size)), np.zeros(len(size), np.int64)
        bits, odd = self.model.bits(buf, off)
        return np.exp2(np.minimum(bits / np.maximum(size, 1), 60)), odd

    def decide(self, langs: list, seen: np.ndarray, size: np.ndarray, perplexity: np.ndarray, odd: np.ndarray):
        """Lower and upper limit of perplexity, limit of surprises, and whether each text is kept."""
        groups = list(zip(langs, np.searchsorted(CLASSES, size, "right").tolist()))
        lo, hi = np.array([self.limits.get(g) or self.limits.get((None, g[1])) or (0.0, np.inf) for g in groups]).reshape(-1, 2).T
        most = np.array([self.most.get(g, self.most.get((None, g[1]), np.inf)) for g in groups], float)
        lo = np.where(seen, 0.0, lo)
        return lo, hi, most, (size > 0) & (perplexity >= lo) & (perplexity <= hi) & (odd <= most)


def _flagged(docs: DataFrame, text: str, seen: DataFrame, flag: str) -> DataFrame:
    """docs with a column that says whether the text stands in the counts."""
    h, s = fresh(docs, "text_hash"), fresh(docs, "seen_hash")
    seen = seen.select(F.col("h").alias(s), F.lit(True).alias(flag))
    joined = docs.withColumn(h, F.xxhash64(text)).join(F.broadcast(seen) if seen.count() <= SMALL else seen, F.col(h) == F.col(s), "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False))).drop(h, s)


def _measured(rows: DataFrame, judge: Judge, table: DataFrame | None) -> DataFrame:
    """rows (text, ...) with n_bytes, perplexity and odd: by the judge's model, or by joins with the table."""
    if table is not None:
        # the key must stand in files: it is read for both sides of a join
        rows = saved(rows.withColumn("key", F.monotonically_increasing_id()))
        out = rows.join(joined_bits(rows, table), "key", "left").drop("key")
        return out.select(*rows.drop("key").columns, F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.expr("case when n_bytes > 0 then pow(2D, least(60D, bits / n_bytes)) else 1D end").alias("perplexity"), F.coalesce("odd", F.lit(0)).alias("odd"))
    sent = rows.sparkSession.sparkContext.broadcast(judge)

    def work(batches):
        for batch in batches:
            for part, buf, off in T.slices(batch, "text", SLICE):
                perplexity, odd = sent.value.measure(buf, off)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(off), pa.int64()), pa.array(perplexity), pa.array(odd, pa.int64())], [*part.schema.names, "n_bytes", "perplexity", "odd"])

    more = [StructField("n_bytes", LongType()), StructField("perplexity", DoubleType()), StructField("odd", LongType())]
    return rows.mapInArrow(work, StructType([*rows.schema.fields, *more]))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", levels=LEVELS, broadcast: int = BROADCAST) -> tuple[Judge, DataFrame | None, DataFrame]:
    """The judge, the table of probabilities if it is too large to send out, and the hashes of the texts in the counts."""
    with scratch(docs.sparkSession) as keep:
        known = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("most"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("t = 0")
        good, poor = known.where("q = 1"), known.where("most = 0")
        slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        trusted = only(slim, good, "doc_id").where("length(text) > 0")
        # limits come from trusted documents that the counts have not seen
        aside = F.pmod(F.xxhash64("doc_id"), F.lit(ASIDE)) == 0
        table = kneser_ney(trusted.where(~aside))
        seen = saved(trusted.where(~aside).select(F.xxhash64("text").alias("h")).distinct())
        n = table.count()
        if not n:
            return Judge(None, {}, {}), None, keep(seen)
        judge = Judge(Model(table.toArrow()) if n <= broadcast else None, {}, {})
        rest = None if judge.model else table
        held = trusted.where(aside).withColumn("ok", F.lit(True)).unionByName(only(slim, poor, "doc_id").where("length(text) > 0").withColumn("ok", F.lit(False)))
        size = F.expr("case " + " ".join(f"when n_bytes < {c} then {k}" for k, c in enumerate(CLASSES)) + f" else {len(CLASSES)} end")
        own = _measured(held.select("text", "lang", "ok"), judge, rest).select("lang", "ok", size.alias("size"), F.floor(F.log2("perplexity") * STEPS).alias("step"), "odd")
        own = saved(own.groupBy("lang", "size", "ok", "step", "odd").agg(F.count("*").alias("n")))
        often = own.where("ok and lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", F.col("lang").alias("own"))
        rows = own.join(F.broadcast(often), "lang", "left")
        judge.limits, judge.most = (make(rows.groupBy(F.col("own").alias("lang"), "size", "ok", c).agg(F.sum("n").alias("n")).toArrow().to_pandas(), *more) for make, c, more in ((limits_by_group, "step", (levels,)), (odd_limits, "odd", ())))
        keep(seen)
        if rest is not None:
            keep(rest)
    return judge, rest, seen


def classify(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, lang, perplexity, lower, upper, surprises, most, kept; one row per row of docs."""
    judge, table, seen = train(docs, labels, doc, text, lang, **options)
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return _judged(_flagged(slim, "text", seen, "seen"), judge, table)


def _judged(slim: DataFrame, judge: Judge, table: DataFrame | None) -> DataFrame:
    if table is not None:
        slim = _measured(slim, judge, table).drop("text")
    sent, joined = slim.sparkSession.sparkContext.broadcast(judge), table is not None

    def work(batches):
        judge = sent.value
        for batch in batches:
            for rows, size, perplexity, odd in _numbers(batch, judge, joined):
                lo, hi, most, kept = judge.decide(rows.column("lang").to_pylist(), rows.column("seen").to_numpy(zero_copy_only=False), size, perplexity, odd)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array(perplexity), pa.array(lo), pa.array(hi), pa.array(odd, pa.int64()), pa.array(most), pa.array(kept)], ["doc_id", "lang", "perplexity", "lower", "upper", "surprises", "most", "kept"])

    return slim.mapInArrow(work, "doc_id long, lang string, perplexity double, lower double, upper double, surprises long, most double, kept boolean")


def _numbers(batch: pa.RecordBatch, judge: Judge, joined: bool, text: str = "text"):
    """Slices of a batch with bytes, perplexity and surprises of each row: measured here, or columns of the batch."""
    if joined:
        yield batch, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_bytes", "perplexity", "odd"))
        return
    for rows, buf, off in T.slices(batch, text, SLICE):
        yield rows, np.diff(off), *judge.measure(buf, off)


def keep_good(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    judge, table, seen = train(docs, labels, doc, text, lang, **options)
    whole = docs.schema
    if table is not None:  # decide by joins on a key that stands in files, and join the decision back
        key = fresh(docs, "row_key")
        docs = saved(docs.withColumn(key, F.monotonically_increasing_id()))
        slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        kept = _judged(_flagged(slim, "text", seen, "seen"), judge, table).where("kept").select(F.col("doc_id").alias(key))
        return docs.join(kept, key, "left_semi").drop(key)
    flag = fresh(docs, "seen")
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def work(batches):
        judge = sent.value
        for batch in batches:
            for rows, size, perplexity, odd in _numbers(batch, judge, False, text):
                *_, kept = judge.decide(rows.column(lang).cast(pa.string()).to_pylist(), rows.column(flag).to_numpy(zero_copy_only=False), size, perplexity, odd)
                yield rows.filter(pa.array(kept)).select(whole.names)

    return _flagged(docs, text, seen, flag).mapInArrow(work, whole)
