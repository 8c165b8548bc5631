"""How filters interact: what each one removes, in every order and every part of a corpus, from sorted posting lists.

Rows get ids by the task that reads them, and ids are cut into ranges of a bounded number. For each range, part and
filter there is a sorted list of the ids that fail, beside lists of all ids and of those with a mark (labels of which
losses are counted). Unions of the lists of several filters, and the differences of a filter's list and such a union,
are galloping merges of all parts' lists of a range at once: stretches of ids that only one list holds are skipped over
by doubling steps, and where lists interleave they are merged window by window. What an order's step removes depends on
the set of filters before it only, so sizes are summed over ranges for each (filter, set before it) and then laid out
for all orders. A hot part is as many ranges as others, and no list grows with it.

Defined results: a row is a document, rows of one id too; null text is empty; a null part is the empty string; rows
without id are never a copy of another (of which they have no smaller id), but others are not a copy of them either; a
document has a mark if any row of labels with its id says so; texts are identical if their SHA-256 is; an empty table
gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import heapq
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.shared import saved

#: Bits of an id within its range, ids that one window of a merge takes of a list, parts whose sums a task holds.
RANGE_BITS, WINDOW, PARTS = 16, 4096, 4096
#: The filters on texts, and the marks whose losses are counted (fixed values).
FILTERS = ("A", "B", "C", "D", "E")
_MARKED = np.zeros(256, bool)
_MARKED[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def judge(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Which texts of a slice fail: A under 50 words, B under 65 % distinct words, C over 5 % capitals, D marks that prose does not have."""
    starts, ends, rows = T.spans(buf, off, T.SPACED)
    words = np.diff(rows)
    codes, found = pd.factorize(T.hashes(buf, starts, ends))
    key = np.repeat(np.arange(len(words)), words) * max(1, len(found)) + codes
    key.sort()
    first = np.diff(key, prepend=-1) > 0
    distinct = np.bincount(key[first] // max(1, len(found)), minlength=len(words))
    capitals, letters = _per_row(_UPPER[buf], off), _per_row(buf & 0xC0 != 0x80, off)
    return {"A": words < 50, "B": 100 * distinct < 65 * words, "C": 100 * capitals > 5 * letters, "D": _per_row(_MARKED[buf], off) > 0}


def failures(docs: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """row, doc_id, part and a boolean for each of the filters A to E, which is true where the document fails."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    names = ["row", "doc_id", "part", "digest", *FILTERS[:4]]

    def work(batches):
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, buf, off in T.slices(batch, "text"):
                fails = judge(buf, off)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + rows.num_rows)), rows.column(0), rows.column(1), rows.column(3), *(pa.array(fails[f]) for f in FILTERS[:4])], names)
                row += rows.num_rows

    rows = saved(slim.mapInArrow(work, "row long, doc_id long, part string, digest binary" + "".join(f", {f} boolean" for f in FILTERS[:4])))
    # written, so that its join shuffles both sides anew and Spark can split a text that very many documents hold
    copied = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(copied, "digest", "left").select("row", "doc_id", "part", *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def posting_lists(rows: DataFrame, filters: tuple[str, ...], marks: tuple[str, ...]) -> DataFrame:
    """range, lists (part, list, ids: places in the range, in order, as unsigned 16-bit integers): one row per range of row ids.

    rows: row (a unique id), part, and a boolean column for each filter and mark. The list of all ids is named "all".
    """
    names = ("all", *filters, *marks)

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("row", "ascending")])
        ids = (group["row"].to_numpy() & ((1 << RANGE_BITS) - 1)).astype("<u2")
        parts = group["part"].to_pylist()
        edge = [0, *(k for k in range(1, len(parts)) if parts[k] != parts[k - 1]), len(parts)]
        flags = {n: group[n].to_numpy() if n != "all" else np.ones(len(ids), bool) for n in names}
        lists = [{"part": parts[a], "list": n, "ids": ids[a:b][flags[n][a:b]].tobytes()} for a, b in zip(edge[:-1], edge[1:]) for n in names]
        kind = pa.list_(pa.struct([("part", pa.string()), ("list", pa.string()), ("ids", pa.binary())]))
        return pa.table({"range": group["range"][:1], "lists": pa.array([[x for x in lists if x["ids"]]], kind)})

    own = rows.select(F.shiftright("row", RANGE_BITS).alias("range"), "row", "part", *filters, *marks)
    return own.groupBy("range").applyInArrow(build, "range long, lists array<struct<part: string, list: string, ids: binary>>")


def gallop(a: np.ndarray, at: int, bound: int) -> int:
    """The first place from at on whose value is not under bound, by doubling steps and a binary search in the last one."""
    step, low = 1, at
    while at + step < len(a) and a[at + step] < bound:
        low, step = at + step, step * 2
    return low + int(np.searchsorted(a[low : at + step + 1], bound))


def union(lists: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Union of sorted lists of distinct ids."""
    at, out = [0] * len(lists), [np.zeros(0, np.int64)]
    heap = [(int(a[0]), k) for k, a in enumerate(lists) if len(a)]
    heapq.heapify(heap)
    while heap:
        least, k = heap[0]
        end = gallop(lists[k], at[k], min(h[0] for h in heap[1:3])) if len(heap) > 1 else len(lists[k])
        if len(heap) == 1 or end - at[k] >= window // 64:  # a stretch that this list has for itself
            out.append(lists[k][at[k] : end])
            at[k] = end
            heapq.heappop(heap)
            if end < len(lists[k]):
                heapq.heappush(heap, (int(lists[k][end]), k))
            continue
        bound = min(int(lists[j][min(at[j] + window, len(lists[j])) - 1]) for _, j in heap)
        parts = []
        for _, j in heap:
            end = gallop(lists[j], at[j], bound + 1) if lists[j][at[j]] <= bound else at[j]
            parts.append(lists[j][at[j] : end])
            at[j] = end
        out.append(np.unique(np.concatenate(parts)))
        heap = [(int(lists[j][at[j]]), j) for _, j in heap if at[j] < len(lists[j])]
        heapq.heapify(heap)
    return np.concatenate(out)


def difference(a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ids of the sorted list a that the sorted list b does not hold."""
    out, at, k = [np.zeros(0, np.int64)], 0, 0
    while k < len(a):
        at = gallop(b, at, int(a[k])) if at < len(b) and b[at] < a[k] else at
        if at == len(b):
            out.append(a[k:])
            break
        end = gallop(a, k, int(b[at])) if a[k] < b[at] else k
        if end - k >= window // 64:  # a stretch that b has nothing of
            out.append(a[k:end])
            k = end
            continue
        own = a[k : k + window]
        to = gallop(b, at, int(own[-1]) + 1)
        place = np.searchsorted(b[at:to], own)
        out.append(own[(place == to - at) | (b[at:to][np.minimum(place, max(0, to - at - 1))] != own) if to > at else slice(None)])
        k, at = k + window, to
    return np.concatenate(out)


def _sets(n: int) -> list[tuple[int, int]]:
    """(filter, set of filters before it as bits), for all sets that do not hold the filter."""
    return [(f, s) for f in range(n) for s in range(1 << n) if not s >> f & 1]


def interactions(lists: DataFrame, filters: tuple[str, ...], marks: tuple[str, ...]) -> DataFrame:
    """part, filter (its place), before (set of filters as bits), total, gone (fail one of the set), fails, removed, and lost_<mark>."""
    cases, n = _sets(len(filters)), len(filters)
    columns = ["total", "gone", "fails", "removed", *(f"lost_{m}" for m in marks)]

    def sizes(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(ids, bounds))

    def of_range(own: list[dict]) -> tuple[list[str], np.ndarray]:
        parts = sorted({x["part"] for x in own})
        code = {p: k for k, p in enumerate(parts)}
        by: dict[str, list] = {}
        for x in sorted(own, key=lambda x: code[x["part"]]):
            by.setdefault(x["list"], []).append(np.frombuffer(x["ids"], "<u2").astype(np.int64) + (code[x["part"]] << RANGE_BITS))
        get = lambda name: np.concatenate([np.zeros(0, np.int64), *by.get(name, [])])
        bounds = np.arange(len(parts) + 1) << RANGE_BITS
        fails, marked = [get(f) for f in filters], [get(m) for m in marks]
        unions = {0: np.zeros(0, np.int64)}
        for s in range(1, 1 << n):
            low = s & -s
            unions[s] = union([unions[s ^ low], fails[low.bit_length() - 1]]) if s ^ low else fails[low.bit_length() - 1]
        out = np.zeros((len(parts), len(cases), len(columns)), np.int64)
        out[:, :, 0] = sizes(get("all"), bounds)[:, None]
        for k, (f, s) in enumerate(cases):
            removed = difference(fails[f], unions[s])
            lost = [sizes(removed, bounds) - sizes(difference(removed, m), bounds) for m in marked]
            out[:, k, 1:] = np.stack([sizes(unions[s], bounds), sizes(fails[f], bounds), sizes(removed, bounds), *lost], axis=1)
        return parts, out

    def work(batches):
        held: dict[str, np.ndarray] = {}

        def told():
            all_ = np.stack([*held.values()])
            names = pa.array(np.repeat(np.array([*held], object), len(cases)), pa.string())
            f, s = (np.tile(np.array([c[k] for c in cases]), len(held)) for k in (0, 1))
            flat = all_.reshape(-1, len(columns))
            yield pa.RecordBatch.from_arrays([names, pa.array(f.astype(np.int32)), pa.array(s.astype(np.int32)), *(pa.array(flat[:, k]) for k in range(len(columns)))], ["part", "filter", "before", *columns])

        for batch in batches:
            for own in batch.column(1).to_pylist():
                for part, sums in zip(*of_range(own)):
                    held[part] = held[part] + sums if part in held else sums
                if len(held) >= PARTS:
                    yield from told()
                    held = {}
        if held:
            yield from told()

    rows = lists.mapInArrow(work, "part string, filter int, before int, " + ", ".join(f"{c} long" for c in columns))
    return rows.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in columns])


def in_all_orders(sums: DataFrame, filters: tuple[str, ...], marks: tuple[str, ...]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley: for every order of the filters and step of it."""
    n, spark = len(filters), sums.sparkSession
    steps = [("".join(filters[f] for f in order), k + 1, order[k], sum(1 << f for f in order[:k])) for order in permutations(range(n)) for k in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")  # n! n rows, whatever the input
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    own = W.partitionBy("part", "filter")
    told = sums.withColumns({"shapley": F.sum(weight * F.col("removed")).over(own), "unique_fails": F.max(F.when(F.bit_count("before") == n - 1, F.col("removed"))).over(own)})
    out = told.join(F.broadcast(orders), ["filter", "before"])
    return out.select("part", "filter_order", "step", (F.col("total") - F.col("gone") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[F.col(f"lost_{m}").alias(f"{m}_lost") for m in marks], "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The filters A to E in all 120 orders, for each part; good and toxic ones among what is removed are counted from labels."""
    marks = ("good", "toxic")
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, doc, text, part).join(said, "doc_id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})
    lists = saved(posting_lists(rows, FILTERS, marks))
    return in_all_orders(interactions(lists, FILTERS, marks), FILTERS, marks)


