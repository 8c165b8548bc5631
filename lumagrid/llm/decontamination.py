"""Benchmark decontamination with suffix arrays over the training texts.

Every slice of documents is a shard with a suffix array over all its words, in order of the first sixteen words of each
suffix (prefix doubling). Each test suffix is looked up in each shard by binary search, word by word, so that the
interval left after a window's length holds all places where that window stands verbatim; places are then extended to
the longest match. A bit table of the shard's openings spares the search for suffixes whose first words it does not
have. No shuffle is needed: documents stay where they are, and the test set, whose size is measured first, is broadcast
in pieces of bounded size. Words are known by 64-bit hashes.

Defined results: null or wordless text has no words and is not contaminated; null or wordless items have no window;
items without an id have windows that hit, but name no item and no longest match; repeated rows are judged each on its
own, in one pass or several; long texts are one slice; an empty table gives an empty result; other columns are never
looked at, and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.shared import saved

WINDOW = 10
#: Characters of test text that one pass carries to the tasks; a larger test set takes more passes.
PIECE_CHARS = 8_000_000


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the words from there on, compared to a depth of at least so many words (nothing sorts first)."""
    first = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[first] = np.cumsum(np.concatenate([[1], (h[first][1:] != h[first][:-1]).astype(np.int64)])) if len(h) else 0
    done = 1
    while done < depth:
        key = rank * (len(h) + 2)
        key[: len(h) - done] += rank[done:]
        first = np.argsort(key, kind="stable")
        rank[first] = np.cumsum(np.concatenate([[1], (key[first][1:] != key[first][:-1]).astype(np.int64)])) if len(h) else 0
        done *= 2
        if len(h) and rank[first[-1]] == len(h):
            break
    return first


class TestSuffixes:
    """The suffixes of the test items at which a window starts."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        ids, texts = [i for i, _ in items], [(t or "").encode() for _, t in items]
        buf = T.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, ends, rows = T.spans(buf, off, T.ALNUM)
        h = T.hashes(buf, starts, ends)
        self.ids, self.window = np.array(ids, object), window
        words, item, at, size = [], [], [], []
        for k in range(len(ids)):
            own = h[rows[k] : rows[k + 1]]
            for i in range(max(min(len(own), 1), len(own) - window + 1)):
                words.append(np.concatenate([own[i : i + window], np.zeros(max(0, window - len(own)), np.uint64)]))
                item.append(k)
                at.append(i)
                size.append(min(window, len(own)))
        self.words = np.array(words, np.uint64).reshape(len(words), window)
        self.item, self.at, self.size = (np.array(x, np.int64) for x in (item, at, size))
        self.lead = int(min(3, self.size.min())) if size else 0
        self.rest = [h[rows[k] : rows[k + 1]] for k in range(len(ids))]
        self.opening = self._slot(*(self.words[:, k] for k in range(self.lead))) if self.lead else None
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or ""))
        self.rank = np.argsort(order)  # of each item among ids as strings

    @staticmethod
    def _slot(*words: np.ndarray) -> np.ndarray:
        h = np.zeros(len(words[0]), np.uint64)
        for k, w in enumerate(words):
            h += w * T.ODD[k]
        return (T.mix(h) >> np.uint64(42)).astype(np.int64)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a shard's words (0 between documents): pairs of test suffix and place where its window stands."""
        none = np.zeros(0, np.int64)
        if not self.lead or not len(h):
            return none, none
        at = suffix_array(h, self.window)
        n = len(h)
        h = np.concatenate([h, np.zeros(self.window, np.uint64)])
        opens = np.zeros(1 << 22, bool)
        opens[self._slot(*(h[k : n + k] for k in range(self.lead)))] = True
        who = np.flatnonzero(opens[self.opening])
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), n)
        found = [(none, none, none)]
        for d in range(self.window):
            column, key = h[at + d], self.words[who, d]
            lo, hi = self._bound(column, key, lo, hi, False), self._bound(column, key, lo, hi, True)
            there = lo < hi
            who, lo, hi = who[there], lo[there], hi[there]
            if not len(who):
                break
            done = self.size[who] == d + 1
            found.append((who[done], lo[done], hi[done]))
            who, lo, hi = who[~done], lo[~done], hi[~done]
        who, lo, hi = (np.concatenate(x) for x in zip(*found))
        many = hi - lo
        each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        return np.repeat(who, many), at[each]

    def maximal(self, who: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Of pairs of test suffix and place, those with no match one word earlier: there a longest match begins."""
        key = who * (n + 1) + place
        before = (who > 0) & (place > 0) & (self.item[np.maximum(who, 1) - 1] == self.item[who])
        return np.flatnonzero(~(before & np.isin((who - 1) * (n + 1) + place - 1, key)))

    @staticmethod
    def _bound(column, key, lo, hi, after: bool):
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            seen = column[np.minimum(mid, len(column) - 1)]
            right = open_ & ((seen <= key) if after else (seen < key))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def longest(self, h: np.ndarray, who: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that match from each place on, as far as both texts go."""
        out = self.size[who].copy()
        flat = np.concatenate([*self.rest, np.zeros(1, np.uint64)])
        begin = np.cumsum([0] + [len(r) for r in self.rest])
        h = np.concatenate([h, np.zeros(1, np.uint64)])
        live = np.arange(len(who))
        while len(live):
            i, p = self.at[who[live]] + out[live], place[live] + out[live]
            end = begin[self.item[who[live]] + 1] - begin[self.item[who[live]]]
            same = (i < end) & (h[np.minimum(p, len(h) - 1)] == flat[np.minimum(begin[self.item[who[live]]] + i, len(flat) - 1)])
            live = live[same]
            out[live] += 1
        return out


def _pieces(benchmark: DataFrame, item: str, text: str, limit: int) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """How many pieces of about limit characters the test set has, so that what is sent out at once stays bounded, and the pieces."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    n = 1 + int(items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // limit
    return n, ([(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n))


def _shards(batches, tests: TestSuffixes, text: str):
    """For every slice: rows, words per row, shard words, first word of each row in the shard, suffix and place of each match."""
    for batch in batches:
        for rows, buf, off in T.slices(batch, text):
            buf = T.LOWER[buf]
            starts, ends, words = T.spans(buf, off, T.ALNUM)
            first = words + np.arange(len(words))  # one 0 stands after each document
            h = np.zeros(first[-1], np.uint64)
            count = np.diff(words)
            h[np.arange(len(starts)) + np.repeat(np.arange(len(count)), count)] = T.hashes(buf, starts, ends)
            who, place = tests.places(h)
            yield rows, count, h, first, who, place


def _hits(tests: TestSuffixes, h, first, who, place) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Hit words per row; the pairs of row and item that has a window there."""
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.size[who], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    row = np.searchsorted(first, place, "right") - 1
    pairs = np.unique(np.stack([row, tests.item[who]]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    return covered[first[1:]] - covered[first[:-1]], [(int(r), tests.ids[i]) for r, i in pairs.T]


def _longest(tests: TestSuffixes, h, first, who, place):
    """Maximal matches: row, item, word in the document, word in the item, words."""
    own = tests.maximal(who, place, len(h))
    who, place = who[own], place[own]
    row = np.searchsorted(first, place, "right") - 1
    return row, tests.item[who], place - first[row], tests.at[who], tests.longest(h, who, place)


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated, and of the
    longest verbatim match (of these the first item as string, then the first place): longest (words, 0 if none),
    longest_item, longest_at (word in the document) and longest_from (word in the item)."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "doc_id long, row long, n_words long, n_hit long, items array<string>, runs array<long>, longest long, longest_item string, longest_at long, longest_from long"
    out = None
    passes, pieces = _pieces(benchmark, item, "text", piece_chars)
    if passes > 1:  # all passes must see the same key for a row
        slim = saved(slim)
    for piece in pieces:
        sent = docs.sparkSession.sparkContext.broadcast(TestSuffixes(piece, window))

        def work(batches, sent=sent):
            tests = sent.value
            for rows, count, h, first, who, place in _shards(batches, tests, "text"):
                hit, pairs = _hits(tests, h, first, who, place)
                items, runs = [[] for _ in count], [[] for _ in count]
                for r, i in pairs:
                    if i is not None:
                        items[r].append(i)
                if passes > 1:
                    row = np.searchsorted(first, place, "right") - 1
                    for r, a, n in zip(row, place - first[row], tests.size[who]):
                        runs[r] += [int(a), int(a + n)]
                best = np.zeros((len(count), 3), np.int64)
                names = np.full(len(count), None, object)
                row, own, at, begin, size = _longest(tests, h, first, who, place)
                order = np.lexsort([begin, at, tests.rank[own], -size, row])
                order = order[[tests.ids[own[k]] is not None for k in order]] if len(order) else order
                top = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                best[row[top]] = np.stack([size[top], at[top], begin[top]], 1)
                names[row[top]] = tests.ids[own[top]]
                none = best[:, 0] == 0
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(2), pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64())), pa.array(best[:, 0]), pa.array(names, pa.string()), pa.array(best[:, 1], mask=none), pa.array(best[:, 2], mask=none)], [f.split()[0] for f in schema.split(", ")])

        one = slim.mapInArrow(work, schema)
        out = one if out is None else out.unionByName(one)
    if passes > 1:  # more test text than one pass carries: put each row's runs together
        ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        best = F.min(F.when(F.col("longest") > 0, F.struct((-F.col("longest")).alias("m"), "longest_item", "longest_at", "longest_from"))).alias("best")
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), ids, F.flatten(F.collect_list("runs")).alias("runs"), best)
        marks = F.expr("flatten(transform(sequence(0, cast(size(runs) / 2 as int) - 1), k -> sequence(runs[2 * k], runs[2 * k + 1] - 1)))")
        out = out.withColumn("n_hit", F.when(F.size("runs") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(marks))).cast("long")).select("*", F.coalesce(-F.col("best.m"), F.lit(0)).alias("longest"), "best.longest_item", "best.longest_at", "best.longest_from")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_item", "longest_at", "longest_from", "items")


def matches(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """All longest verbatim matches with their locations: doc_id, item_id, doc_word, item_word, n_words; one row per place where a window stands and no match begins one word earlier."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for piece in _pieces(benchmark, item, "text", piece_chars)[1]:
        sent = docs.sparkSession.sparkContext.broadcast(TestSuffixes(piece, window))

        def work(batches, sent=sent):
            tests = sent.value
            for rows, _, h, first, who, place in _shards(batches, tests, "text"):
                row, own, at, begin, size = _longest(tests, h, first, who, place)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(tests.ids[own], pa.string()), pa.array(at), pa.array(begin), pa.array(size)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        one = slim.mapInArrow(work, "doc_id long, item_id string, doc_word long, item_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """docs without the rows that hold a window of the test set; columns and other rows stay as they are."""
    for piece in _pieces(benchmark, item, "text", piece_chars)[1]:
        sent = docs.sparkSession.sparkContext.broadcast(TestSuffixes(piece, window))

        def work(batches, sent=sent):
            tests = sent.value
            for rows, _, h, first, who, place in _shards(batches, tests, text):
                hit, _ = _hits(tests, h, first, who, place)
                yield rows.filter(pa.array(hit == 0))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def items_digest(items: list[str]) -> str:
    """What items_sha256 holds for these ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
