"""Alignment of two tokenizers over the bytes of documents, with corpus-wide counts of linked token pairs.

Every text, with a space before it, is encoded by a byte-level BPE file (A) and by a sentencepiece model (B). Byte
offsets where tokens of both end cut the text into groups; an A and a B token are linked where their byte ranges meet.
A pair of ids is counted once for each document that holds it linked.

Counting spills to runs: a task gathers documents up to a bounded number of links, sorts their distinct pairs by A id
and B id, and writes them, dealt by radix (the A id modulo a fixed number), as zstd runs; what each document links stays
behind in the run, as places in its order of pairs. Runs of one radix are merged through a heap over their blocks, a
bounded number at a time and in as many rounds as it takes, which adds up the counts of each pair; as the order has all
pairs of an A id together, the greatest count of each A id is known as the last merge passes over it. The merged counts
then stream back to the runs, in their own order of pairs, and from there to the documents. No group grows with a
frequent pair: a run has one record of it, however many of its documents hold it.

Defined results: null and empty texts have no tokens, as have those whose tokens of A or B do not give back the space
and the text (a text that holds U+2581, which B writes as a space); rows of one id, or without id, are documents each
of their own; an empty table gives no rows; other columns are never looked at; special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.bpe import ByteBpe
from lumagrid.llm.shared import saved
from lumagrid.llm.word_tokens import sentences

#: Links from which on a task closes a run.
RUN = 4_000_000
#: Radix of A ids, runs that one merge takes, runs that one task answers, pairs in a block of a run.
RADIX, FAN, ANSWERED, BLOCK = 64, 64, 256, 16_384
#: Bytes of text that are encoded at once.
SLICE = 1 << 20

_SINGLE = ("n_a", "n_b", "n_groups", "n_links")
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@lru_cache(4)
def plain_bpe(path: str) -> ByteBpe:
    """An encoder to which special tokens' strings are plain text."""
    bpe = ByteBpe(path)
    bpe.tokenizer.encode_special_tokens = True
    bpe.special = {}
    return bpe


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(T.blob(a))


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _whole(coder, ids: np.ndarray, n: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows the tokens' bytes give back."""
    sizes = coder.length[ids]
    token_rows = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = total[token_rows]
    same = np.diff(at) == np.diff(off)
    told = coder.bytes[np.arange(total[-1]) + np.repeat(coder.first[ids] - total[:-1], sizes)]
    if same.all():
        wrong = np.flatnonzero(told != buf)
        same[np.searchsorted(off, wrong, "right") - 1] = False
        return same
    for r in np.flatnonzero(same).tolist():
        same[r] = bool((told[at[r] : at[r + 1]] == buf[off[r] : off[r + 1]]).all())
    return same


def _only(ids: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(rows, n)], np.where(rows, n, 0)


@lru_cache(1)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each id, from the left, with room for a mark after them; and their number."""
    size = len(str(most))
    text = np.char.ljust(np.arange(most + 1).astype(f"S{size}"), size + 1).astype(f"S{size + 1}")
    table = text.view(np.uint8).reshape(most + 1, size + 1).copy()
    return table, np.char.str_len(np.arange(most + 1).astype(f"S{size}")).astype(np.int64)


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, each token's id followed by its mark, and the end of each group in it; groups are numbered from 0 and in order."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    until_a, until_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
    items = np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + until_b[group_a], np.arange(len(b)) + until_a[group_b + 1]
    items[at_a], items[at_b] = a, b
    table, size = _digits((int(items.max()) if len(items) else 0) | 0xFFFF)
    marks = np.full(len(items), ord(","), np.uint8)
    marks[until_a[1:] + until_b[:-1] - 1] = ord("|")
    marks[until_a[1:] + until_b[1:] - 1] = ord(";")
    rows, n = table[items], size[items]
    rows[np.arange(len(items)), n] = marks
    ends = np.cumsum(n + 1)
    return rows[np.arange(rows.shape[1]) <= n[:, None]], ends[until_a[1:] + until_b[1:] - 1] if groups else ends


def aligned(a_ids, a_n, a_size, b_ids, b_n, b_size, off: np.ndarray) -> dict[str, np.ndarray]:
    """For rows of bytes (off) and their tokens: groups of each row, links as (row, a, b), and the written groups' digests."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    cuts = np.union1d(a_end, b_end)  # each stretch between two of them is what one A and one B token share
    i, j = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
    text, ends = _written(a_ids, b_ids, np.searchsorted(both, a_end), np.searchsorted(both, b_end))
    # rows without tokens take no bytes here
    rows = np.flatnonzero(a_n)
    row_end = a_end[np.cumsum(a_n)[rows] - 1]
    groups, links = np.zeros(len(a_n), np.int64), np.zeros(len(a_n), np.int64)
    groups[rows] = np.diff(np.searchsorted(both, row_end, "right"), prepend=0)
    links[rows] = np.diff(np.searchsorted(cuts, row_end, "right"), prepend=0)
    data, at, sha = memoryview(text), 0, [""] * len(a_n)
    for r, end in zip(rows.tolist(), (ends[np.searchsorted(both, row_end)] if len(rows) else rows).tolist()):
        sha[r] = hashlib.sha256(data[at : end - 1]).hexdigest()
        at = end
    return {"groups": groups, "links": links, "sha": sha, "row": np.repeat(np.arange(len(a_n)), links), "a": a_ids[i], "b": b_ids[j]}


class _Run:
    """Documents and their links until the run is closed."""

    def __init__(self):
        self.docs, self.rows, self.keys, self.n_docs, self.n = {k: [] for k in ("doc_id", *_SINGLE, "sha")}, [], [], 0, 0

    def add(self, doc_ids, a_n, b_n, got):
        for k, v in zip(("doc_id", *_SINGLE, "sha"), (doc_ids, a_n.tolist(), b_n.tolist(), got["groups"].tolist(), got["links"].tolist(), got["sha"])):
            self.docs[k] += v
        # links of a document once for each pair, with how many there are
        codes, pairs = pd.factorize(got["a"].astype(np.uint64) << np.uint64(32) | got["b"].astype(np.uint64))
        one, times = np.unique(got["row"] * max(1, len(pairs)) + codes, return_counts=True)
        self.rows.append((one // max(1, len(pairs)) + self.n_docs, times))
        self.keys.append(pairs[one % max(1, len(pairs))])
        self.n_docs, self.n = self.n_docs + len(doc_ids), self.n + len(one)

    def closed(self, run: int):
        """The run's row of documents, then a row for each radix: its pairs in order and how many documents hold each."""
        keys = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        codes, pairs = pd.factorize(keys)
        radix = (pairs >> np.uint64(32)) % np.uint64(RADIX)
        order = np.lexsort((pairs, radix))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = rank[codes].astype(np.uint32)
        counts = np.bincount(places, minlength=len(pairs))
        rows, times = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in self.rows)]) for k in (0, 1))
        blobs = {"owned": packed(np.bincount(rows, minlength=self.n_docs)), "places": packed(places), "times": packed(times.astype(np.uint32))}
        none = {"radix": -1, "docs": None, "keys": None, "counts": None} | dict.fromkeys(blobs)
        yield none | blobs | {"run": run, "docs": [dict(zip(self.docs, x)) for x in zip(*self.docs.values())]}
        edge = np.searchsorted(radix[order], np.arange(RADIX + 1))
        for r in range(RADIX):
            if edge[r] < edge[r + 1]:
                own = order[edge[r] : edge[r + 1]]
                yield none | {"run": run, "radix": r, "keys": packed_keys(pairs[own]), "counts": packed(counts[edge[r] : edge[r + 1]].astype(np.int64))}


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order as differences of A ids, then B ids."""
    a = (keys >> np.uint64(32)).astype(np.uint32)
    return packed(np.concatenate([np.diff(a, prepend=np.uint32(0)), keys.astype(np.uint32)]).astype(np.uint32))


def unpacked_keys(data: bytes) -> np.ndarray:
    both = unpacked(data, np.uint32)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.uint64) << np.uint64(32) | both[half:].astype(np.uint64)


def merged(runs: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
    """Blocks of pairs in order with their counts over all runs, through a heap over the runs' blocks.

    The heap holds each run by the last pair of its present block; up to the least of these, every run's present block
    has all that the run holds, so these pairs are complete when they are added up.
    """
    at = [0] * len(runs)
    heap = [(int(keys[min(block, len(keys)) - 1]), k) for k, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        least = heap[0][0]
        parts = []
        for k, (keys, counts) in enumerate(runs):
            end = at[k] + int(np.searchsorted(keys[at[k] : at[k] + block], np.uint64(least), "right"))
            parts.append((keys[at[k] : end], counts[at[k] : end]))
            at[k] = end
        while heap and heap[0][0] == least:
            _, k = heapq.heappop(heap)
            keys = runs[k][0]
            if at[k] < len(keys):
                heapq.heappush(heap, (int(keys[min(at[k] + block, len(keys)) - 1]), k))
        # heads move on only when their block is used up, so a run's block may reach further than its entry says
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]))
        yield keys[order][first], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first)


def best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pairs whose count is the greatest of their A id; all pairs of an A id stand together."""
    a = keys >> np.uint64(32)
    first = np.flatnonzero(np.diff(a, prepend=~a[:1]))
    most = np.maximum.reduceat(counts, first)
    return counts == np.repeat(most, np.diff(np.append(first, len(a))))


def write_runs(docs: DataFrame, a_path: str, b_path: str, doc: str = "doc_id", text: str = "text", links: int = RUN) -> DataFrame:
    """Runs: rows of documents (radix -1: docs, owned, places, times) and rows of pairs (run, radix, keys, counts)."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "run long, radix int, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string>>, owned binary, places binary, times binary, keys binary, counts binary"
    doc_type = pa.list_(pa.struct([("doc_id", pa.int64()), *[(k, pa.int64()) for k in _SINGLE], ("sha", pa.string())]))
    types = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("docs", doc_type), *[(k, pa.binary()) for k in ("owned", "places", "times", "keys", "counts")]])

    def work(batches):
        coder_a, coder_b, run, n = plain_bpe(a_path), sentences(b_path), _Run(), 0
        first = TaskContext.get().partitionId() << 32

        def done():
            for row in run.closed(first + n):
                yield pa.RecordBatch.from_pylist([row], schema=types)

        for batch in batches:
            for rows, buf, off in T.slices(batch, "text", SLICE):
                some = np.diff(off) > 0
                spaced, off = np.insert(buf, off[:-1][some], 32), off + np.concatenate([[0], np.cumsum(some)])
                a, b = coder_a.encode(spaced, off), coder_b.encode(spaced, off)
                good = some & _whole(coder_a, *a, spaced, off) & _whole(coder_b, *b, spaced, off)
                (a_ids, a_n), (b_ids, b_n) = _only(*a, good), _only(*b, good)
                run.add(rows.column(0).to_pylist(), a_n, b_n, aligned(a_ids, a_n, coder_a.length[a_ids], b_ids, b_n, coder_b.length[b_ids], off))
                if run.n >= links:
                    yield from done()
                    run, n = _Run(), n + 1
        if run.n_docs:
            yield from done()
        T.give_back()

    return slim.mapInArrow(work, schema)


def _merger(last: bool):
    def merge(group: pa.Table) -> pa.Table:
        lists = [(unpacked_keys(k), unpacked(c, np.int64)) for k, c in zip(group["keys"].to_pylist(), group["counts"].to_pylist())]
        blocks = list(merged(lists))
        keys, counts = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        out = {"run": group["group"][:1], "radix": group["radix"][:1], "keys": pa.array([packed_keys(keys)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())}
        return pa.table(out | ({"best": pa.array([packed(best(keys, counts))], pa.binary())} if last else {}))

    return merge


def pair_counts(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """radix, keys, counts, best: one row per radix with all pairs of its A ids in order; merged in rounds of fan runs."""
    own = runs.where("radix >= 0").select("run", "radix", "keys", "counts")
    left = max(1, runs.where("radix < 0").count())
    while True:
        groups, last = -(-left // fan), left <= fan
        own = own.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)) if not last else F.lit(0).cast("long"))
        own = own.groupBy("radix", "group").applyInArrow(_merger(last), "run long, radix int, keys binary, counts binary" + ", best binary" * last)
        if last:
            return own.drop("run")
        left = groups


def align(docs: DataFrame, a_path: str, b_path: str, doc: str = "doc_id", text: str = "text", links: int = RUN, fan: int = FAN, answered: int = ANSWERED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs."""
    runs = saved(write_runs(docs, a_path, b_path, doc, text, links))
    totals = saved(pair_counts(runs, fan))
    groups = -(-max(1, runs.where("radix < 0").count()) // answered)
    asked = runs.where("radix >= 0").select("run", "radix", "keys", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"))
    told = totals.select("radix", F.col("keys").alias("all_keys"), "counts", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"run": pa.array([], pa.int64()), "radix": pa.array([], pa.int32()), "counts": pa.array([], pa.binary()), "best": pa.array([], pa.binary())})
        keys, counts, top = unpacked_keys(right["all_keys"][0].as_py()), unpacked(right["counts"][0].as_py(), np.int64), unpacked(right["best"][0].as_py(), bool)
        at = [np.searchsorted(keys, unpacked_keys(k)) for k in left["keys"].to_pylist()]
        return pa.table({"run": left["run"], "radix": left["radix"], "counts": pa.array([packed(counts[k]) for k in at], pa.binary()), "best": pa.array([packed(top[k]) for k in at], pa.binary())})

    answers = asked.groupBy("radix", "group").cogroup(told.groupBy("radix", "group")).applyInArrow(answer, "run long, radix int, counts binary, best binary")

    def give_back(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("radix")
        counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, np.int64) for x in right["counts"].to_pylist())])
        top = np.concatenate([np.zeros(0, bool), *(unpacked(x, bool) for x in right["best"].to_pylist())])
        owned, places, times = (unpacked(left[k][0].as_py(), t) for k, t in (("owned", np.int64), ("places", np.uint32), ("times", np.uint32)))
        times = times.astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(owned)])
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        own = left["docs"].combine_chunks().flatten()
        names = ["doc_id", *_SINGLE]
        out = {k: own.field(k) for k in names} | {"n_best": pa.array(add(times * top[places])), "count_sum": pa.array(add(times * counts[places])), "groups_sha256": own.field("sha")}
        return pa.table(out)

    rows = runs.where("radix < 0").select("run", "docs", "owned", "places", "times")
    return rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(give_back, _RESULT)
