"""Best-fit packing of documents into sequences of a fixed number of tokens, by exact complements.

Pieces of one length are alike, so the packing is decided on the number of pieces of each length (at most `size`
numbers, whatever the table's size). From the longest length down, the room that a piece leaves is looked up among the
lengths, sums of two and sums of three that are still there, and each combination that fills it exactly is used as
often as its lengths last. What is left is packed best-fit, in decreasing length; a sequence that is opened for it gets
the lengths, sums of two or sums of three that come nearest to filling it. The outcome is a list of slots: so
many pieces of one length, from a place on in the order of that length, go to sequences from a number on. Pieces then
find their slot by their own place in the order of their length: tasks number their own pieces, and a running sum of
the tasks' counts gives the places before them. No piece passes through the driver and no group grows with a hot length.

Defined results: null text is an empty document, which still has its end id; only documents of more than `size` tokens
are cut; rows of one id, or without id, are packed each on their own; an empty table gives no rows; other columns are
never looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.shared import saved
from lumagrid.llm.word_tokens import word_bpe

SIZE = 2048


class Complements:
    """Lengths with the number of pieces that are left of each, indexed by their sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def _pair(self, total: int, left: np.ndarray) -> tuple[int, int] | None:
        """Two lengths that add up to total, the longer one as long as may be."""
        if total < 2:
            return None
        long = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        short = total - long
        there = (left[long] > 0) & (left[short] > (long == short))
        k = int(there.argmax()) if len(there) else 0
        return (int(long[k]), int(short[k])) if len(there) and there[k] else None

    def filling(self, room: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are left and add up to room."""
        if room <= 0:
            return None
        if self.left[room]:
            return (room,)
        if pair := self._pair(room, self.left):
            return pair
        for a in np.flatnonzero(self.left[:room])[::-1].tolist():
            if 3 * a < room:
                break
            self.left[a] -= 1
            pair = self._pair(room - a, self.left)
            self.left[a] += 1
            if pair and pair[0] <= a:
                return (a, *pair)
        return None

    def nearest(self, room: int) -> tuple[int, ...]:
        """Up to three lengths that are left, with the greatest sum that is not over room; as few of them as give it."""
        best: tuple[int, ...] = ()
        for first in [0, *np.flatnonzero(self.left[: room + 1])[::-1].tolist()]:
            if sum(best) == room or first and 3 * first <= sum(best):
                break
            rest, left = room - first, self.left.copy()
            left[first] -= first > 0
            below = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))  # the longest that is left up to each length
            a = np.flatnonzero(left[: min(rest, first or rest) + 1] > 0)
            b = below[np.minimum(rest - a, a)]
            b = np.where((a == b) & (left[a] < 2), below[np.maximum(a - 1, 0)], b)
            if len(a) and first + int((a + b).max()) > sum(best):
                k = int((a + b).argmax())
                best = tuple(x for x in (first, int(a[k]), int(b[k])) if x)
        return best


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts[n] pieces of length n (1 to size): patterns of sequences as (copies, [(length, pieces of it), ...])."""
    index, patterns = Complements(np.append(counts, np.zeros(max(0, size + 1 - len(counts)), np.int64))), []
    left = index.left
    for length in range(size, 0, -1):
        while left[length]:
            if length == size:
                combo = ()
            else:
                left[length] -= 1
                combo = index.filling(size - length)
                left[length] += 1
                if combo is None:
                    break
            used = defaultdict(int)
            for x in (length, *combo):
                used[x] += 1
            copies = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= copies * n
            patterns.append((copies, sorted(used.items(), reverse=True)))
    return patterns + _best_fit(index, size)


def _best_fit(index: Complements, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit in decreasing length, for all alike sequences at once."""
    open_: dict[int, list] = defaultdict(list)  # by room: (copies, content)
    closed, left = [], index.left

    def put(copies: int, content: list, room: int) -> None:
        if copies:
            (open_[room] if room else closed).append((copies, content))

    for length in range(size, 0, -1):
        while left[length]:
            room = min((r for r in open_ if r >= length), default=0)
            if not room:
                left[length] -= 1
                used = defaultdict(int)
                for x in (length, *index.nearest(size - length)):
                    used[x] += 1
                left[length] += 1
                alike = min(int(left[length]), size // length)
                if alike * length >= sum(x * k for x, k in used.items()):
                    used = {length: alike}
                copies = min(int(left[x]) // k for x, k in used.items())
                for x, k in used.items():
                    left[x] -= copies * k
                put(copies, sorted(used.items(), reverse=True), size - sum(x * k for x, k in used.items()))
                continue
            copies, content = open_[room].pop()
            if not open_[room]:
                del open_[room]
            n, each = int(left[length]), room // length
            full = min(copies, n // each)
            rest = n if n < each else 0  # the last sequence may get fewer
            put(full, [*content, (length, each)], room - each * length)
            put(int(rest > 0), [*content, (length, rest)], room - rest * length)
            put(copies - full - (rest > 0), content, room)
            left[length] -= full * each + rest
    return closed + [x for xs in open_.values() for x in xs]


def slots(patterns: list) -> dict[str, np.ndarray]:
    """Slots in order of length and first place: length, first, each (pieces of the length in one sequence), sequence, offset."""
    taken, rows, sequence = defaultdict(int), [], 0
    for copies, content in patterns:
        offset = 0
        for length, n in content:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += copies * n
            offset += length * n
        sequence += copies
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), rows.T))


def place(length: np.ndarray, at: np.ndarray, told: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces that are at these places in the order of their length."""
    key = told["length"] << 44 | told["first"]
    k = np.searchsorted(key, length << 44 | at, "right") - 1
    t = at - told["first"][k]
    return told["sequence"][k] + t // told["each"][k], told["offset"][k] + t % told["each"][k] * length


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0, doc: str = "doc_id", text: str = "text", tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, own (place among the pieces of its length in its part) and, if asked for, ids."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int64(), "own": pa.int64()} | ({"ids": pa.binary()} if tokens else {})

    def work(batches):
        encoder, part, seen = word_bpe(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows, buf, off in T.slices(batch, "text"):
                ids, n = encoder.encode(buf, off)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                k = -(-n // size)  # pieces of each document
                piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                start = piece * size
                length = np.minimum(np.repeat(n, k) - start, size)
                end = np.cumsum(length)
                order = np.argsort(length, kind="stable")
                run = np.searchsorted(length[order], length[order])
                own = np.empty(len(length), np.int64)
                own[order] = np.arange(len(length)) - run
                own += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                data = memoryview(ids.tobytes())
                cuts = list(zip((4 * (end - length)).tolist(), (4 * end).tolist()))
                columns = [rows.column(0).take(pa.array(np.repeat(np.arange(len(n)), k))), piece, start, length, [zlib.crc32(data[a:b]) for a, b in cuts], np.full(len(length), part), own] + [[bytes(data[a:b]) for a, b in cuts]] * tokens
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

    return slim.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, own long" + ", ids binary" * tokens)


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0, doc: str = "doc_id", text: str = "text", tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids: one row per piece."""
    all_ = saved(pieces(docs, path, size, end_id, doc, text, tokens))
    sizes = saved(all_.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length: size rows at most
        counts[r.length] = r.n
    told = slots(plan(counts, size))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = all_.join(sizes.select("part", "length", before.alias("before")), ["part", "length"])
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def work(batches):
        for batch in batches:
            at = lambda name: batch.column(batch.schema.get_field_index(name))
            sequence, offset = place(at("length").to_numpy(), at("at").to_numpy(), told)
            yield pa.RecordBatch.from_arrays([at(c) for c in keep] + [pa.array(sequence), pa.array(offset)] + [at("ids")] * tokens, [*keep, "sequence_id", "offset"] + ["ids"] * tokens)

    out = placed.select(*keep, (F.col("before") + F.col("own")).alias("at"), *["ids"] * tokens)
    return out.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences, from pack with ids: sequence_id, n_tokens, ids, and parts (the documents' pieces in order)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    own = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.expr("aggregate(parts, cast('' as binary), (all_, p) -> concat(all_, p.ids))")
    return own.select("sequence_id", "n_tokens", ids.alias("ids"), F.expr("transform(parts, p -> struct(p.doc_id, p.piece, p.start, p.length, p.offset))").alias("parts"))
