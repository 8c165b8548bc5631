"""Language-model scores by online logistic context mixing, beside a unigram base score.

Bit predictors: for contexts of the last 0 to 5 bytes, and for the length of the word so far with the last two bytes,
hashed together with the bits of the current byte so far, all training texts are counted (zeros and ones); counts are
gathered by slot over the cluster. A mixer combines the predictors' stretched probabilities with weights that are gated
by how well the long contexts are known and by the bits so far; an adaptive refinement corrects the mixed probability by
context. Weights and refinement learn in small steps from every place of all training texts, each with its own occurrence
taken out of the counts: places with equal bytes before them teach the same, so each distinct run is taken once, with the
count of its places. Runs are dealt to pieces by their hash, every piece learns on its own stream, and the results are
averaged by places. Then all is frozen, so that a text's score does not depend on where or when it is scored, nor on how
rows are dealt to tasks.

Far context: after any three words, whole chunks of text (to a word whose hash ends a chunk) that followed them in other
training documents are predicted, with a weight gated by how often the three words were seen. These counts grow with the
corpus and stay in Spark, dealt by context; a training document never counts for itself.

A frozen prediction of a byte depends on few bytes only, so each distinct run is evaluated once in a task. The end of a
text is told by its length, coded first: the counts of lengths by powers of two, even within each.

The base score needs the training count of every token. Counts are kept in buckets of word hashes; frequent words, of
which there can be at most 1 / FREQUENT, are sent to the tasks, all others are joined by bucket.

Defined results: null text is empty: one token (the end), no bytes, its score that of its length. Rows of one id are
scored each; long texts are scored whole; an empty table gives an empty result; other columns are never looked at. With
no training rows the base score is 0 for each token and every bit costs one bit before mixing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.shared import partitions, saved, scratch

ORDERS = 6
#: Predictors: one for each order, and the one of word lengths.
PREDICTORS = ORDERS + 1
SHARD = 16
#: Least and most slots of the tables of orders 3 to 5, as powers of two, and bytes of training text for each slot.
LEAST, MOST, BYTES = 18, 22, 8
#: Bytes of text in a slice: larger ones hold fewer distinct runs in all.
SLICE = 2 << 20
#: Share of training tokens from which on a word is frequent.
FREQUENT = 1e-5
#: Distinct runs in a step of learning; places of a gate from which on more of them make no longer step; bytes of text whose runs are learned one after another.
STEP, MANY, PIECE = 1024, 128, 64 << 20
#: Bytes of text whose words and chunks are looked up together.
FLUSH = 8 << 20
#: Distinct runs whose cost a task remembers.
REMEMBERED = 1_000_000
#: One word in so many ends a chunk; words before a chunk that are its context.
CHUNK, CONTEXT = 6, 3
END = np.uint64(0x9D2C5680CA3F0B17)
_LEVELS = np.array([0, 1, 2, 4, 16, 256])
#: Documents that a far context was seen in, by which its weight is gated.
_FAR = np.array([1, 2, 3, 5, 9, 17, 65])
_NODE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table_sizes(n_bytes: int) -> tuple[int, ...]:
    """Slots of each predictor as a power of two, for so many bytes of training text; the first two have one slot for each context and node."""
    long = min(max(int(np.ceil(np.log2(max(1, n_bytes / BYTES)))), LEAST), MOST)
    return (8, 16, min(long, 20), long, long, long, min(long, 20))


def sixes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The last six bytes at each place as a number; zeros stand before a text."""
    key = buf.astype(np.uint64)
    for k in range(1, ORDERS):
        key[k:] |= buf[: max(0, len(buf) - k)].astype(np.uint64) << np.uint64(8 * k)
    for k in range(ORDERS - 1):  # what stands before a text is another one
        at = off[:-1][off[1:] - off[:-1] > k] + k
        key[at] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return key


def runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """All that a prediction depends on at each place: the last six bytes, and above them the length of the word before the last one (15 at most)."""
    key = sixes(buf, off)
    if not len(buf):
        return key
    begin = np.arange(len(buf), dtype=np.int32)
    spaced = T.SPACED[buf[:-1]]
    begin[1:][spaced] = 0  # a word begins after white space, or with the text
    begin[off[:-1][off[:-1] < off[1:]]] = off[:-1][off[:-1] < off[1:]]
    length = np.arange(len(buf), dtype=np.int32) - np.maximum.accumulate(begin)
    return key | np.minimum(length, 15).astype(np.uint64) << np.uint64(8 * ORDERS)


def context_of(keys: np.ndarray, predictor: int) -> np.ndarray:
    """Context of a predictor, spread over 64 bits where it has to be hashed."""
    if predictor < ORDERS:
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * predictor) - 1)
        return context if predictor < 2 else T.mix(context * T.ODD[predictor] + np.uint64(predictor))
    context = (keys >> np.uint64(8)) & np.uint64(0xFFFF) | keys >> np.uint64(8 * ORDERS) << np.uint64(16)
    return T.mix(context * T.ODD[predictor] + np.uint64(predictor))


def slots(context: np.ndarray, predictor: int, node: np.ndarray, bits: int) -> np.ndarray:
    """Table place of a context with the bits of the byte so far."""
    if predictor < 2:
        return (context.astype(np.int64) << 8) | node
    return ((context ^ _NODE[node]) >> np.uint64(64 - bits)).astype(np.int64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, found = pd.factorize(np.concatenate(keys))
    return found, np.bincount(code, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _merge_pairs(context: list[np.ndarray], chunk: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal pairs added up, in order of context and chunk."""
    if not context:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    a, b, c = np.concatenate(context), np.concatenate(chunk), np.concatenate(n)
    order = np.lexsort([b, a])
    a, b, c = a[order], b[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.add.reduceat(c, at) if len(at) else c


def bit_counts(keys: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each predictor: slots in order, zeros and ones, from distinct runs and how often each stands."""
    for predictor, bits in enumerate(sizes):
        word = np.uint64(0xF << 8 * ORDERS) if predictor == ORDERS else np.uint64(0)
        last = 2 if predictor == ORDERS else predictor
        own, n = _merge([keys & (np.uint64((1 << 8 * (last + 1)) - 1) | word)], [counts])
        byte, context = (own & np.uint64(255)).astype(np.int64), context_of(own, predictor)
        table = np.zeros(2 << bits, np.int32)
        for j in range(7, -1, -1):
            np.add.at(table, slots(context, predictor, (1 << (7 - j)) | (byte >> (j + 1)), bits) << 1 | (byte >> j) & 1, n.astype(np.int32))
        table = table.reshape(-1, 2)
        place = np.flatnonzero(table[:, 0] | table[:, 1])
        yield place, table[place, 0], table[place, 1]


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Two counts in 16 bits; larger ones are halved until both fit, which keeps their ratio."""
    zeros, ones = zeros.copy(), ones.copy()
    while len(big := np.flatnonzero(np.maximum(zeros, ones) > 255)):
        zeros[big], ones[big] = (zeros[big] + 1) >> 1, (ones[big] + 1) >> 1
    return (zeros << 8 | ones).astype(np.uint16)


_ZEROS, _ONES = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
_STRETCH = np.log((_ONES + 0.4) / (_ZEROS + 0.4)).astype(np.float32)
_LEVEL = (np.searchsorted(_LEVELS, _ZEROS + _ONES, "right") - 1).astype(np.uint8)


class Mixer:
    """Predictors with gated weights and refinement."""

    rate = 0.02

    def __init__(self, tables: list[np.ndarray]):
        """tables: packed counts per slot of each predictor."""
        self.tables, self.bits = tables, [len(t).bit_length() - 1 for t in tables]
        self.known = np.full((216, PREDICTORS + 1), 0.15, np.float32)  # gated by how well orders 5, 4 and 2 are known
        self.node = np.full((256, PREDICTORS + 1), 0.15, np.float32)  # gated by the bits so far
        self.known[:, -1] = self.node[:, -1] = 0
        self.hits = np.zeros((2, 256 * 33))

    def weights(self) -> np.ndarray:
        """All that is learned, as one row."""
        return np.concatenate([self.known.ravel(), self.node.ravel(), self.hits.ravel()]).astype(np.float64)

    def freeze(self, weights: np.ndarray) -> None:
        """Set what was learned; hits are zeros and ones per cell of the refinement."""
        a, b = self.known.size, self.known.size + self.node.size
        self.known, self.node = weights[:a].reshape(self.known.shape).astype(np.float32), weights[a:b].reshape(self.node.shape).astype(np.float32)
        zeros, ones = weights[b:].reshape(2, -1)
        prior = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, 33))), 256)
        self.refined = np.clip((ones + 30 * prior) / (zeros + ones + 30), 1e-5, 1 - 1e-5).astype(np.float32)
        self.keys, self.costs = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def inputs(self, keys: np.ndarray, contexts: list[np.ndarray], j: int, alone: bool = False):
        """Stretched probabilities, gate, node and bit; alone: without the place's own occurrence in the counts."""
        byte = (keys & np.uint64(255)).astype(np.int64)
        node, bit = (1 << (7 - j)) | (byte >> (j + 1)), (byte >> j) & 1
        x, level = np.empty((len(keys), PREDICTORS + 1), np.float32), {}
        x[:, -1] = 0.3
        for k in range(PREDICTORS):
            code = self.tables[k][slots(contexts[k], k, node, self.bits[k])]
            if alone:
                code = code.astype(np.int64)
                own = np.where(bit == 1, code & 255, code >> 8) > 0
                code = code - own * np.where(bit == 1, 1, 256)
            x[:, k] = _STRETCH[code]
            if k in (2, 4, 5):
                level[k] = _LEVEL[code].astype(np.int64)
        return x, level[5] * 36 + level[4] * 6 + level[2], node, bit

    def mixed(self, x, gate, node) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.known[gate]) + np.einsum("ij,ij->i", x, self.node[node]), -12, 12)

    @staticmethod
    def _cell(z: np.ndarray, node: np.ndarray):
        place = (np.clip(z, -7.999, 7.999) + 8) * 2
        low = place.astype(np.int64)
        return node * 33 + low, (place - low).astype(np.float32)

    def learn(self, keys: np.ndarray, step: int = 128, seed: int = 2, counts: np.ndarray | None = None) -> None:
        """Online steps over places in a random order, then the refinement's counts over the same places; counts: places that each key stands for."""
        order = np.random.default_rng(seed).permutation(len(keys))
        keys, counts = keys[order], np.ones(len(keys)) if counts is None else counts[order].astype(np.float64)
        for refine in (False, True):
            for at in range(0, len(keys), step if not refine else 1 << 14):
                own = keys[at : at + (step if not refine else 1 << 14)]
                n = counts[at : at + len(own)]
                contexts = [context_of(own, k) for k in range(PREDICTORS)]
                rate = self.rate * (1 - 0.9 * at / len(keys))
                for j in range(7, -1, -1):
                    x, gate, node, bit = self.inputs(own, contexts, j, True)
                    z = self.mixed(x, gate, node)
                    if refine:
                        cell, part = self._cell(z, node)
                        for near, share in ((cell, 1 - part), (cell + 1, part)):
                            for b in (0, 1):
                                self.hits[b] += np.bincount(near[bit == b], weights=(share * n)[bit == b], minlength=self.hits.shape[1])
                        continue
                    error = (bit - 1 / (1 + np.exp(-z))) * n
                    for weights, where in ((self.known, gate), (self.node, node)):
                        total = np.stack([np.bincount(where, weights=error * x[:, c], minlength=len(weights)) for c in range(x.shape[1])], 1)
                        many = np.maximum(np.bincount(where, weights=n, minlength=len(weights)), 1)
                        weights += (rate * total * (np.sqrt(np.minimum(many, MANY)) / many)[:, None]).astype(np.float32)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each run costs; keys in order.

        A bit's probability depends on the context and the bits before it only: keys that share them are neighbours, and
        it is worked out once for all of them.
        """
        out = np.zeros(len(keys), np.float32)
        for at in range(0, len(keys), 1 << 15):
            own = keys[at : at + (1 << 15)]
            new = np.append(True, own[1:] >> np.uint64(8) != own[:-1] >> np.uint64(8))
            contexts, which = [context_of(own[new], k) for k in range(PREDICTORS)], np.cumsum(new) - 1
            for j in range(7, -1, -1):
                first = np.flatnonzero(np.append(True, own[1:] >> np.uint64(j + 1) != own[:-1] >> np.uint64(j + 1)))
                x, gate, node, _ = self.inputs(own[first], [c[which[first]] for c in contexts], j)
                z = self.mixed(x, gate, node)
                cell, part = self._cell(z, node)
                q = self.refined[cell] * (1 - part) + self.refined[cell + 1] * part
                p = np.repeat(np.clip((1 / (1 + np.exp(-z)) + q) / 2, 1e-5, 1 - 1e-5), np.diff(first, append=len(own)))
                out[at : at + len(own)] -= np.log2(np.where((own >> np.uint64(j)) & np.uint64(1) == 1, p, 1 - p))
        return out

    def place_bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits that each byte costs; distinct runs are remembered."""
        code, found = pd.factorize(runs(buf, off))
        order = np.argsort(found)
        found = found[order]
        on = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        new = self.keys[on] != found if len(self.keys) else np.ones(len(found), bool)
        bits = np.empty(len(found), np.float32)
        bits[~new], bits[new] = self.costs[on[~new]], self.cost(found[new])
        if len(self.keys) + new.sum() > REMEMBERED:  # those of this slice stay, which are the ones that come again
            self.keys, self.costs = found, bits
        else:
            at = np.searchsorted(self.keys, found[new])
            self.keys, self.costs = np.insert(self.keys, at, found[new]), np.insert(self.costs, at, bits[new])
        own = np.empty(len(order), np.float32)
        own[order] = bits
        return own[code]

    def bits_of(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Total bits of each text without its length."""
        run = np.concatenate([[0.0], np.cumsum(self.place_bits(buf, off), dtype=np.float64)])
        return run[off[1:]] - run[off[:-1]]


def chunks(buf: np.ndarray, off: np.ndarray, h: np.ndarray, starts: np.ndarray, words: np.ndarray):
    """Row, hash of the words before, hash, first byte and end of each chunk that has a context; h: word hashes, words: words before each row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(words))
    if len(h) < 2:
        return row[:0], h[:0], h[:0].astype(np.uint32), row[:0], row[:0]
    first = np.flatnonzero((h[:-1] % np.uint64(CHUNK) == 0) & (row[1:] == row[:-1])) + 1
    begin, own = starts[first], row[first]
    end = off[own + 1].copy()
    follows = own[1:] == own[:-1]
    end[:-1][follows] = begin[1:][follows]
    enough = first - words[own] >= CONTEXT
    first, begin, end, own = first[enough], begin[enough], end[enough], own[enough]
    context = T.grams(h, CONTEXT)[first - CONTEXT] if len(first) else h[:0]
    return own, context, (T.hashes(buf, begin, end) >> np.uint64(32)).astype(np.uint32), begin, end


def far_level(n: np.ndarray) -> np.ndarray:
    """Gate of a far context seen in n >= 1 documents."""
    return np.searchsorted(_FAR, n, "right") - 1


def bucket_of(h: np.ndarray, groups: int) -> np.ndarray:
    """Group of a hash; groups follow the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = T.LOWER[buf]
    starts, ends, rows = T.spans(low, off, T.SPACED)
    return T.hashes(low, starts, ends), starts, rows


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k.startswith("d") else pa.int64()) for k, v in columns.items()], list(columns))


def _read(column, t) -> list[np.ndarray]:
    return [np.frombuffer(x, t) for x in column.to_pylist()]


def _planes(a: np.ndarray) -> bytes:
    """Numbers with their low bytes first, then the next bytes of all: small numbers leave zeros that compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(data: bytes, t) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel()


def runs_from(groups: int, sizes: tuple[int, ...]) -> int:
    """The grp of _gather from which on there are runs."""
    return 2 * groups + PREDICTORS * -(-(1 << max(sizes)) >> SHARD)


def _gather(rows: DataFrame, groups: int, sizes: tuple[int, ...], pieces: int) -> DataFrame:
    """Training counts by grp. Under groups: word hashes (d1) and counts (d2). Under 2 groups: far contexts (d1), chunks
    (d2) and documents (d3). From there on: part of a bit table, slots (d1) and packed counts (d2). At last, for each
    piece, distinct runs (d1) and their places (d2)."""
    many, last_ = -(-(1 << max(sizes)) >> SHARD), runs_from(groups, sizes)

    def scan(batches):
        words, keys, pairs = ([], []), ([], []), ([], [], [])

        def flush():
            w, n = _merge(*words)
            context, chunk, docs = _merge_pairs(*pairs)
            for kind, key, values in ((0, w, (w, n)), (1, context, (context, chunk, docs.astype(np.uint32)))):
                order = np.argsort(key, kind="stable")
                values = [v[order] for v in values]
                edge = np.searchsorted(bucket_of(key[order], groups), np.arange(groups + 1))
                used = [k for k in range(groups) if edge[k] < edge[k + 1]]
                cut = [[_planes(v[edge[k] : edge[k + 1]]) for k in used] for v in values] + [[b""] * len(used)]
                yield _batch(grp=[kind * groups + k for k in used], salt=[0] * len(used), d1=cut[0], d2=cut[1], d3=cut[2])
            part = TaskContext.get().partitionId()
            run, places = _merge(*keys)
            piece = (T.mix(run ^ END) % np.uint64(pieces)).astype(np.int64)
            order = np.lexsort([run, piece])
            edge = np.searchsorted(piece[order], np.arange(pieces + 1))
            for k in np.flatnonzero(np.diff(edge)):
                own = order[edge[k] : edge[k + 1]]
                yield _batch(grp=[last_ + k], salt=[0], d1=[_planes(run[own])], d2=[_planes(places[own].astype(np.uint32))], d3=[b""])
            for predictor, (at, zeros, ones) in enumerate(bit_counts(run, places, sizes)):
                edge = np.searchsorted(at >> SHARD, np.arange(many + 1))
                for s in np.flatnonzero(np.diff(edge)):
                    a, b = edge[s], edge[s + 1]
                    yield _batch(grp=[2 * groups + predictor * many + s], salt=[part // 64], d1=[_planes((at[a:b] & ((1 << SHARD) - 1)).astype(np.uint16))], d2=[_planes(zeros[a:b].astype(np.uint32))], d3=[_planes(ones[a:b].astype(np.uint32))])

        held = 0
        for batch in batches:
            for rows, buf, off in T.slices(batch, "text", SLICE):
                h, starts, at = _words(buf, off)
                w, n = _merge([np.append(h, END)], [np.append(np.ones(len(h)), rows.num_rows)])
                words[0].append(w)
                words[1].append(n)
                g, n = np.unique(runs(buf, off), return_counts=True)
                keys[0].append(g)
                keys[1].append(n)
                row, context, chunk, _, _ = chunks(buf, off, h, starts, at)
                order = np.lexsort([chunk, context, row])  # a document counts once for a pair
                row, context, chunk = row[order], context[order], chunk[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (context[1:] != context[:-1]) | (chunk[1:] != chunk[:-1])]) if len(row) else np.zeros(0, bool)
                for to, x in zip(pairs, (context[new], chunk[new], np.ones(new.sum(), np.int64))):
                    to.append(x)
                held += len(g) + len(w) + new.sum()
                if held > 2_500_000:
                    for x, f in ((words, _merge), (keys, _merge), (pairs, _merge_pairs)):
                        for to, own in zip(x, f(*x)):
                            to[:] = [own]
                    held = len(words[0][0]) + len(keys[0][0]) + len(pairs[0][0])
                    if held > 1_600_000:
                        yield from flush()
                        held = 0
                        for x in (*words, *keys, *pairs):
                            x.clear()
        if words[0]:
            yield from flush()

    def added(group, last):
        kind, salt, parts, table = None, 0, ([], [], []), None
        for b in group:
            for r in b.to_pylist():
                kind, salt = r["grp"], r["salt"]
                if kind < 2 * groups or kind >= last_:
                    for to, name, t in zip(parts, ("d1", "d2", "d3"), (np.uint64, np.int64 if kind < groups else np.uint32, np.uint32)):
                        to.append(_unplanes(r[name], t))
                else:
                    table = np.zeros((2, 1 << SHARD), np.int64) if table is None else table
                    at = _unplanes(r["d1"], np.uint16)
                    for k, name in ((0, "d2"), (1, "d3")):
                        table[k, at] += _unplanes(r[name], np.uint32)
        if kind is not None and kind < groups:
            w, n = _merge(parts[0], parts[1])
            yield _batch(grp=[kind], salt=[0], d1=[T.blob(w)], d2=[T.blob(n)], d3=[b""])
        elif kind is not None and kind < 2 * groups:
            context, chunk, n = _merge_pairs(*parts)
            yield _batch(grp=[kind], salt=[0], d1=[T.blob(context)], d2=[T.blob(chunk)], d3=[T.blob(np.minimum(n, (1 << 32) - 1).astype(np.uint32))])
        elif kind is not None and kind >= last_:
            run, places = _merge(parts[0], parts[1])
            order = np.argsort(run)
            yield _batch(grp=[kind], salt=[0], d1=[_planes(run[order])], d2=[_planes(places[order])], d3=[b""])
        elif kind is not None:
            at = np.flatnonzero(table.sum(0))
            zeros, ones = table[:, at]
            while max(zeros.max(initial=0), ones.max(initial=0)) >= 1 << 31:  # counts stay 32-bit
                zeros, ones = zeros >> 1, ones >> 1
            values = [_planes(packed(zeros, ones)), b""] if last else [_planes(zeros.astype(np.uint32)), _planes(ones.astype(np.uint32))]
            yield _batch(grp=[kind], salt=[salt // 64], d1=[_planes(at.astype(np.uint16))], d2=[values[0]], d3=[values[1]])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(group, False)

    def add_last(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(group, True)

    schema = "grp long, salt long, d1 binary, d2 binary, d3 binary"
    with scratch(rows.sparkSession) as keep:
        once = saved(rows.mapInArrow(scan, schema).groupBy("grp", "salt").applyInArrow(add, schema))
        shards = once.where(F.col("grp").between(2 * groups, last_ - 1))
        top = shards.agg(F.coalesce(F.max("salt"), F.lit(0))).first()[0]
        while True:  # part tables are added up in a tree
            shards = shards.groupBy("grp", "salt").applyInArrow(add if top else add_last, schema)
            if not top:
                break
            top //= 64
        counted = keep(once.where((F.col("grp") < 2 * groups) | (F.col("grp") >= last_)).unionByName(shards))
    return counted


def far_weights(counted: DataFrame, groups: int) -> np.ndarray:
    """For each gate: how often, of all documents that show a far context seen in others too, one of the others goes on the same way."""

    def work(batches):
        total = np.zeros((2, len(_FAR)))
        for b in batches:
            for context, n in zip(_read(b.column(0), np.uint64), _read(b.column(1), np.uint32)):
                at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
                seen = np.repeat(np.add.reduceat(n.astype(np.int64), at), np.diff(np.append(at, len(context)))) if len(at) else n.astype(np.int64)
                some = seen > 1
                level = far_level(seen[some] - 1)
                total[0] += np.bincount(level, weights=n[some], minlength=len(_FAR))
                total[1] += np.bincount(level, weights=n[some] * (n[some] > 1), minlength=len(_FAR))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(_FAR))), pa.array(total[0]), pa.array(total[1])], ["level", "n", "hits"])

    rows = counted.where(F.col("grp").between(groups, 2 * groups - 1)).select("d1", "d3").mapInArrow(work, "level long, n double, hits double").groupBy("level").agg(F.sum("n"), F.sum("hits")).collect()
    out = np.full(len(_FAR), 0.5)
    for level, n, hits in rows:
        out[level] = (hits + 1) / (n + 2)
    return out


def taught(runs_: DataFrame, mixer: Mixer) -> np.ndarray:
    """Weights and refinement learned from all places of the training texts, averaged by places; runs_: those of _gather.

    A piece learns from its runs in an order that only they settle, so the outcome is the same however rows are dealt to
    tasks. A piece is bounded: it has the distinct ones of the runs of PIECE bytes of text or so.
    """
    sent = runs_.sparkSession.sparkContext.broadcast(mixer)

    def learn(group: pa.Table) -> pa.Table:
        one, piece = Mixer(sent.value.tables), group["grp"][0].as_py()
        keys, places = (_unplanes(group[c][0].as_py(), t) for c, t in (("d1", np.uint64), ("d2", np.int64)))
        one.learn(keys, STEP, counts=places)
        w = one.weights()
        w[: -one.hits.size] *= places.sum()
        return pa.table({"grp": pa.array([piece % 64]), "piece": pa.array([piece]), "n": pa.array([int(places.sum())]), "w": pa.array([T.blob(w)], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        return pa.table({"grp": group["grp"][:1], "n": pa.array([sum(group["n"].to_pylist())]), "w": pa.array([T.blob(sum(np.frombuffer(x) for x in group["w"].to_pylist()))], pa.binary())})

    rows = runs_.select("grp", "d1", "d2").groupBy("grp").applyInArrow(learn, "grp long, piece long, n long, w binary").groupBy("grp").applyInArrow(add, "grp long, n long, w binary").orderBy("grp").collect()
    n = sum(r.n for r in rows)
    if not n:
        return mixer.weights()
    w = sum(np.frombuffer(r.w) for r in rows)
    w[: -mixer.hits.size] /= n
    return w


def length_class(n: np.ndarray) -> np.ndarray:
    """0 for 0, else the number of binary digits."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


def length_bits(own: DataFrame) -> np.ndarray:
    """Bits that tell a length, by its class."""
    size = F.octet_length("text")
    counts = np.zeros(41)
    for r in own.groupBy(F.when(size == 0, 0).otherwise(F.length(F.bin(size))).alias("k")).count().collect():
        counts[r.k] = r["count"]
    return -np.log2((counts + 1) / (counts.sum() + len(counts))) + np.maximum(np.arange(len(counts)) - 1, 0)


def fit(docs: DataFrame, groups: int) -> tuple[DataFrame, Mixer, np.ndarray, np.ndarray]:
    """Word and chunk counts, the mixer, far weights and bits of lengths, from docs (doc_id, text, train)."""
    own = docs.where("train").select(F.coalesce("text", F.lit("")).alias("text"))
    size = int(own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    sizes = table_sizes(size)
    last = runs_from(groups, sizes)
    counted = _gather(own, groups, sizes, max(1, -(-size // PIECE)))
    tables, many = [np.zeros(1 << n, np.uint16) for n in sizes], -(-(1 << max(sizes)) >> SHARD)
    for r in counted.where(F.col("grp").between(2 * groups, last - 1)).toLocalIterator():  # at most four bytes for each slot
        predictor, s = divmod(r.grp - 2 * groups, many)
        tables[predictor][(s << SHARD) + _unplanes(r.d1, np.uint16).astype(np.int64)] = _unplanes(r.d2, np.uint16)
    mixer = Mixer(tables)
    mixer.freeze(taught(counted.where(F.col("grp") >= last), mixer))
    return counted.where(F.col("grp") < 2 * groups), mixer, far_weights(counted, groups), length_bits(own)


def score(docs: DataFrame, train: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; train: SQL condition for the rows to learn from."""
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = max(partitions(docs), int(chars) // 40_000_000)
    counted, mixer, far, lengths = fit(docs, groups)
    vocabulary = counted.where(F.col("grp") < groups)

    def sums(batches):
        for b in batches:
            for w, n in zip(_read(b.column(0), np.uint64), _read(b.column(1), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["v", "n"])

    v, total = vocabulary.select("d1", "d2").mapInArrow(sums, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def frequent(batches):
        for b in batches:
            for w, n in zip(_read(b.column(0), np.uint64), _read(b.column(1), np.int64)):
                top = n >= FREQUENT * total
                yield pa.RecordBatch.from_arrays([pa.array(w[top].view(np.int64)), pa.array(n[top])], ["w", "n"])

    top = vocabulary.select("d1", "d2").mapInArrow(frequent, "w long, n long").toArrow()
    hot = top["w"].to_numpy().astype(np.int64).view(np.uint64)
    hot, hot_n = hot[np.argsort(hot)], top["n"].to_numpy().astype(np.int64)[np.argsort(hot)]
    hot_log = np.log10(hot_n + 1.0)
    shared = docs.sparkSession.sparkContext.broadcast((mixer, hot, hot_log, lengths))
    floor = np.log10(total + v + 1)
    schema = "grp long, flush long, " + ", ".join(f"d{k} binary" for k in range(1, 7))

    def scan(batches):
        mixer, hot, hot_log, lengths = shared.value
        n_flush, part = 0, TaskContext.get().partitionId()

        def ask(kind, key, *columns):
            """Distinct keys (in order) to their buckets."""
            edge = np.searchsorted(bucket_of(columns[0], groups), np.arange(groups + 1))
            used = [k for k in range(groups) if edge[k] < edge[k + 1]]
            cut = [[T.blob(c[edge[k] : edge[k + 1]]) for k in used] for c in columns] + [[b""] * len(used)] * (6 - len(columns))
            return _batch(grp=[kind * groups + k for k in used], flush=[key] * len(used), **{f"d{k}": c for k, c in enumerate(cut, 1)})

        def flush(about, words, far):
            """Each distinct word and pair is asked for once; where it stands goes to the flush's own group."""
            nonlocal n_flush
            key = part << 24 | n_flush
            n_flush += 1
            row, word = (np.concatenate(x) for x in zip(*words))
            order = np.argsort(word)
            row, word = row[order], word[order]
            own, context, chunk, bits = (np.concatenate(x) for x in zip(*far))
            order = np.lexsort([chunk, context])
            own, context, chunk, bits = own[order], context[order], chunk[order], bits[order]
            new = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
            other = np.concatenate([[True], (context[1:] != context[:-1]) | (chunk[1:] != chunk[:-1])]) if len(own) else np.zeros(0, bool)
            yield _batch(grp=[2 * groups + key % groups], flush=[key], d1=[b"".join(T.blob(a) for a in about)], d2=[_planes(row.astype(np.uint32))], d3=[np.packbits(new).tobytes()], d4=[_planes(own.astype(np.uint32))], d5=[np.packbits(other).tobytes()], d6=[T.blob(bits.astype(np.float32))])
            yield ask(0, key, word[new])
            yield ask(1, key, context[other], chunk[other])

        about, words, far, held, before = [], [], [], 0, 0
        for batch in batches:
            for part_rows, buf, off in T.slices(batch, "text", SLICE):
                n_rows = part_rows.num_rows
                h, starts, word_off = _words(buf, off)
                own, context, chunk, begin, end = chunks(buf, off, h, starts, word_off)
                run = np.concatenate([[0.0], np.cumsum(mixer.place_bits(buf, off), dtype=np.float64)])
                far.append((own + before, context, chunk, run[end] - run[begin]))
                doc_of = np.repeat(np.arange(n_rows), np.diff(word_off))
                h, doc_of = np.append(h, np.full(n_rows, END)), np.append(doc_of, np.arange(n_rows))
                on = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
                is_hot = hot[on] == h if len(hot) else np.zeros(len(h), bool)
                base = np.bincount(doc_of[is_hot], weights=hot_log[on[is_hot]], minlength=n_rows)
                known = np.bincount(doc_of[is_hot], minlength=n_rows)
                words.append((doc_of[~is_hot] + before, h[~is_hot]))
                info = np.zeros((n_rows, 8))
                ids = part_rows.column(0)
                info[:, 0] = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.float64)
                info[:, 1] = ids.is_valid().to_numpy(zero_copy_only=False)
                info[:, 2] = np.array(part_rows.column(2).to_pylist(), bool)
                info[:, 3], info[:, 4], info[:, 5], info[:, 6], info[:, 7] = np.diff(word_off) + 1, known, base, run[off[1:]] - run[off[:-1]] + lengths[length_class(np.diff(off))], np.diff(off)
                about.append(info)
                before += n_rows
                held += len(buf)
                if held > FLUSH:
                    yield from flush(about, words, far)
                    about, words, far, held, before = [], [], [], 0, 0
        if about:
            yield from flush(about, words, far)

    def look_up(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the words or pairs of a bucket in the order asked; what a flush says of its rows passes through."""
        asked, known, bucket = [], None, 0
        for b in group:
            for r in b.to_pylist():
                bucket = r["grp"]
                if bucket >= 2 * groups:
                    yield _batch(flush=[r["flush"]], kind=[-1], **{f"d{k}": [r[f"d{k}"]] for k in range(1, 7)})
                elif r["flush"] >= 0:
                    asked.append(r)
                else:
                    known = r
        answer = lambda r, *counts: _batch(flush=[r["flush"]], kind=[bucket], **{f"d{k}": [_planes(c.astype(np.int64)) if c is not None else b""] for k, c in enumerate([*counts, *[None] * (6 - len(counts))], 1)})
        if bucket < groups:
            words, counts = (np.frombuffer(known[x], t) for x, t in (("d1", np.uint64), ("d2", np.int64))) if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(words)
            words, counts = words[order], counts[order]
            for r in asked:
                w = np.frombuffer(r["d1"], np.uint64)
                on = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
                yield answer(r, np.where(words[on] == w, counts[on], 0) if len(words) else np.zeros(len(w), np.int64))
        elif bucket < 2 * groups:
            context, chunk, n = (np.frombuffer(known[x], t) if known else np.zeros(0, t) for x, t in (("d1", np.uint64), ("d2", np.uint32), ("d3", np.uint32)))
            run = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            for r in asked:
                c, d = np.frombuffer(r["d1"], np.uint64), np.frombuffer(r["d2"], np.uint32)
                lo, hi = np.searchsorted(context, c), np.searchsorted(context, c, "right")
                seen = run[hi] - run[lo]
                while (open_ := lo < hi).any():  # chunks of a context are in order
                    mid = (lo + hi) >> 1
                    less = open_ & (chunk[np.minimum(mid, len(chunk) - 1)] < d)
                    lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
                at = np.minimum(lo, max(0, len(chunk) - 1))
                same = (lo < len(chunk)) & (context[at] == c) & (chunk[at] == d) if len(chunk) else np.zeros(len(c), bool)
                yield answer(r, np.where(same, n[at], 0) if len(chunk) else np.zeros(len(c), np.int64), seen)

    def finish(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a flush with the counts of their words and chunks."""
        about, parts = None, []
        for b in group:
            for r in b.to_pylist():
                if r["kind"] < 0:
                    about = r
                else:
                    parts.append(r)
        parts.sort(key=lambda r: r["kind"])  # the order of buckets is that of the keys asked for
        given = lambda name, far: np.concatenate([np.zeros(0, np.int64), *(_unplanes(r[name], np.int64) for r in parts if (r["kind"] >= groups) == far)])
        place = lambda name, n: np.cumsum(np.unpackbits(np.frombuffer(about[name], np.uint8))[:n], dtype=np.int64) - 1
        info = np.frombuffer(about["d1"], np.float64).reshape(-1, 8).copy()
        row = _unplanes(about["d2"], np.uint32).astype(np.int64)
        c = given("d1", False)[place("d3", len(row))]
        info[:, 5] += np.bincount(row, weights=np.log10(c + 1.0), minlength=len(info))
        info[:, 4] += np.bincount(row, weights=c > 0, minlength=len(info))
        row = _unplanes(about["d4"], np.uint32).astype(np.int64)
        which = place("d5", len(row))
        bits = np.frombuffer(about["d6"], np.float32).astype(np.float64)
        own = (info[row, 2] != 0).astype(np.int64)  # a training document does not count for itself
        n, seen = (np.maximum(given(x, True)[which] - own, 0) for x in ("d1", "d2"))
        some = np.flatnonzero(seen)
        weight = far[far_level(seen[some])]
        mixed = weight * n[some] / seen[some] + (1 - weight) * np.exp2(-np.minimum(bits[some], 1000))
        spared = bits[some] + np.log2(np.maximum(mixed, 1e-300))
        spared = np.where(n[some] > 0, spared, np.log2(1 - weight))  # nothing is lost to rounding where the chunk is new
        info[:, 6] -= np.bincount(row[some], weights=spared, minlength=len(info))
        ids = pa.array(info[:, 0].copy().view(np.int64), mask=info[:, 1] == 0)
        yield pa.RecordBatch.from_arrays([ids, pa.array(info[:, 2] == 0), pa.array(info[:, 3].astype(np.int64)), pa.array(info[:, 4].astype(np.int64)), pa.array(info[:, 5] - info[:, 3] * floor), pa.array(-info[:, 6] * np.log10(2)), pa.array(info[:, 6] / np.maximum(info[:, 7], 1))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    asked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "train").mapInArrow(scan, schema)
    none = [F.lit(b"").alias(f"d{k}") for k in range(4, 7)]
    counts = counted.select("grp", F.lit(-1).cast("long").alias("flush"), "d1", "d2", "d3", *none)
    found = asked.unionByName(counts).groupBy("grp").applyInArrow(look_up, schema.replace("grp long, flush long", "flush long, kind long"))
    out = found.groupBy("flush").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.withColumn("train_tokens", F.lit(int(total)).cast("long"))
