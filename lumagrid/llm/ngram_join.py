"""N-gram Jaccard self-join by T-occurrence search, divided into short and long inverted lists (DivideSkip).

Two sets of n and m shingles with Jaccard 0.8 or more share at least T = ceil(4 (n + m) / 9) shingles. All shingles
are put in one order: shingles on short inverted lists first, those on long lists last. Two such sets then meet in the
first n - ceil(0.8 n) + 1 shingles of each, so only these go to the inverted lists. Short lists are merged, which counts
how often a pair of sets occurs; pairs that can still reach T with all that was not merged are candidates. Long lists are
never merged into pairs: whether a candidate stands on them is found by binary probes of its sorted shingles. Sets that
meet on long lists only are first checked against one member of the list; those that still lie apart then are compared
block by block.

Whole sets are sent only where a link is possible. Of every candidate the parities of its shingles in a few buckets go
first: two sets differ in at least as many shingles as buckets, and linked ones in at most a ninth of n + m.

Since the result names classes and not pairs, candidates whose sets already hang together are not verified any more.
Equal sets are one entry throughout. A set is known by a 64-bit hash, a shingle by another.

Defined results: null, empty and wordless texts have 0 shingles, link with nothing and are their own class; texts of
fewer than five words are one shingle; repeated rows are one class; rows without an id link as others do (the class of
such rows alone has no least id); long texts are shingled whole; an empty table gives an empty result; other columns,
whatever their names, are kept by `first_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumagrid.llm import text as T
from lumagrid.llm.components import components
from lumagrid.llm.shared import done, fresh, partitions, saved, scratch

WORDS = 5
#: Members from which on an inverted list is long.
LONG = 64
#: Long lists that are told to the tasks beforehand (the longest ones; any others are found when lists are merged).
TOLD = 1_000_000
#: Shingles that one group of inverted lists should hold.
GROUP = 1_500_000
#: Shingles that a task gathers before it deals them out, and pairs of sets that it counts at once.
HELD, COUNTED = 250_000, 250_000
#: Sets that a task remembers, so that equal ones are dealt out once.
SEEN = 100_000
#: Sets in a block of those that are compared with each other.
BLOCK = 256
#: How often members of long lists that lie apart are checked against one further member of their list, before all that still do meet in blocks.
ROUNDS = 2
#: Ids up to which the documents to look at again are broadcast.
SMALL = 2_000_000


def shingles(buf: np.ndarray, off: np.ndarray):
    """Sorted distinct shingle hashes of each row."""
    buf = T.LOWER[buf]
    starts, ends, rows = T.spans(buf, off, T.SPACED)
    h = T.hashes(buf, starts, ends)
    all_ = T.grams(h, WORDS)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= WORDS:
            s = all_[a : b - WORDS + 1]
        else:
            s = T.grams(h[a:b], b - a) if b > a else h[a:b]
        s = np.sort(s)
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def set_id(s: np.ndarray) -> int:
    """One hash of a set."""
    h = T.mix(s ^ np.uint64(0xA5A5F00D12345677)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(T.mix(np.array([h], np.uint64)).view(np.int64)[0])


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def sketch(s: np.ndarray) -> bytes:
    """Size of a set and, for each of four to eight buckets a shingle (a power of two of them), whether it holds an odd number of them."""
    buckets = 1 << max(6, (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.uint64(len(s)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _unsketched(data: bytes) -> tuple[int, np.ndarray]:
    return int(np.frombuffer(data, np.uint64, 1)[0]), np.frombuffer(data, np.uint8, offset=8)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same parities over fewer buckets."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(x: bytes, y: bytes) -> bool:
    """Whether two sets of these sketches may be linked; true for all that are."""
    (n, a), (m, b) = _unsketched(x), _unsketched(y)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum(dtype=np.int64))
    return 9 * max(differ, abs(n - m)) <= n + m


def _may_link_within(sketches: list[bytes], apart: np.ndarray) -> np.ndarray:
    """Which of these sets may be linked to one that lies apart from it."""
    n, bits = (list(x) for x in zip(*map(_unsketched, sketches)))
    n, size = np.array(n), np.array([len(x) for x in bits])
    out = np.zeros(len(n), bool)
    for w in np.unique(size).tolist():  # pairs whose smaller sketch has w bytes
        at = np.flatnonzero(size >= w)
        rows, m, own = np.stack([_folded(bits[k], w) for k in at]), n[at], size[at] == w
        differ = np.abs(m[:, None] - m[None, :])
        odd = np.zeros((len(at), len(at)), np.int64)
        for lo in range(0, w, 256):
            has = np.unpackbits(rows[:, lo : lo + 256], axis=1).astype(np.float32)
            ones = has.sum(1)
            odd += (ones[:, None] + ones[None, :] - 2 * (has @ has.T)).astype(np.int64)
        may = (9 * np.maximum(differ, odd) <= m[:, None] + m[None, :]) & (own[:, None] | own[None, :]) & apart[np.ix_(at, at)]
        out[at] |= may.any(1)
    return out


def _packed(sid: np.ndarray, count: np.ndarray, n: np.ndarray, x: np.ndarray) -> bytes:
    """Sets of runs of shingles: id, length of the run, size, told long lists; halves of sizes apart, since high ones are alike."""
    return T.blob(sid) + T.blob(count.astype(np.uint32)) + T.blob(x.astype(np.uint32)) + T.blob(n.astype("<u4").view("<u2").reshape(-1, 2).T)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(data) // 20
    sid, (count, x) = np.frombuffer(data, np.int64, k), np.frombuffer(data, np.uint32, 2 * k, 8 * k).reshape(2, k)
    return sid, count, np.ascontiguousarray(np.frombuffer(data, "<u2", 2 * k, 16 * k).reshape(2, k).T).view("<u4").ravel(), x


def _concat(x: list[np.ndarray], t) -> np.ndarray:
    return np.concatenate(x) if x else np.zeros(0, t)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(sorted_)))


def _members_and_long_lists(slim: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, sid, row) of every document, where row is doc_id or a hash of the text; long lists (shingle, n)."""
    schema = "kind int, doc_id long, n long, sid long, row long, bucket int, data binary, counts binary"

    def batch(kind, doc, n, sid, row, bucket, data, counts):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(bucket), pa.int32()), doc, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), row, pa.array(bucket, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], [f.split()[0] for f in schema.split(", ")])

    def flush(heads):
        s = np.sort(_concat(heads, np.uint64))
        at, count = _runs(s)
        s = s[at]
        bucket = (s % np.uint64(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        s, count = s[order], count[order].astype(np.uint32)
        edge = np.searchsorted(bucket[order], np.arange(groups + 1))
        used = [k for k in range(groups) if edge[k] < edge[k + 1]]
        none = [None] * len(used)
        return batch(1, pa.array(none, pa.int64()), none, none, pa.array(none, pa.int64()), used, [T.blob(s[edge[k] : edge[k + 1]]) for k in used], [T.blob(count[edge[k] : edge[k + 1]]) for k in used])

    def scan(batches):
        seen, heads, held = set(), [], 0
        for b in batches:
            for rows, buf, off in T.slices(b, "text"):
                n, sid = [], []
                for s in shingles(buf, off):
                    n.append(len(s))
                    sid.append(set_id(s))
                    if len(s) and sid[-1] not in seen:
                        seen.add(sid[-1])
                        heads.append(s[: prefix_size(len(s))])
                        held += len(heads[-1])
                none = [None] * len(n)
                yield batch(0, rows.column(0), n, sid, rows.column(2), none, none, none)
                if held > HELD:
                    yield flush(heads)
                    heads, held = [], 0
                if len(seen) > SEEN:
                    seen = set()
        if held:
            yield flush(heads)

    def count(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in group:
            keys += [np.frombuffer(x, np.uint64) for x in b.column(6).to_pylist()]
            counts += [np.frombuffer(x, np.uint32) for x in b.column(7).to_pylist()]
        s, c = _concat(keys, np.uint64), _concat(counts, np.uint32).astype(np.int64)
        order = np.argsort(s)
        at, _ = _runs(s[order])
        total = np.add.reduceat(c[order], at) if len(at) else c
        long = total > LONG
        yield pa.RecordBatch.from_arrays([pa.array(s[order][at][long].view(np.int64)), pa.array(total[long])], ["shingle", "n"])

    # members stay where they are: only lists are dealt out, so that a hot set gathers nowhere
    scanned = saved(slim.mapInArrow(scan, schema))
    lists = scanned.where("kind = 1").repartition(groups, "bucket").groupBy("bucket").applyInArrow(count, "shingle long, n long")
    lists, members = saved(lists), saved(scanned.where("kind = 0").select("doc_id", "n", "sid", "row"))
    done(scanned)
    return members, lists


def _merge(slim: DataFrame, long: np.ndarray, groups: int) -> DataFrame:
    """kind 0: pair a < b of sets, of sizes that can link, that meet c times on short lists and must do so need times; kind 1: set b is on the long list of shingle a, c = 1 if that was not told."""
    schema = "bucket int, data binary, sets binary"

    def flush(heads, tails):
        key, of = _concat([h for h, *_ in heads], np.uint64), np.repeat(np.arange(len(heads)), [len(h) for h, *_ in heads])
        sid, n, x = np.array([i for _, i, _, _ in heads], np.int64), np.array([n for _, _, n, _ in heads], np.int64), np.array([x for *_, x in heads], np.int64)
        bucket = (key % np.uint64(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, of = key[order], of[order]
        edge = np.searchsorted(bucket[order], np.arange(groups + 1))
        used = [k for k in range(groups) if edge[k] < edge[k + 1]]
        data, sets = [T.blob(key[edge[k] : edge[k + 1]]) for k in used], []
        for k in used:
            own = of[edge[k] : edge[k + 1]]
            at, count = _runs(own)
            own = own[at]
            sets.append(_packed(sid[own], count, n[own], x[own]))
        for t, i, n, x in tails:  # members of long lists are dealt by set, not by list
            used.append(-1 - abs(i) % groups)
            data.append(T.blob(t))
            sets.append(_packed(*(np.array([v], np.int64) for v in (i, len(t), n, x))))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary()), pa.array(sets, pa.binary())], ["bucket", "data", "sets"])

    def scan(batches):
        seen, heads, tails, held = set(), [], [], 0
        for b in batches:
            for _, buf, off in T.slices(b, "text"):
                for s in shingles(buf, off):
                    if not len(s) or (i := set_id(s)) in seen:
                        continue
                    seen.add(i)
                    p = prefix_size(len(s))
                    on = np.minimum(np.searchsorted(long, s), max(0, len(long) - 1))
                    is_long = long[on] == s if len(long) else np.zeros(len(s), bool)
                    head = s[~is_long][:p]
                    x = p - len(head)
                    heads.append((head, i, len(s), x))
                    held += p
                    if x:
                        tails.append((s[is_long][:x], i, len(s), x))
                if held > HELD:
                    yield flush(heads, tails)
                    heads, tails, held = [], [], 0
                if len(seen) > SEEN:
                    seen = set()
        if held:
            yield flush(heads, tails)

    def merge(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs, told = [], [], False
        for b in group:
            told = b.num_rows and b.column(0)[0].as_py() < 0
            k, r = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()], [_unpacked(x) for x in b.column(2).to_pylist()]
            if told:
                yield _out(1, _concat(k, np.uint64).view(np.int64), _concat([np.repeat(i, count) for i, count, _, _ in r], np.int64), 0, 0)
            else:
                keys, runs = keys + k, runs + r
        if told:
            return
        key = _concat(keys, np.uint64)
        sid, count, size, x = (_concat([r[k] for r in runs], np.int64).astype(np.int64) for k in range(4))
        del keys, runs
        sid, at, code = np.unique(sid, return_index=True, return_inverse=True)  # sets by their place in the order of ids
        size, rest = size[at], -(-4 * size[at] // 5) - 1 + x[at]  # shingles that short lists do not count
        of = np.repeat(code.astype(np.int32), count)
        order = np.lexsort([of, key])
        key, of = key[order], of[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.zeros(0, bool)
        key, of = key[new], of[new]
        at, members = _runs(key)
        on_long = np.repeat(members > LONG, members)
        yield _out(1, key[on_long].view(np.int64), sid[of[on_long]], 1, 0)
        left = np.repeat(at + members, members) - np.arange(len(key)) - 1  # members of the list after this one
        left[on_long] = 0
        del key, order, new, on_long
        passes = 1 + int(left.sum()) // COUNTED  # all pairs of a set are counted in one pass
        turn = of % passes
        for p in range(passes):
            pairs, k, own = [], 1, np.flatnonzero((turn == p) & (left > 0))
            while len(own):
                a, b = of[own], of[own + k]
                n, m = size[a], size[b]
                fit = 10 * np.minimum(n, m) >= 8 * np.maximum(n, m)
                pairs.append(a[fit].astype(np.int64) * len(sid) + b[fit])
                k += 1
                own = own[left[own] >= k]
            pairs = np.sort(_concat(pairs, np.int64))
            at, c = _runs(pairs)
            pairs = pairs[at]
            for lo in range(0, len(pairs), 100_000):
                a, b = np.divmod(pairs[lo : lo + 100_000], len(sid))
                need = -(-4 * (size[a] + size[b]) // 9) - np.maximum(rest[a], rest[b])
                yield _out(0, sid[a], sid[b], c[lo : lo + 100_000], need)

    def _out(kind, a, b, c, need):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), *(pa.array(np.broadcast_to(np.asarray(v, np.int64), n).copy()) for v in (c, need))], ["kind", "a", "b", "c", "need"])

    dealt = slim.mapInArrow(scan, schema).repartition(groups, "bucket")
    return saved(dealt.groupBy("bucket").applyInArrow(merge, "kind int, a long, b long, c long, need long"))


def _near(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that may be linked, by how often they meet on short lists."""
    # long lists that were not told: a set stands on x of them
    others = saved(met.where("kind = 1 and c = 1").groupBy(F.col("b").alias("id")).agg(F.count("*").alias("x")))
    most = others.agg(F.coalesce(F.max("x"), F.lit(0))).first()[0]
    lacking = met.where("kind = 0").groupBy("a", "b").agg((F.min("need") - F.sum("c")).alias("lack")).where(F.col("lack") <= most)
    if not most:
        near = saved(lacking.select("a", "b"))
    else:
        lacking = saved(lacking)
        of = lambda side: others.select(F.col("id").alias(side), F.col("x").alias(f"x{side}"))
        unsure = lacking.where("lack > 0").join(of("a"), "a", "left").join(of("b"), "b", "left").where("greatest(xa, xb) >= lack")
        near = saved(lacking.where("lack <= 0").select("a", "b").unionByName(unsure.select("a", "b")))
        done(lacking)
    done(others)
    return near


def _sets(roles: DataFrame, slim: DataFrame, reps: DataFrame, made: Callable[[np.ndarray], bytes] = T.blob) -> DataFrame:
    """roles (sid, to) with the shingles of each set, or what is made of them, taken from one document that has it."""
    roles = saved(roles.join(reps, "sid").groupBy("doc_id", "sid").agg(F.collect_list("to").alias("to")))
    ids = roles.select("doc_id").distinct()
    wanted = slim.join(F.broadcast(ids) if roles.count() <= SMALL else ids, "doc_id", "left_semi")

    def scan(batches):
        seen = set()
        for b in batches:
            for rows, buf, off in T.slices(b, "text"):
                ids, sids, data = [], [], []
                for i, s in zip(rows.column(0).to_pylist(), shingles(buf, off)):
                    if (i, k := set_id(s)) not in seen:  # rows that agree in id and set are one
                        seen.add((i, k))
                        ids.append(i)
                        sids.append(k)
                        data.append(made(s))
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "sid", "shingles"])

    found = wanted.mapInArrow(scan, "doc_id long, sid long, shingles binary")
    return found.join(roles, ["doc_id", "sid"]).select("sid", "shingles", F.explode("to").alias("to")).select("sid", "shingles", "to.*")


def _verify(pairs: DataFrame, slim: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are linked. Every set goes to the group of its partner a; large groups are split."""
    pairs = saved(pairs.select("a", "b").distinct())
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("k"))
    ones = pairs.join(sizes, "a").select(F.col("b").alias("sid"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part")).alias("to"))
    hubs = sizes.select(F.col("a").alias("sid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.col("a"), i.alias("part")))).alias("to"))

    def hopeful(group: pa.Table) -> pa.Table:
        a = group["a"][0].as_py()
        own = dict(zip(group["sid"].to_pylist(), group["shingles"].to_pylist()))
        hub = own.pop(a)
        good = [sid for sid, x in own.items() if may_link(hub, x)]
        good += [a] * bool(good)
        return pa.table({"sid": pa.array(good, pa.int64()), "a": pa.array([a] * len(good), pa.int64()), "part": pa.array([group["part"][0].as_py()] * len(good), pa.int32())})

    def probe(group: pa.Table) -> pa.Table:
        a = group["a"][0].as_py()
        own = dict(zip(group["sid"].to_pylist(), group["shingles"].to_pylist()))
        hub = np.frombuffer(own.pop(a), np.uint64)
        good = []
        for sid, data in own.items():
            s = np.frombuffer(data, np.uint64)
            few, many = (s, hub) if len(s) < len(hub) else (hub, s)
            shared = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
            if 9 * shared >= 4 * (len(s) + len(hub)):
                good.append(sid)
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    left = saved(_sets(ones.unionByName(hubs), slim, reps, sketch).groupBy("a", "part").applyInArrow(hopeful, "sid long, a long, part int"))
    found = saved(_sets(left.select("sid", F.struct("a", "part").alias("to")), slim, reps).groupBy("a", "part").applyInArrow(probe, "a long, b long"))
    done(pairs, left)
    return found


def _verify_within(members: DataFrame, slim: DataFrame, reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """members (cluster, sid, n, component): links between sets of one cluster and different components.

    Sets are dealt to blocks by size class, so that linked ones lie in the same class or in neighbouring ones; each
    pair of blocks is one group of bounded size, which gives back a spanning forest of its links. Blocks of the largest
    component of a class never meet each other, so a family that hangs together costs in proportion to its size.
    """
    members = saved(members.withColumn("c", F.floor(F.log("n") / 0.2232).cast("int")))  # just over ln 1.25
    parts = members.groupBy("cluster", "c", "component").agg(F.count("*").alias("m")).groupBy("cluster", "c").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m"))
    sizes = saved(parts.select("cluster", "c", F.struct("main", F.ceil(F.col("most") / block).cast("int").alias("k"), F.ceil((F.col("m") - F.col("most")) / block).cast("int").alias("rest")).alias("own")))
    for d, name in ((0, "own"), (1, "up"), (-1, "down")):
        members = members.join(sizes.select("cluster", (F.col("c") - d).alias("c"), F.col("own").alias(name)), ["cluster", "c"], "left")
    members = members.withColumn("inner", F.col("component") == F.col("own.main"))
    members = members.withColumn("j", F.expr("cast(if(inner, pmod(xxhash64(sid), own.k), own.k + pmod(xxhash64(sid), own.rest)) as int)"))
    group = "named_struct('cluster', cluster, 'la', {la}, 'ja', {ja}, 'lb', {lb}, 'jb', {jb}, 'side', {side}, 'component', component)"

    def met(of: str, **names: str) -> str:
        """The blocks of a class that a set has to meet, as groups."""
        first = f"if(inner and own.main = {of}.main, {of}.k, 0)"
        return f"case when {of} is null or {first} >= {of}.k + {of}.rest then array() else transform(sequence({first}, {of}.k + {of}.rest - 1), i -> {group.format(**names)}) end"

    to = F.expr(f"""concat({met('own', la='c', ja='least(i, j)', lb='c', jb='greatest(i, j)', side='cast(i < j as int)')},
        {met('up', la='c', ja='j', lb='c + 1', jb='i', side='0')},
        {met('down', la='c - 1', ja='i', lb='c', jb='j', side='1')})""")

    def apart(table: pa.Table) -> np.ndarray:
        """Which sets of a group are to be compared: those of different components and, if it has two blocks, of both."""
        first = {k: table[k][0].as_py() for k in ("la", "ja", "lb", "jb")}
        side, component = (table[k].to_numpy() for k in ("side", "component"))
        out = component[:, None] != component[None, :]
        return out & (side[:, None] != side[None, :]) if (first["la"], first["ja"]) != (first["lb"], first["jb"]) else out

    def hopeful(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table["sid"].to_numpy(), return_index=True)[1]))  # copies of a row may have been read by several tasks
        keep = _may_link_within(table["shingles"].to_pylist(), apart(table))
        return table.select(["sid", *to_names]).filter(pa.array(keep))

    def compare(table: pa.Table) -> pa.Table:
        sid = table["sid"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), n)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, column = row[count[column] > 1], column[count[column] > 1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], np.cumsum(np.concatenate([[0], np.diff(column[order]) != 0])) if len(row) else column
        shared = np.zeros((len(sets), len(sets)), np.int64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            has = np.zeros((len(sets), 2048), np.float32)
            has[row[lo:hi], column[lo:hi] - at] = 1
            shared += (has @ has.T).astype(np.int64)
        linked = (9 * shared >= 4 * (n[:, None] + n[None, :])) & apart(table)
        big = np.iinfo(np.int64).max
        root, before = sid.copy(), None
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(linked, root[None, :], big).min(1))
        own = root != sid
        return pa.table({"a": root[own], "b": sid[own]})

    dealt = members.select("sid", F.explode(to).alias("to"))
    to_names = dealt.select("to.*").columns
    where = ["cluster", "la", "ja", "lb", "jb"]
    left = saved(_sets(dealt, slim, reps, sketch).groupBy(*where).applyInArrow(hopeful, dealt.select("sid", "to.*").schema))
    found = saved(_sets(left.select("sid", F.struct(*to_names).alias("to")), slim, reps).groupBy(*where).applyInArrow(compare, "a long, b long"))
    done(left)
    return found


def _named(parts: DataFrame, side: str) -> DataFrame:
    return parts.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose sets are in different components so far."""
    out = pairs.join(_named(parts, "a"), "a", "left").join(_named(parts, "b"), "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _list_parts(long: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of long lists (shingle, sid, n) with the component that each belongs to so far."""
    return long.join(parts.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _labels(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, sid) of every row, and for every set of shingles the least id of its class (sid, class, least)."""
    with scratch(docs.sparkSession) as keep:
        # a row without an id goes by its text where sets are fetched again
        slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        chars = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        groups = max(partitions(docs), int(chars) // 30 // GROUP)
        keyed = slim.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text")
        members, lists = _members_and_long_lists(slim.withColumn("row", F.coalesce("doc_id", F.xxhash64("text"))), groups)
        told = lists.orderBy(F.desc("n"), "shingle").limit(TOLD).select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64)
        met = _merge(slim, np.sort(told.view(np.uint64)), groups)
        sets = saved(members.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("row").alias("row")))
        reps = sets.select("sid", F.col("row").alias("doc_id"))
        long = saved(met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("sid")).distinct().join(sets.select("sid", "n"), "sid"))
        near = _near(met)
        done(met)
        # first one partner for each set and one for each member of a long list, then what still lies apart
        first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        some_long = bool(long.head(1))
        if some_long:
            hubs = long.groupBy("shingle").agg(F.min(F.struct("sid", "n")).alias("hub"))
            star = long.join(hubs, "shingle").where("sid != hub.sid and 10 * least(n, hub.n) >= 8 * greatest(n, hub.n)")
            first = first.unionByName(star.select(F.col("hub.sid").alias("a"), F.col("sid").alias("b")))
        edges = _verify(first, keyed, reps)
        parts = saved(components(edges))
        for k in range(ROUNDS if some_long else 0):  # members of long lists against one more of them
            now = _list_parts(long, parts)
            mixed = saved(now.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by(F.struct("sid", "n", "component"), F.xxhash64("sid", F.lit(k))).alias("hub")).where("lo != hi"))
            star = now.join(mixed.select("shingle", "hub"), "shingle").where("component != hub.component and 10 * least(n, hub.n) >= 8 * greatest(n, hub.n)")
            found = _verify(star.select(F.col("hub.sid").alias("a"), F.col("sid").alias("b")), keyed, reps)
            if not found.head(1):
                break
            edges = saved(edges.unionByName(found))
            parts = saved(components(edges))
        more = _verify(_apart(near, parts), keyed, reps)
        if some_long:
            now = saved(_list_parts(long, parts))
            mixed = now.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("sid").alias("hub")).where("lo != hi").select("shingle", "hub")
            now = now.join(mixed, "shingle").select("sid", "n", "component", "hub").distinct()
            now = saved(now)
            cluster = components(now.select(F.col("sid").alias("a"), F.col("hub").alias("b")))
            apart = now.select("sid", "n", "component").distinct().join(cluster.select(F.col("id").alias("sid"), F.col("component").alias("cluster")), "sid")
            more = more.unionByName(_verify_within(apart, keyed, reps))
        if more.head(1):
            parts = saved(components(edges.unionByName(more)))
        label = sets.join(parts.select(F.col("id").alias("sid"), "component"), "sid", "left").select("sid", "doc_id", F.coalesce("component", "sid").alias("class"))
        least = label.groupBy("class").agg(F.min("doc_id").alias("least"))
        kept, label = keep(members), keep(label.join(least, "class").select("sid", "class", "least"))
    return kept.select("doc_id", "n", "sid"), label


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    members, label = _labels(docs, doc, text)
    out = members.join(label, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the least id, and any one where that id (or no id) has several. Rows without words all stay."""
    members, label = _labels(docs, doc, text)
    known = saved(members.join(label, "sid", "left").select("doc_id", "n", F.col("doc_id").eqNullSafe(F.col("least")).alias("first")))
    ids = known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("first") | (F.col("n") == 0)).alias("stays"))
    # an id of a single row decides by itself; rows of an id that stands in several (or of none) are looked at one by one
    gone = saved(ids.where("doc_id is not null and rows = 1 and not stays").select("doc_id"))
    many = saved(ids.where("doc_id is null or rows > 1").select("doc_id"))
    own = fresh(docs, "own_id")
    keyed = docs.withColumn(own, F.col(doc).cast("long"))
    small = lambda df: F.broadcast(df.withColumnRenamed("doc_id", own)) if df.count() <= SMALL else df.withColumnRenamed("doc_id", own)
    if not many.head(1):
        return keyed.join(small(gone), own, "left_anti").drop(own)
    split = keyed.join(small(gone), own, "left_anti")
    single = split.where(F.col(own).isNotNull()).join(small(many.where("doc_id is not null")), own, "left_anti")
    rest = keyed.where(F.col(own).isNull()).unionByName(keyed.join(small(many.where("doc_id is not null")), own, "left_semi").select(*[F.col(f"`{c}`") for c in keyed.columns]))
    sid = fresh(rest, "set_id")

    def name(batches):
        for b in batches:
            for rows, buf, off in T.slices(b, text):
                own_sets = [set_id(s) if len(s) else None for s in shingles(buf, off)]
                yield rows.append_column(sid, pa.array(own_sets, pa.int64()))

    named = rest.mapInArrow(name, StructType([*rest.schema.fields, StructField(sid, LongType())]))
    kind, least = fresh(named, "class"), fresh(named, "least")
    named = named.join(label.select(F.col("sid").alias(sid), F.col("class").alias(kind), F.col("least").alias(least)), sid, "left")
    wordless = named.where(F.col(sid).isNull())
    firsts = named.where(F.col(sid).isNotNull() & F.col(own).eqNullSafe(F.col(least))).dropDuplicates([kind])
    return single.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(wordless.select(*[F.col(f"`{c}`") for c in docs.columns])).unionByName(firsts.select(*[F.col(f"`{c}`") for c in docs.columns]))
