"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by the ordered list of its nearest reference points (pivots). The inverted lists are kept for
sets of `shared` pivots out of the first `prefix` of that order, so that a list holds just the vectors that share at
least so many pivots: lists of single pivots would grow with the table, these stay short. What a list holds of a vector
is its components as they came and its permutation; from two permutations come the pivots that a pair shares and the
list in which the pair counts, the first of those where it meets. Vectors that meet in a list are compared exactly, in
double precision.

Pivots come from a bounded sample (points apart from each other, filled up with random directions); every vector is
indexed. Equal vectors are one entry with a weight. Lists longer than block vectors are compared block by block, each
pair of blocks in a group of its own, and a group gives back counts and a spanning forest, never pairs.

Recall (pairs with cosine 0.95 or more, against brute force) is measured in tests/llm.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link; rows of one id, or of none, count as vectors of their own and link as others do (a
component of such rows alone has no least id); an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.components import components
from lumagrid.llm.shared import partitions, saved, scratch

PIVOTS = 256
PREFIX = 6
SHARED = 3
BLOCK = 1024


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """n unit vectors: points of a sample of at most 4 n rows, no two closer than cosine 0.7, then random directions."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(4 * n).select("vector").collect()
    found = [np.array(r.vector, float) for r in rows]
    size = max((len(v) for v in found), default=1)
    kept = np.zeros((0, size))
    for v in found:
        if len(v) == size and len(kept) < n and not (kept @ (v / np.linalg.norm(v)) > 0.7).any():
            kept = np.vstack([kept, v / np.linalg.norm(v)])
    more = np.random.default_rng(seed).normal(size=(n - len(kept), size))
    return np.vstack([kept, more / np.linalg.norm(more, axis=1, keepdims=True)])


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    if x.shape[1] != pivots.shape[1]:
        p = np.zeros((len(pivots), x.shape[1]))
        p[:, : pivots.shape[1]] = pivots[:, : x.shape[1]]
        pivots = p
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def lists_of(orders: np.ndarray, n_pivots: int, size: int, shared: int) -> np.ndarray:
    """Keys of the inverted lists of each permutation: one for each set of shared pivots, in order."""
    near = np.sort(orders.astype(np.int64), axis=1)
    sets = [near[:, list(c)] for c in combinations(range(near.shape[1]), shared)]
    keys = np.zeros((len(near), len(sets)), np.int64)
    for k, s in enumerate(sets):
        for c in range(shared):
            keys[:, k] = keys[:, k] * n_pivots + s[:, c]
    h = keys.view(np.uint64) * np.uint64(2) + np.uint64(size << 44)
    return np.sort(T.mix(h.copy()).view(np.int64) >> np.int64(1), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(key: int, ids: np.ndarray, linked: np.ndarray, own: np.ndarray, weight: np.ndarray):
    """Rows of one key (or pair of blocks) and which of them are linked: weight of the links that count here per row, and the least id of its local component."""
    kinds, kind = np.unique(own, axis=0, return_inverse=True)
    kind = kind.ravel()
    big = np.iinfo(np.int64).max
    first = np.full((len(kinds), len(kinds)), big)
    for a in range(len(kinds)):
        first[a] = np.where(np.isin(kinds, kinds[a]), kinds, big).min(1)
    n = (linked & (first[kind[:, None], kind[None, :]] == key)) @ weight
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before = root
        root = np.minimum(root, np.where(linked, root[None, :], big).min(1))
    return n, root


def near_duplicates(table: DataFrame, limit: float = 0.95, vec: str = "vec_id", embedding: str = "embedding", n_pivots: int = PIVOTS, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK, pivots: np.ndarray | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of table."""
    kind = "float" if dict(table.dtypes)[embedding] == "array<float>" else "double"  # vectors travel as they came
    code = {"float": np.float32, "double": np.float64}[kind]
    rows = table.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast(f"array<{kind}>").alias("vector"))
    fine = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)")
    rows = rows.withColumns({"fine": F.coalesce(fine, F.lit(False)), "h1": F.xxhash64("vector"), "h2": F.hash("vector")})
    with scratch(table.sparkSession) as keep:
        # an entry is known by its hashes, so that rows without an id have one too
        entry = F.xxhash64("h1", "h2")
        entries = saved(rows.where("fine").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")).select("h1", "h2", entry.alias("entry"), "id", "weight", "vector"))
        if pivots is None:
            pivots = choose_pivots(entries.select(F.col("entry").alias("id"), "vector"), n_pivots)

        def index(batches):
            for batch in batches:
                ids, vectors = batch.column(0), batch.column(2)
                sizes = np.diff(vectors.offsets.to_numpy())
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    own = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                    orders = permutations(unit(own), pivots, prefix)
                    keys = lists_of(orders, len(pivots), int(size), shared)
                    rep = np.repeat(np.arange(len(at)), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids.take(pa.array(at[rep])), batch.column(1).take(pa.array(at[rep])), pa.array([T.blob(v) for v in own.astype(code)], pa.binary()).take(pa.array(rep)), pa.array([T.blob(k) for k in orders], pa.binary()).take(pa.array(rep))], ["key", "id", "weight", "vector", "order"])

        postings = saved(entries.select("entry", "weight", "vector").mapInArrow(index, "key long, id long, weight long, vector binary, order binary"))
        sizes = saved(postings.groupBy("key").count().where("count > 1"))
        # a long list is dealt to all pairs of its blocks; short lists share groups of many keys
        deal = F.expr(f"""case when count <= {block} then array(named_struct('i', 0, 'j', 0, 'side', 0)) else transform(sequence(0, cast(ceil(count / {block}) as int) - 1), j ->
            named_struct('i', least(j, mine), 'j', greatest(j, mine), 'side', cast(j < mine as int))) end""")
        met = postings.join(sizes, "key").withColumn("mine", F.expr(f"cast(pmod(xxhash64(id), cast(ceil(count / {block}) as int)) as int)"))
        met = met.withColumn("to", F.explode(deal)).select("key", "id", "weight", "vector", "order", F.col("to.i").alias("i"), F.col("to.j").alias("j"), F.col("to.side").alias("side"), F.when(F.col("count") <= block, F.lit(0)).otherwise(F.col("key")).alias("long_key"))
        met_rows, pairs = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.expr(f"case when count > {block} then pow(ceil(count / {block}), 2) end")), F.lit(0))).first()
        groups = max(partitions(table), met_rows // 20_000)
        tasks = int(max(groups, min(pairs, 10_000)))

        def compare(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            key, ids, weight, side = (group[c].to_numpy() for c in ("key", "id", "weight", "side"))
            vectors, orders = ([np.frombuffer(b, t) for b in group[c].to_pylist()] for c, t in (("vector", code), ("order", np.uint16)))
            across = group["i"][0] != group["j"][0]
            by_list = np.lexsort([ids, key])
            cuts = np.flatnonzero(np.diff(key[by_list])) + 1
            same = len({len(v) for v in vectors}) == 1
            units = unit(np.stack(vectors)) if same else None
            out = [[np.zeros(0, np.int64)] * 3]
            for run in np.split(by_list, cuts):
                if len(run) < 2:
                    continue
                x = units[run] if same else unit(np.stack([vectors[r] for r in run]))
                linked = x @ x.T >= limit
                np.fill_diagonal(linked, False)
                if across:  # two blocks: pairs within one are compared elsewhere
                    linked &= side[run][:, None] != side[run][None, :]
                some = np.flatnonzero(linked.any(1))  # most lists hold no link, and need no more than this
                if len(some):
                    rows = run[some]
                    own = lists_of(np.stack([orders[r] for r in rows]), len(pivots), x.shape[1], shared)
                    n, root = _compare(key[run[0]], ids[rows], linked[np.ix_(some, some)], own, weight[rows])
                    told = (root < ids[rows]) | (n > 0)
                    out.append([ids[rows][told], n[told].astype(np.int64), root[told]])
            a, b, c = (np.concatenate(x) for x in zip(*out))
            return pa.table({"id": a, "n": b, "root": c})

        met = met.withColumn("slot", F.when(F.col("long_key") == 0, F.pmod(F.col("key"), F.lit(groups))).otherwise(F.lit(-1)))
        found = saved(met.repartition(tasks, "slot", "long_key", "i", "j").groupBy("slot", "long_key", "i", "j").applyInArrow(compare, "id long, n long, root long"))
        counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "entry")
        parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b").distinct()).select(F.col("id").alias("entry"), "component")
        labelled = saved(entries.drop("vector").join(counts, "entry", "left").join(parts, "entry", "left").withColumn("component", F.coalesce("component", "entry")))
        least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
        linked = labelled.join(least, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("fine"))
        linked = keep(linked)
    out = rows.select("id", "h1", "h2", "fine").join(linked, ["h1", "h2", "fine"], "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
