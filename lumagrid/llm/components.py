"""Connected components of link tables.

Tasks of a bounded number of links each first reduce their links to a forest. If that was one task, it is the answer;
otherwise alternating large-star and small-star steps (Kiveris et al., 2014) join the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm.shared import saved, scratch

#: Links that one task reduces.
LINKS = 500_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").selectExpr("b as a", "m as b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b"))
    return out.where("a != b").distinct()


def _forest(batches):
    """Links of a task as stars: every id with the least id of its part."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(ids))
    while True:  # hook the larger root under the smaller, then shorten all paths
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(ids)))
    for at in range(0, len(own), 100_000):
        k = own[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[root[k]])], ["a", "b"])


def components(edges: DataFrame, links: int = LINKS) -> DataFrame:
    """edges (a, b), each long: id and component (the least id that is reachable) for every id that has an edge to another."""
    with scratch(edges.sparkSession) as keep:
        edges = saved(edges.where("a != b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
        tasks = -(-edges.count() // links)
        edges = saved(edges.coalesce(max(1, tasks)).mapInArrow(_forest, "a long, b long"))
        last = None
        while tasks > 1:
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == last:
                break
            last = now
            edges = saved(_small(_large(edges)))
        keep(edges)
    return edges.selectExpr("a as id", "b as component").unionByName(edges.selectExpr("b as id", "b as component").distinct())
