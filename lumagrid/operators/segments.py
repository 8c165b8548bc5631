"""Graph segmentation: regions whose outer differences stand out against the differences within them.

Pixels are linked with their neighbours to the right and below, weighed by the difference of their values (ties by a
fixed number of each link). In each round every region looks at its lightest link. If that is heavier than the region's
heaviest inner link plus scale / size, the region is done: its links go. Otherwise, if it fits the other region in the
same way, the link is taken; all regions that taken links hold together become one. This is the greedy segmentation of
Felzenszwalb and Huttenlocher in the rounds of Boruvka's algorithm: regions at least halve in number for all links taken,
so rounds grow with the logarithm of the largest region. A raster's links are all in its row, so its rounds run within
the task, for a stack of rasters at once. For rasters beyond `kernels.WITHIN` pixels every round is a few groupings and
joins by image and region, with the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.operators import kernels as K
from lumagrid.operators.links import contracted
from lumagrid.sources.scratch import Rounds


def pixel_links(images: DataFrame) -> DataFrame:
    """group (the image), a, b (places of neighbouring pixels), weight, tie."""
    right = "if(i % w < w - 1, struct(i as a, i + 1 as b, abs(v[i] - v[i + 1]) as weight), null)"
    below = "if(i div w < h - 1, struct(i as a, i + w as b, abs(v[i] - v[i + w]) as weight), null)"
    links = F.expr(f"inline(transform(array(v), v -> filter(flatten(transform(sequence(0, h * w - 1), i -> array({right}, {below}))), e -> e.weight is not null))[0])")
    out = images.where("v is not null and h > 0 and w > 0").select(F.col("image_id").alias("group"), links)
    return out.selectExpr("group", "cast(a as long) as a", "cast(b as long) as b", "weight", "pmod((a * 2L + if(b = a + 1, 0, 1)) * 2654435761L, 4294967296L) as tie")


def _rooted(rounds: Rounds, picks: DataFrame, jumps: int = 4) -> DataFrame:
    """picks (group, id, to, ...), whose pointers lead to ids that point at themselves: to becomes that id."""
    own = picks
    while True:
        for _ in range(jumps):
            far = own.select("group", F.col("id").alias("to"), F.col("to").alias("far"))
            own = own.join(far, ["group", "to"]).withColumn("to", F.col("far")).drop("far")
        own = rounds.written(own)
        ends = own.select("group", F.col("id").alias("to"), (F.col("id") == F.col("to")).alias("is_end"))
        if not own.join(ends, ["group", "to"]).where("not is_end").limit(1).count():
            return own


def joined(links: DataFrame, scale: float = 100.0) -> DataFrame:
    """links (group, a, b, weight, tie): group, id, root for every id that taken links join with a lesser one, by the rounds in which they do."""
    rounds, taken = Rounds(links.sparkSession), None
    ends = [f"{c}{k}" for c in ("size", "inner") for k in "ab"]
    own = rounds.written(links.selectExpr("group", "a", "b", "weight", "tie", "1L as sizea", "1L as sizeb", "0 as innera", "0 as innerb"))
    fits = lambda k: f"weight <= inner{k} + {float(scale)}D / size{k}"
    while own.limit(1).count():
        side = lambda k, o: own.selectExpr("group", f"{k} as id", f"struct(weight, tie, {o} as other, size{k} as size, inner{k} as inner, {fits(k)} as fits, {fits(o)} as fits_other) as e")
        least = side("a", "b").unionByName(side("b", "a")).groupBy("group", "id").agg(F.min("e").alias("e")).select("group", "id", "e.*")
        picks = rounds.written(least.withColumn("to", F.expr("if(fits and fits_other, other, id)")).drop("fits_other"))
        # where two regions pick the same link, the lesser one is their end
        back = picks.select("group", F.col("id").alias("to"), F.col("to").alias("back"))
        ended = picks.join(back, ["group", "to"]).withColumn("heavy", F.expr("if(to = id, 0, weight)")).withColumn("to", F.expr("if(back = id, least(id, to), to)"))
        rooted = _rooted(rounds, ended.select("group", "id", "to", "size", "inner", "heavy", F.col("fits").alias("live")))
        whole = rooted.groupBy("group", "to").agg(F.sum("size").alias("size"), F.greatest(F.max("inner"), F.max("heavy")).alias("inner"), F.count("*").alias("n"))
        told = rounds.written(rooted.select("group", "id", "to", "live").join(whole, ["group", "to"]).selectExpr("group", "id", "to", "size", "inner", "live or n > 1 as live"))
        step = told.where("id != to").select("group", "id", F.col("to").alias("root"))
        taken = step if taken is None else taken.unionByName(step)
        for k in "ab":
            own = own.drop(f"size{k}", f"inner{k}").join(told.selectExpr("group", f"id as {k}", "to", f"size as size{k}", f"inner as inner{k}", "live"), ["group", k]).where("live").drop(k, "live").withColumnRenamed("to", k)
        # of the links between two regions the lightest stands for all
        own = own.where("a != b").selectExpr("group", "least(a, b) as a", "greatest(a, b) as b", "weight", "tie", *[f"if(a < b, {c}a, {c}b) as {c}a" for c in ("size", "inner")], *[f"if(a < b, {c}b, {c}a) as {c}b" for c in ("size", "inner")])
        lightest = own.groupBy("group", "a", "b", *ends).agg(F.min(F.struct("weight", "tie")).alias("e"))
        own = rounds.written(lightest.select("group", "a", "b", "e.weight", "e.tie", *ends))
    return links.selectExpr("group", "a as id", "b as root").where("false") if taken is None else taken


def _stack_labels(stack: np.ndarray, scale: float) -> np.ndarray:
    """Each pixel's label, by the same rounds as those of joined; places count through the stack."""
    n, h, w = stack.shape
    place, own = np.arange(stack.size).reshape(n, h, w), np.arange(h * w).reshape(h, w)
    cut = [(np.s_[:, :, :-1], np.s_[:, :, 1:]), (np.s_[:, :-1], np.s_[:, 1:])]
    a, b, tie = (np.concatenate(x) for x in zip(*[(place[p].ravel(), place[q].ravel(), np.broadcast_to((own[p[1:]] * 2 + k) * 2654435761 % (1 << 32), place[p].shape).ravel()) for k, (p, q) in enumerate(cut)]))
    weight = np.abs(stack.ravel()[a] - stack.ravel()[b])
    order = np.lexsort([tie, weight])  # from now on a link's place is its rank
    order = order[~np.isnan(weight[order])]
    a, b, weight = a[order], b[order], weight[order]
    label, size, inner = place.ravel().copy(), np.ones(stack.size, np.int64), np.zeros(stack.size)
    while len(a):
        regions = np.unique(np.concatenate([a, b]))
        least = np.full(stack.size, len(a))
        for ends in (a, b):
            np.minimum.at(least, ends, np.arange(len(a)))
        e = least[regions]
        other = a[e] + b[e] - regions
        fits = lambda r: weight[e] <= inner[r] + scale / size[r]
        live = np.zeros(stack.size, bool)
        live[regions] = fits(regions)
        took = live[regions] & fits(other)
        low, high = np.minimum(regions, other)[took], np.maximum(regions, other)[took]
        root = np.arange(stack.size)
        while (root[low] != root[high]).any():  # hook the later root under the earlier one, then shorten all paths
            x, y = root[low], root[high]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        gone = regions[root[regions] != regions]
        np.add.at(size, root[gone], size[gone])
        np.maximum.at(inner, root[gone], inner[gone])
        np.maximum.at(inner, root[low], weight[e][took])
        live[root[low]] = True
        label = root[label]
        a, b = root[a], root[b]
        stay = (a != b) & live[a] & live[b]
        a, b, weight = a[stay], b[stay], weight[stay]
    return label.reshape(n, h, w) - (np.arange(n) * (h * w))[:, None, None]


def graph_segments(images: DataFrame, scale: float = 100.0, within: int = K.WITHIN) -> DataFrame:
    """image_id, y, x, label: a label is the place of its region's first pixel."""

    def work(stack):
        n, h, w = stack.shape
        labels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (h * w), pa.int32()), pa.array(_stack_labels(stack, scale).ravel()))
        return np.arange(n), [np.full(n, w, np.int32), labels]

    def small(d):
        rows = K.map_stacks(d.where("h > 0 and w > 0"), work, "w int, label array<bigint>").select("image_id", "w", F.posexplode("label").alias("i", "label"))
        return rows.selectExpr("image_id", "cast(i div w as int) as y", "cast(i % w as int) as x", "label")

    return K.by_size(images, small, lambda d: _by_tables(d, scale), within)


def _by_tables(images: DataFrame, scale: float) -> DataFrame:
    """graph_segments by rounds over tables."""
    roots = contracted(joined(pixel_links(images), scale).selectExpr("group", "id as a", "root as b"))
    places = images.where("v is not null and h > 0 and w > 0").select(F.col("image_id").alias("group"), "w", F.expr("explode(sequence(0L, cast(h as long) * w - 1))").alias("id"))
    label = F.coalesce("root", "id").alias("label")
    return places.join(roots, ["group", "id"], "left").select(F.col("group").alias("image_id"), F.expr("cast(id div w as int)").alias("y"), F.expr("cast(id % w as int)").alias("x"), label)
