"""Closed outlines of ink along pixel borders, by pointer doubling over the sides of pixels.

A side of an ink pixel that faces no ink is a step of an outline, with the ink on its right hand. Which step comes
before it depends on two pixels near its start, so pointers are made within the row. They are ranked in their rings in
rounds that grow with the logarithm of the longest outline: within the task, since a raster's pointers are all there, and
by joins for rasters beyond `kernels.WITHIN` pixels. Where ink meets at a corner only, the outline stays with its pixel,
so outlines bound 4-connected regions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.functions import raster as R
from lumagrid.operators import kernels as K
from lumagrid.operators.links import ranked

#: Sides of a pixel, in the order of their numbers: name, the pixel that it faces, the start of its step (as dy, dx).
SIDES = [("n", (-1, 0), (0, 0)), ("e", (0, 1), (0, 1)), ("s", (1, 0), (1, 1)), ("w", (0, -1), (1, 0))]


def _before(k: int) -> tuple[tuple[int, int], tuple[int, int], int, int]:
    """For a side: the pixel behind it, the one behind and outside, and the sides on which the outline comes where it turns right and left."""
    (dy, dx) = SIDES[(k + 3) % 4][1]
    out = SIDES[k][1]
    return (dy, dx), (dy + out[0], dx + out[1]), (k + 3) % 4, (k + 1) % 4


def _steps(over: int) -> str:
    """Steps of a raster in order, with the one before each: an array of id and to. An id is four times the pixel's place plus the side's number."""

    def ink(dy: int, dx: int) -> str:
        return f"coalesce(({R.inside(dy, dx, '-1')}) > {over}, false)"  # an unknown pixel is no ink

    def place(dy: int, dx: int) -> str:
        return f"(i + {dy} * w + {dx})"

    sides = []
    for k, (_, (dy, dx), _) in enumerate(SIDES):
        behind, beyond, right, left = _before(k)
        to = f"case when not ({ink(*behind)}) then 4L * i + {right} when not ({ink(*beyond)}) then 4L * {place(*behind)} + {k} else 4L * {place(*beyond)} + {left} end"
        sides.append(f"if({ink(dy, dx)}, null, struct(4L * i + {k} as id, {to} as to))")
    all_ = f"flatten(transform(filter(sequence(0, h * w - 1), i -> v[i] > {over}), i -> filter(array({', '.join(sides)}), e -> e is not null)))"
    return f"transform(array(v), v -> {all_})[0]"


def steps(images: DataFrame, over: int = 128) -> DataFrame:
    """Steps with the one before each: image_id, w, id, to."""
    return images.where("v is not null and h > 0 and w > 0").select("image_id", "w", F.expr(f"inline({_steps(over)})"))


def _doubled(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pointers that form rings: the least place of each one's ring, and the pointers from it to there, as links.ranked."""
    lead, hops, seen, moved = np.arange(len(to)), np.zeros(len(to), np.int64), 1, True
    while moved:
        far = lead[to]
        better, moved = far < lead, (far < lead).any()
        hops = np.where(better, hops[to] + seen, hops)
        lead, to, seen = np.minimum(lead, far), to[to], 2 * seen
    return lead, hops


def _rings(images: DataFrame, over: int) -> DataFrame:
    """image_id, h, w, rings: the outlines of each raster by their least ids, as arrays of ring and line; a line has place and id of its steps in order."""
    kind = dict(images.dtypes)["image_id"]
    line = "array<struct<place: bigint, id: bigint, turns: boolean>>"

    def work(batches):
        for batch in batches:
            all_ = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(all_.value_lengths().to_numpy())])
            id_, to = (all_.flatten().field(k).to_numpy() for k in (0, 1))
            image = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            span = int(id_.max(initial=0)) + 1
            lead, hops = _doubled(np.searchsorted(image * span + id_, image * span + to))  # ids of an image are in order
            order = np.lexsort([hops, lead])
            first = np.flatnonzero(np.diff(lead[order], prepend=-1))
            steps_ = pa.StructArray.from_arrays([pa.array(hops[order]), pa.array(id_[order]), pa.array((id_ % 4 != to % 4)[order])], ["place", "id", "turns"])
            lines = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), steps_)
            each = pa.StructArray.from_arrays([pa.array(id_[lead[order][first]]), lines], ["ring", "line"])
            rings = pa.ListArray.from_arrays(pa.array(np.searchsorted(lead[order][first], ends), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rings], ["image_id", "h", "w", "rings"])

    some = F.expr(f"if(h > 0 and w > 0, {_steps(over)}, array())").alias("steps")
    return images.where("v is not null").select("image_id", "h", "w", some).mapInArrow(work, f"image_id {kind}, h int, w int, rings array<struct<ring: bigint, line: {line}>>")


def _corner(id_: str, at: int) -> str:
    """Row (0) or column (1) at which a step begins."""
    pixel = (f"({id_} div 4) div w", f"({id_} div 4) % w")[at]
    return f"cast({pixel} + element_at(array({', '.join(str(s[2][at]) for s in SIDES)}), cast({id_} % 4 as int) + 1) as int)"


def outlines(images: DataFrame, over: int = 128, corners: bool = True, within: int = K.WITHIN) -> DataFrame:
    """image_id, ring (the least id of the outline's steps), place (steps from it), x, y: points in order, all of them or those where the outline turns."""

    def small(d):
        each = _rings(d, over).select("image_id", "w", F.inline("rings")).select("image_id", "w", "ring", F.inline("line"))
        return drawn(each)

    def large(d):
        all_ = steps(d, over).withColumn("turns", F.expr("id % 4 != to % 4"))  # a step that goes on as the one before it does begins at no corner
        placed = ranked(all_.select(F.col("image_id").alias("group"), "id", "to"))
        return drawn(placed.join(all_.withColumnRenamed("image_id", "group"), ["group", "id"]).selectExpr("group as image_id", "w", "lead as ring", "hops as place", "id", "turns"))

    def drawn(each):
        return each.where("turns" if corners else "true").selectExpr("image_id", "ring", "place", f"{_corner('id', 1)} as x", f"{_corner('id', 0)} as y")

    return K.by_size(images, small, large, within)


def paths(points: DataFrame) -> DataFrame:
    """image_id, ring, n_points, path: an SVG path for each outline; holes come out by the even-odd rule."""
    line = F.expr("concat('M', array_join(transform(points, p -> concat(p.x, ' ', p.y)), 'L'), 'Z')")
    own = points.groupBy("image_id", "ring").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("points"))
    return own.select("image_id", "ring", F.size("points").alias("n_points"), line.alias("path"))


def svg(images: DataFrame, over: int = 128, within: int = K.WITHIN) -> DataFrame:
    """image_id, n_paths, svg: the outlines of each image that has a raster as one drawing."""
    text = F.expr("""concat('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ', w, ' ', h, '"><path fill-rule="evenodd" d="', coalesce(d, ''), '"/></svg>')""").alias("svg")

    def small(d):
        line = f"array_join(transform(filter(r.line, s -> s.turns), s -> concat({_corner('s.id', 1)}, ' ', {_corner('s.id', 0)})), 'L')"
        path = F.expr(f"array_join(transform(rings, r -> concat('M', {line}, 'Z')), '')")
        return _rings(d, over).withColumn("d", path).select("image_id", F.size("rings").alias("n_paths"), text)

    def large(d):
        drawn = paths(outlines(d, over, within=0)).groupBy("image_id").agg(F.count("*").alias("n_paths"), F.expr("array_join(transform(array_sort(collect_list(struct(ring, path))), p -> p.path), '')").alias("d"))
        frame = d.where("v is not null").select("image_id", "h", "w").join(drawn, "image_id", "left")
        return frame.select("image_id", F.coalesce("n_paths", F.lit(0)).cast("int").alias("n_paths"), text)

    return K.by_size(images, small, large, within)
