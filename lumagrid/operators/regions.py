"""Connected regions of rasters of any size: tiles are labelled in their own tasks, and labels that meet at borders are joined.

A tile's runs of pixels are linked where they touch, within the task; its labels are places in the image, so they need
no numbering. Tiles overlap by the first row and column of the next ones: a pixel there has a label from each of its
tiles, and these labels are one. Only labels that meet another take part in the contraction that follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.operators import tiles as tl
from lumagrid.operators.links import contracted
from lumagrid.sources.scratch import Rounds


def linked_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place of each horizontal run of a mask, and the number of the first run that 4-connected steps reach from it."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    turn = np.diff(padded, axis=1)
    (y, a), (_, b) = np.nonzero(turn == 1), np.nonzero(turn == -1)
    first, last = y * w + a, y * w + b - 1
    below, until = np.searchsorted(last, first + w), np.searchsorted(first, last + w, "right")
    n = np.maximum(until - below, 0)
    up = np.repeat(np.arange(len(first)), n)
    down = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(below, n)
    root = np.arange(len(first))
    while True:  # hook the later root under the earlier one, then shorten all paths
        x, z = root[up], root[down]
        apart = x != z
        if not apart.any():
            return first, last, root
        np.minimum.at(root, np.maximum(x, z)[apart], np.minimum(x, z)[apart])
        while (root[root] != root).any():
            root = root[root]


def tile_runs(tiles: DataFrame, over: int = 128) -> DataFrame:
    """Runs over a value in each tile, halo included: image_id, y, x0, x1, label (place in the image of the first pixel of its part), and the tile's own bounds."""
    kind = dict(tiles.dtypes)["image_id"]
    names = ["y", "x0", "x1", "label", "last_y", "last_x", "first_y", "first_x"]
    columns = ["image_id", "y0", "x0", "top", "left", "own_h", "own_w", "image_w", "h", "w", "v"]

    def work(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                y0, x0, top, left, own_h, own_w, image_w, h, w = (batch.column(k)[r].as_py() for k in range(1, 10))
                v = batch.column(10)[r].values.to_numpy(zero_copy_only=False).reshape(h, w)
                first, last, root = linked_runs(np.nan_to_num(v.astype(float), nan=-1) > over)
                y, a, b = first // w + y0 - top, first % w + x0 - left, last % w + x0 - left
                label = y.astype(np.int64) * image_w + a
                bounds = [np.full(len(first), n) for n in (y0 + own_h - 1, x0 + own_w - 1, y0, x0)]
                arrays = [pa.array(c, t) for c, t in zip((y, a, b, label[root], *bounds), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(first), r))), *arrays], ["image_id", *names])

    return tiles.select(*columns).mapInArrow(work, f"image_id {kind}, y int, x0 int, x1 int, label long, last_y int, last_x int, first_y int, first_x int")


def border_links(runs: DataFrame) -> DataFrame:
    """Labels of different tiles that share a pixel: group (the image), a, b."""
    rows = runs.where("y = first_y or y > last_y").selectExpr("image_id", "y", "explode(sequence(x0, x1)) as x", "label")
    side = lambda at: runs.where(f"not (y = first_y or y > last_y) and {at} between x0 and x1").selectExpr("image_id", "y", f"{at} as x", "label")
    met = rows.unionByName(side("first_x")).unionByName(side("last_x + 1")).groupBy("image_id", "y", "x").agg(F.min("label").alias("b"), F.collect_set("label").alias("all"))
    return met.where("size(all) > 1").select(F.col("image_id").alias("group"), F.explode("all").alias("a"), "b").where("a != b").distinct()


def region_runs(tiles: DataFrame, over: int = 128) -> DataFrame:
    """tiles, cut with one row and column of halo after them and none before: image_id, y, x0, x1, label of each run within a tile.

    The label is the place (y times the image's width, plus x) of the region's first pixel. A run that crosses tiles comes
    in one piece for each.
    """
    rounds = Rounds(tiles.sparkSession)
    runs = rounds.written(tile_runs(tiles, over))
    roots = contracted(border_links(runs)).select(F.col("group").alias("image_id"), F.col("id").alias("label"), "root")
    inner = runs.where("y <= last_y and x0 <= last_x").select("image_id", "y", "x0", F.least("x1", "last_x").alias("x1"), "label")
    return inner.join(roots, ["image_id", "label"], "left").select("image_id", "y", "x0", "x1", F.coalesce("root", "label").alias("label"))


def region_boxes(runs: DataFrame) -> DataFrame:
    """image_id, label, x0, y0, x1, y1, area of each region, from its runs."""
    box = [F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")]
    return runs.groupBy("image_id", "label").agg(*box, F.sum(F.expr("cast(x1 - x0 + 1 as bigint)")).alias("area"))


def labelled_regions(images: DataFrame, over: int = 128, size: int = 256) -> DataFrame:
    """Regions of packed rasters, by tiles: the runs of region_runs."""
    return region_runs(tl.cut(images, size, 0, 1), over)
