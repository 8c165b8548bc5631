"""Large rasters as tiles in rows, each with a halo of its neighbours' pixels, so that no row holds a whole image.

A tile has image_id, ty and tx (its place among tiles), y0 and x0 (of its own first pixel), top and left (rows and
columns of halo before it), own_h and own_w (its own size), image_w, and h, w, v with the halo. There is no halo beyond
the image's border, so that operators which repeat the border do so where the image ends and nowhere else. Operators of
packed rasters work on tiles as they are; `own` cuts the halo off again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.operators.images import once

PLACE = ["ty", "tx", "y0", "x0", "top", "left", "own_h", "own_w", "image_w"]


def cut(images: DataFrame, size: int = 256, before: int = 1, after: int = 1) -> DataFrame:
    """Packed rasters (image_id, h, w, v) as tiles of size x size with so many rows and columns of halo; rows without a raster give none."""
    bare = images.where("v is not null and h > 0 and w > 0").select("image_id", F.col("h").alias("H"), F.col("w").alias("W"), F.col("v").alias("V"))
    at = bare.select("*", F.expr(f"explode(sequence(0, (H - 1) div {size}))").alias("ty")).select("*", F.expr(f"explode(sequence(0, (W - 1) div {size}))").alias("tx"))
    at = at.selectExpr("*", f"cast(ty * {size} as int) as y0", f"cast(tx * {size} as int) as x0")
    at = at.selectExpr("*", f"least({before}, y0) as top", f"least({before}, x0) as left", f"cast(least({size}, H - y0) as int) as own_h", f"cast(least({size}, W - x0) as int) as own_w")
    at = at.selectExpr("*", f"cast(least(H, y0 + own_h + {after}) - y0 + top as int) as h_", f"cast(least(W, x0 + own_w + {after}) - x0 + left as int) as w_")
    v = once("flatten(transform(sequence(y0 - top, y0 - top + h_ - 1), r -> slice(V, r * W + x0 - left + 1, w_)))", "V")
    return at.select("image_id", F.col("ty").cast("int"), F.col("tx").cast("int"), "y0", "x0", "top", "left", "own_h", "own_w", F.col("W").alias("image_w"), F.col("h_").alias("h"), F.col("w_").alias("w"), v.alias("v"))


def gather(pixels: DataFrame, sizes: DataFrame, size: int = 256, before: int = 1, after: int = 1, missing: int = 0) -> DataFrame:
    """A pixel table (image_id, y, x, v) as tiles: a pixel goes to its own tile and to those whose halo it is in.

    sizes (image_id, image_h, image_w) has a row for each image; a group is one tile, which is bounded. Places without a
    pixel get the value for missing ones; pixels outside the image are left out.
    """
    p = pixels.join(sizes, "image_id").where("y between 0 and image_h - 1 and x between 0 and image_w - 1")
    near = lambda c, most: f"explode(sequence(cast(greatest(0, {c} - {after}) div {size} as int), cast(least({most} - 1, {c} + {before}) div {size} as int)))"
    p = p.select("*", F.expr(near("y", "image_h")).alias("ty")).select("*", F.expr(near("x", "image_w")).alias("tx"))
    kind = dict(pixels.dtypes)["image_id"]

    def scatter(group: pa.Table) -> pa.Table:
        first = lambda c: group[c][0].as_py()
        ty, tx, high, wide = (first(c) for c in ("ty", "tx", "image_h", "image_w"))
        y0, x0 = ty * size, tx * size
        top, left, own_h, own_w = min(before, y0), min(before, x0), min(size, high - y0), min(size, wide - x0)
        h, w = min(high, y0 + own_h + after) - y0 + top, min(wide, x0 + own_w + after) - x0 + left
        v = np.full(h * w, missing, np.int32)
        v[(group["y"].to_numpy() - y0 + top) * w + group["x"].to_numpy() - x0 + left] = group["v"].to_numpy()
        numbers = dict(zip(PLACE, (ty, tx, y0, x0, top, left, own_h, own_w, wide))) | {"h": h, "w": w}
        return pa.table({"image_id": group["image_id"][:1]} | {k: pa.array([n], pa.int32()) for k, n in numbers.items()} | {"v": pa.array([v], pa.list_(pa.int32()))})

    schema = f"image_id {kind}, " + ", ".join(f"{c} int" for c in [*PLACE, "h", "w"]) + ", v array<int>"
    return p.groupBy("image_id", "ty", "tx").applyInArrow(scatter, schema)


def own(tiles: DataFrame) -> DataFrame:
    """Tiles without their halo."""
    v = once("flatten(transform(sequence(top, top + own_h - 1), r -> slice(v, r * w + left + 1, own_w)))")
    return tiles.withColumns({"v": v, "h": F.col("own_h"), "w": F.col("own_w"), "top": F.lit(0), "left": F.lit(0)})


def each_tile(images: DataFrame, operator: Callable[[DataFrame], DataFrame], size: int = 256, halo: int = 1) -> DataFrame:
    """An operator that keeps a raster's size and looks no further than the halo, applied to large rasters tile by tile."""
    return own(operator(cut(images, size, halo, halo)))


def to_pixels(tiles: DataFrame) -> DataFrame:
    """image_id, y, x, v of the tiles' own pixels, at their places in the image."""
    p = own(tiles).select("image_id", "y0", "x0", "w", F.posexplode("v").alias("i", "v"))
    return p.selectExpr("image_id", "cast(y0 + i div w as int) as y", "cast(x0 + i % w as int) as x", "v")


def stitched(tiles: DataFrame) -> DataFrame:
    """Packed rasters again, for images that one row may hold."""
    rows = own(tiles).select("image_id", "x0", "image_w", F.inline(once("transform(sequence(0, h - 1), r -> struct(y0 + r as y, slice(v, r * w + 1, w) as part))")))
    lines = rows.groupBy("image_id", "image_w", "y").agg(F.expr("flatten(transform(array_sort(collect_list(struct(x0, part))), p -> p.part))").alias("line"))
    whole = lines.groupBy("image_id", "image_w").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    return whole.select("image_id", F.size("lines").alias("h"), F.col("image_w").alias("w"), F.expr("flatten(transform(lines, p -> p.line))").alias("v"))
