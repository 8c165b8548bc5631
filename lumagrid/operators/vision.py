"""The eleven image capabilities over DataFrames of packed rasters.

Stains, regions, layout, outlines, straightening and segments are expressions, joins and groupings; Fourier filters and
labels are small numpy kernels (lumagrid.operators.kernels) in Arrow batches. Rows without a raster are left out by the latter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumagrid.functions import raster as R
from lumagrid.operators import images as I
from lumagrid.operators import kernels as K
from lumagrid.operators import contrast, lines, outlines, segments, watermarks
from lumagrid.operators.kernels import map_images, map_rasters
from lumagrid.sources.images import to_pixels

RASTER = "h int, w int, v array<int>"


def _raster(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "v": a}


def _otsu(a: np.ndarray) -> int:
    n = np.bincount(K.to_bytes(a).ravel(), minlength=256)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    d, room = (s0[-1] * w0 - w0[-1] * s0).astype(float), (w0 * (w0[-1] - w0)).astype(float)
    return int(np.argmax(np.where(room > 0, d * d / np.maximum(room, 1), 0)))


def vectorise(images: DataFrame, over: int = 128, tolerance: float = 0.0) -> DataFrame:
    """1-1: outlines of the ink as SVG: image_id, n_paths, svg. With a tolerance, lines are simplified image by image."""
    if not tolerance:
        return outlines.svg(images, over)
    return map_images(images, lambda a: {"n_paths": len(K.outlines(a > over)), "svg": K.svg(a > over, tolerance)}, "n_paths int, svg string")


def _ink(images: DataFrame, over: int | None) -> DataFrame:
    """Rasters of 1 where a pixel is over the threshold, Otsu's of each image if none is given, and 0 elsewhere; only images that have a raster."""
    limit = str(over) if over is not None else f"transform(array({R.histogram()}), h_ -> {R.otsu()})[0]"
    return images.where("h is not null and w is not null and v is not null").select("image_id", "h", "w", I.once(f"transform(array({limit}), t_ -> transform(v, p -> cast(p > t_ as int)))[0]").alias("v"))


def detect_text(images: DataFrame, over: int | None = None) -> DataFrame:
    """1-2: boxes of lines of text, bands of rows with ink (over the threshold; Otsu's if none is given): image_id, x0, y0, x1, y1."""
    ink = to_pixels(_ink(images, over)).where("v = 1")
    rows = ink.groupBy("image_id", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    band = F.col("y") - F.row_number().over(W.partitionBy("image_id").orderBy("y"))
    boxes = rows.withColumn("band", band).groupBy("image_id", "band").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))
    return boxes.drop("band")


def recognise_text(images: DataFrame, templates: dict[str, np.ndarray], over: int = 128) -> DataFrame:
    """1-2 for rendered text: every line read by template matching. Handwriting (1-3) needs a model: see models.run_model."""

    def read(a):
        out = []
        for x0, y0, x1, y1 in K.text_lines(a > over):
            text, score = K.read_line(a[y0 : y1 + 1, x0 : x1 + 1] > over, templates)
            out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "score": score})
        return out

    return map_images(images, read, "x0 int, y0 int, x1 int, y1 int, text string, score double")


def remove_stains(images: DataFrame, radius: int = 2) -> DataFrame:
    """2-1: the bright background (closing by a square, then a mean) is divided out."""
    return I.kernel(images, R.brightened(), p_=R.paper(radius), c_=R.window("least", radius, "m_"), m_=R.window("greatest", radius))


def deblur(images: DataFrame, psf: np.ndarray, method: str = "wiener", noise: float = 0.01, steps: int = 20) -> DataFrame:
    """2-2, for a known point spread: wiener or richardson_lucy."""
    return map_rasters(images, lambda a: K.wiener(a, psf, noise) if method == "wiener" else K.richardson_lucy(a, psf, steps))


def remove_screen_pattern(images: DataFrame, factor: float = 6.0) -> DataFrame:
    """3-1."""
    return map_images(images, lambda a: _raster(K.demoire(a, factor)), RASTER)


def notch(images: DataFrame, fy: int = 0, fx: int = 1) -> DataFrame:
    """3-1, for a known frequency."""
    return I.kernel(images, R.notched(fy, fx))


def fill_in(images: DataFrame, over: int = 240) -> DataFrame:
    """3-2 on one image: pixels over a value are taken as the mark and filled from around."""
    return map_rasters(images, lambda a: K.inpaint(a, a > over))


def components(images: DataFrame, over: int = 128) -> DataFrame:
    """4-1: image_id, y, x, label of each pixel over a value; a label is the first place of its 4-connected component."""

    def rows(a):
        label = K.components(a > over)
        return [{"y": int(y), "x": int(x), "label": int(label[y, x])} for y, x in zip(*np.nonzero(label >= 0))]

    return map_images(images, rows, "y int, x int, label int")


def regions(images: DataFrame, over: int = 128) -> DataFrame:
    """4-1: image_id, label, x0, y0, x1, y1, area of each component."""
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    return components(images, over).groupBy("image_id", "label").agg(*box, F.count("*").alias("area"))


def text_blocks(boxes: DataFrame, gap: int = 2) -> DataFrame:
    """1-1: layout: lines (image_id, x0, y0, x1, y1) in reading order, and blocks of lines that lie at most gap rows apart: with block and line."""
    down = W.partitionBy("image_id").orderBy("y0", "x0")
    reach = F.max("y1").over(down.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("y0") - reach > gap).cast("int"), F.lit(0))
    return boxes.withColumn("block", F.sum(new).over(down)).withColumn("line", F.row_number().over(W.partitionBy("image_id", "block").orderBy("y0", "x0")))


def rectify(images: DataFrame, over: int | None = None) -> DataFrame:
    """4-2: the page (over Otsu's threshold, or a given one) straightened; images without four borders stay as they are."""
    return lines.warped(images, lines.homographies(lines.page_corners(_ink(images, over), 0)))


def segment(images: DataFrame, k: int = 3, steps: int = 12) -> DataFrame:
    """5-1: classes of grey values by k-means over each image's histogram, 0 the darkest."""
    return I.kernel(images, R.classed(k), c_=R.lloyd(k, steps), h_=R.histogram())


def enhance(images: DataFrame, tiles: int = 2, limit: float = 2.0) -> DataFrame:
    """5-2: contrast-limited adaptive equalisation."""
    return contrast.adapted(images, tiles, limit)


def segment_regions(images: DataFrame, scale: float = 100.0) -> DataFrame:
    """5-1: connected regions whose outer differences stand out: image_id, y, x, label."""
    return segments.graph_segments(images, scale)


def remove_watermark(images: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """3-2 over many images: the mark's opacity and colour are found at each place (from pairs, where clean ones are given) and taken out."""
    return watermarks.unmarked(images, watermarks.matte(images) if clean is None else watermarks.matte_of_pairs(images, clean))
