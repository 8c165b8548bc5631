"""Relational image operators: each takes packed rasters (image_id, h, w, v) and gives a DataFrame.

Per-image work is an expression within the row. Only what ranges over many images, or over a histogram, is grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumagrid.functions import raster as R
from lumagrid.sources.images import to_pixels


def kernel(images: DataFrame, expression: str, **before: str) -> DataFrame:
    """Packed rasters with v replaced by the expression; before names earlier steps (their names end in _), each computed once for a row."""
    for name, step in before.items():
        expression = f"transform(array({step}), {name} -> {expression})[0]"
    return images.withColumn("v", once(expression))


def once(expression: str, name: str = "v"):
    """The expression with the raster bound first: otherwise the optimiser may compute it anew at each access."""
    return F.expr(f"transform(array({name}), {name} -> {expression})[0]")


def box3(images):
    return kernel(images, R.BOX3)


def box3_sum(images):
    return kernel(images, R.BOX3_SUM)


def integral(images):
    return kernel(images, R.INTEGRAL, r_=R.ROWS_SUMMED)


def median3(images):
    return kernel(images, R.MEDIAN3)


def opened_rows(images):
    """Row-wise erosion, then dilation, by three pixels."""
    return kernel(images, R.DILATED, e_=R.ERODED)


def unsharp(images):
    return kernel(images, R.UNSHARP, b_=R.BOX3)


def gamma_sqrt(images):
    return kernel(images, R.GAMMA_SQRT)


def stretch(images):
    return kernel(images, R.STRETCH, m_=R.ENDS)


def equalise(images):
    return kernel(images, R.HIST_EQ, u_=R.UP_TO, h_=R.histogram())


def downsample2(images):
    return kernel(images, R.DOWNSAMPLE2).withColumns({"h": F.expr("cast(h div 2 as int)"), "w": F.expr("cast(w div 2 as int)")})


def rotate90(images):
    """Clockwise: (y, x) goes to (x, h - 1 - y)."""
    return kernel(images, R.ROT90).withColumns({"h": F.col("w"), "w": F.col("h")})


def classes(images, centres: tuple[int, ...] = (64, 128, 192)):
    return kernel(images, R.nearest(centres))


def sharpness(images: DataFrame) -> DataFrame:
    """n sum(l^2) - sum(l)^2 of the Laplacian over inner pixels: low where an image is blurred."""
    total = "aggregate(l, 0L, (s, p) -> s + p{})"
    of = f"size(l) * {total.format(' * p')} - {total.format('')} * {total.format('')}"
    return images.select("image_id", once(f"transform(array({R.LAPLACIAN}), l -> {of})[0]").alias("sharpness"))


def moments(images: DataFrame) -> DataFrame:
    return images.select("image_id", *(once(R.moment(p, q)).alias(f"m{p}{q}") for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))))


def otsu(images: DataFrame) -> DataFrame:
    """The least grey value that maximises the variance between the pixels up to it and those over it.

    Pixels are counted by image and value before anything is shuffled, so at most 256 rows of an image move.
    """
    counts = images.select("image_id", F.explode("v").alias("v")).groupBy("image_id", "v").agg(F.count("*").alias("c"))
    up = W.partitionBy("image_id").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("image_id")
    s = F.col("c") * F.col("v")
    sums = counts.select("image_id", "v", F.sum("c").over(up).alias("w0"), F.sum(s).over(up).alias("s0"), F.sum("c").over(whole).alias("n"), F.sum(s).over(whole).alias("s"))
    d = F.col("s").cast("double") * F.col("w0") - F.col("n").cast("double") * F.col("s0")
    between = F.when(F.col("w0") < F.col("n"), d * d / (F.col("w0").cast("double") * (F.col("n") - F.col("w0")))).otherwise(F.lit(0.0))
    return sums.groupBy("image_id").agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def runs(images: DataFrame, over: int = 128) -> DataFrame:
    """Maximal horizontal runs over a value: image_id, y, x0, x1."""
    pairs = F.explode(F.arrays_zip(once(R.RUN_STARTS.format(t=over)).alias("a"), once(R.RUN_ENDS.format(t=over)).alias("b")))
    out = images.select("image_id", "w", pairs.alias("r"))
    return out.select("image_id", F.expr("cast(r.a div w as int)").alias("y"), F.expr("cast(r.a % w as int)").alias("x0"), F.expr("cast(r.b % w as int)").alias("x1"))


def edges(images: DataFrame, over: int = 128) -> DataFrame:
    """Sides of pixels over a value that face a lower pixel or the border: image_id, y, x, dir."""
    return images.select("image_id", F.explode(once(R.EDGES.format(t=over))).alias("e")).select("image_id", "e.y", "e.x", "e.dir")


def hough(images: DataFrame, over: int = 200) -> DataFrame:
    """Votes for lines: image_id, theta, rho, votes; integer cosines keep rho exact."""
    table = F.expr("array(" + ", ".join(f"struct({t} as theta, {c} as c, {s} as s)" for t, c, s in R.HOUGH) + ")")
    p = to_pixels(images).where(F.col("v") > over).withColumn("t", F.explode(table))
    return p.groupBy("image_id", F.col("t.theta").alias("theta"), F.expr("cast(floor((x * t.c + y * t.s) / 1000D) as int)").alias("rho")).agg(F.count("*").alias("votes"))


def row_projection(images: DataFrame, over: int = 128) -> DataFrame:
    """Pixels over a value in each row: image_id, y, n."""
    count = once(f"transform(sequence(0, h - 1), y -> cast(size(filter(slice(v, y * w + 1, w), p -> p > {over})) as bigint))")
    return images.select("image_id", F.posexplode(count).alias("y", "n"))


def watermark(images: DataFrame) -> DataFrame:
    """What all images of one size share: the median at each place, from counts by place and value (at most 256 a place)."""
    counts = to_pixels_sized(images).groupBy("h", "w", "i", "v").agg(F.count("*").alias("c"))
    at = W.partitionBy("h", "w", "i")
    up = at.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.select("h", "w", "i", "v", F.sum("c").over(up).alias("hi"), F.sum("c").over(at).alias("n")).withColumn("lo", F.coalesce(F.lag("hi").over(at.orderBy("v")), F.lit(0)))
    low, high = (F.floor((F.col("n") + k) / 2) for k in (1, 2))
    middle = lambda k: F.max(F.when((F.col("lo") < k) & (F.col("hi") >= k), F.col("v")))
    return ranked.groupBy("h", "w", "i").agg(((middle(low) + middle(high)) / 2).alias("median"))


def to_pixels_sized(images: DataFrame) -> DataFrame:
    return images.select("image_id", "h", "w", F.posexplode("v").alias("i", "v"))


def without_watermark(images: DataFrame) -> DataFrame:
    """v less the floor of the shared median. The mark has one row for each image size, of one image's length."""
    mark = watermark(images).groupBy("h", "w").agg(F.array_sort(F.collect_list(F.struct("i", F.floor("median").cast("int").alias("m")))).alias("mark"))
    joined = images.join(mark, ["h", "w"])
    return joined.select("image_id", "h", "w", F.expr("zip_with(v, mark, (p, m) -> p - m.m)").alias("v"))


def nearest_image(queries: DataFrame, images: DataFrame, block: int = 4096, chunk: int = 65_536) -> DataFrame:
    """The nearest other image to each query, by squared distance; ties go to the lower id: image_id, match_id, distance.

    A stated query set against all rows, in blocks: queries are dealt to blocks and images to chunks; every pair of a
    block and a chunk is one group of bounded size, which gives back one best per query.
    """
    blocks, parts = 1 + queries.count() // block, 1 + images.count() // chunk
    at = lambda n: F.pmod(F.xxhash64("image_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("image_id", "v", at(blocks).alias("block"), every(parts).alias("part"))
    given = images.select("image_id", "v", every(blocks).alias("block"), at(parts).alias("part"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left["image_id"].to_numpy(), right["image_id"].to_numpy()
        q, x = (np.array(t["v"].to_pylist(), np.int64).reshape(t.num_rows, -1) for t in (left, right))
        best, whom = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
        for k in range(0, len(own), 1024):
            order = np.argsort(own[k : k + 1024], kind="stable")
            o, y = own[k : k + 1024][order], x[k : k + 1024][order]
            d = (q * q).sum(1)[:, None] - 2 * (q.astype(float) @ y.T.astype(float)).astype(np.int64) + (y * y).sum(1)[None, :] if len(ids) else np.zeros((0, len(o)), np.int64)
            d[ids[:, None] == o[None, :]] = np.iinfo(np.int64).max
            pick = d.argmin(1)
            dist = d[np.arange(len(ids)), pick]
            better = (dist < best) | (dist == best) & (o[pick] < whom)
            best, whom = np.where(better, dist, best), np.where(better, o[pick], whom)
        seen = best < np.iinfo(np.int64).max
        return pa.table({"image_id": ids[seen], "match_id": whom[seen], "distance": best[seen]})

    found = asked.groupBy("block", "part").cogroup(given.groupBy("block", "part")).applyInArrow(work, "image_id long, match_id long, distance long")
    return found.groupBy("image_id").agg(F.min(F.struct("distance", "match_id")).alias("m")).select("image_id", "m.match_id", "m.distance")


#: Letters that tell the languages of a line apart.
LETTERS = {"de": "äöüß", "es": "ñáíóú¿¡", "fr": "èêçàùâîôûëï"}


def language_letters(lines: DataFrame, text: str = "text", languages: dict[str, str] = LETTERS) -> DataFrame:
    """lines with the count of each language's letters and the language with most of them (en if there are none)."""
    low = F.lower(F.col(text))
    counts = {f"n_{k}": (F.length(low) - F.length(F.translate(low, v, ""))).cast("long") for k, v in languages.items()}
    out = lines.withColumns(counts)
    best = F.greatest(*(F.col(c) for c in counts))
    tag = F.when(best > 0, F.coalesce(*(F.when(F.col(f"n_{k}") == best, F.lit(k)) for k in languages))).otherwise(F.lit("en"))
    return out.withColumn("lang_tag", tag)


def character_errors(pairs: DataFrame, *keep: str, truth: str = "truth", read: str = "read") -> DataFrame:
    """Edits and characters of each pair."""
    return pairs.select(*keep, F.levenshtein(truth, read).cast("long").alias("edits"), F.length(truth).cast("long").alias("characters"))


def character_error_rate(pairs: DataFrame, truth: str = "truth", read: str = "read") -> DataFrame:
    """Edits and characters over all pairs, and their quotient."""
    total = character_errors(pairs, truth=truth, read=read).agg(F.sum("edits").alias("edits"), F.sum("characters").alias("characters"))
    return total.withColumn("rate", F.col("edits") / F.col("characters"))
