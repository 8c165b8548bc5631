"""A mark that many images share: its opacity and colour at each place, and images without it.

A marked value is (1 - opacity) times the value beneath plus opacity times the mark's colour. Both numbers of a place
follow from sums over the images of one size, grouped by place before anything else moves: by least squares where the
values beneath are known for some images, or else from how much the values of a place vary against those of most places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumagrid.operators.images import to_pixels_sized

#: Opacity below which a place counts as unmarked, and over which nothing of the value beneath is left.
LEAST, MOST = 0.04, 0.96


def _matte(sums: DataFrame, slope, base) -> DataFrame:
    """h, w, i, opacity, colour from the slope and base of marked over unmarked values."""
    told = sums.withColumn("slope", slope).withColumn("base", base)
    opacity = F.expr(f"case when slope is null or 1D - slope < {LEAST}D then 0D when 1D - slope > 1D then 1D else 1D - slope end")
    return told.withColumn("opacity", opacity).select("h", "w", "i", "opacity", F.expr("if(opacity = 0D, 0D, greatest(0D, least(255D, base / opacity)))").alias("colour"))


def matte_of_pairs(marked: DataFrame, clean: DataFrame) -> DataFrame:
    """h, w, i, opacity, colour of each place, by least squares over images that are there with and without the mark."""
    pairs = to_pixels_sized(marked).join(to_pixels_sized(clean).withColumnRenamed("v", "p"), ["image_id", "h", "w", "i"])
    v, p = F.col("v").cast("long"), F.col("p").cast("long")
    sums = pairs.groupBy("h", "w", "i").agg(F.count("*").alias("n"), F.sum(v).alias("sv"), F.sum(p).alias("sp"), F.sum(p * p).alias("spp"), F.sum(p * v).alias("spv"))
    slope = F.expr("if(n * spp - sp * sp = 0, null, cast(n * spv - sp * sv as double) / cast(n * spp - sp * sp as double))")
    return _matte(sums, slope, F.expr("(cast(sv as double) - slope * cast(sp as double)) / n"))


def matte(images: DataFrame) -> DataFrame:
    """h, w, i, opacity, colour of each place, where most places are unmarked and all vary alike beneath the mark.

    The unmarked spread and mean are the lower medians over the places of one size. A mark shrinks the spread by
    1 - opacity, so it is found where it lets something through and the images are many.
    """
    v = F.col("v").cast("long")
    sums = to_pixels_sized(images).groupBy("h", "w", "i").agg(F.count("*").alias("n"), F.sum(v).alias("sv"), F.sum(v * v).alias("svv")).withColumn("spread", F.expr("n * svv - sv * sv"))
    ranked = [F.row_number().over(W.partitionBy("h", "w").orderBy(c, "i")).alias(f"{c}_at") for c in ("spread", "sv")]
    middle = lambda c: F.max(F.when(F.col(f"{c}_at") == F.floor((F.col("h") * F.col("w") + 1) / 2), F.col(c))).alias(f"{c}_mid")
    usual = sums.select("h", "w", "spread", "sv", *ranked).groupBy("h", "w").agg(middle("spread"), middle("sv"))
    slope = F.expr("if(spread_mid = 0, null, sqrt(cast(spread as double) / cast(spread_mid as double)))")
    return _matte(sums.join(usual, ["h", "w"]), slope, F.expr("(cast(sv as double) - slope * cast(sv_mid as double)) / n"))


def unmarked(images: DataFrame, mark: DataFrame) -> DataFrame:
    """Rasters with the mark taken out; where it lets nothing through, values stay. The mark is one row for each size, of one image's length."""
    own = mark.groupBy("h", "w").agg(F.array_sort(F.collect_list(F.struct("i", "opacity", "colour"))).alias("mark"))
    value = f"if(m.opacity = 0D or m.opacity > {MOST}D, p, cast(greatest(0D, least(255D, floor((p - m.opacity * m.colour) / (1D - m.opacity) + 0.5D))) as int))"
    joined = images.join(own, ["h", "w"], "left").withColumn("v", F.expr(f"if(mark is null, v, zip_with(v, mark, (p, m) -> {value}))"))
    return joined.select(*images.columns)
