"""Quality of restored images against clean ones: PSNR and windowed SSIM, by image, by operator and over all.

Pixels of a pair are summed by window (counts, sums, squares and products, all whole numbers) before anything moves;
windows give their similarity in millionths, and one rollup adds up all levels of the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the similarity index for grey values up to 255: (0.01 * 255)^2 and (0.03 * 255)^2.
C1, C2 = 6.5025, 58.5225


def windows(clean: DataFrame, restored: dict[str, DataFrame], side: int = 8) -> DataFrame:
    """operator, image_id, wy, wx, n, error (sum of squared differences), similarity (millionths) of each window of side x side."""
    named = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("operator"), "image_id", F.col("h").alias("h2"), F.col("w").alias("w2"), F.col("v").alias("b")) for k, d in restored.items()])
    pairs = clean.select("image_id", "h", "w", F.col("v").alias("a")).join(named, "image_id").where("h = h2 and w = w2")
    p = pairs.select("operator", "image_id", "w", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    p = p.selectExpr("operator", "image_id", f"cast(i div w div {side} as int) as wy", f"cast(i % w div {side} as int) as wx", "cast(p.a as bigint) as a", "cast(p.b as bigint) as b").where("a is not null and b is not null")
    sums = p.groupBy("operator", "image_id", "wy", "wx").agg(F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.expr("a * a")).alias("saa"), F.sum(F.expr("b * b")).alias("sbb"), F.sum(F.expr("a * b")).alias("sab"))
    mean = f"(2D * sa * sb + {C1}D * n * n) / (cast(sa * sa + sb * sb as double) + {C1}D * n * n)"
    spread = f"(2D * (n * sab - sa * sb) + {C2}D * n * n) / (cast(n * saa - sa * sa + n * sbb - sb * sb as double) + {C2}D * n * n)"
    return sums.select("operator", "image_id", "wy", "wx", "n", F.expr("saa + sbb - 2 * sab").alias("error"), F.expr(f"cast(floor(({mean}) * ({spread}) * 1000000D + 0.5D) as bigint)").alias("similarity"))


def quality_report(clean: DataFrame, restored: dict[str, DataFrame], side: int = 8) -> DataFrame:
    """level (0 image, 1 operator, 2 all), operator, image_id, n, error, psnr (null where nothing differs), ssim (mean over windows)."""
    sums = windows(clean, restored, side).rollup("operator", "image_id").agg(F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("error").alias("error"), F.sum("similarity").alias("s"), F.count("*").alias("k"))
    psnr = F.expr("if(error = 0, null, round(10D * log10(65025D * n / error), 4))")
    return sums.select(F.expr("cast(case g when 0 then 0 when 1 then 1 else 2 end as int)").alias("level"), "operator", "image_id", "n", "error", psnr.alias("psnr"), F.expr("floor(s / k + 0.5D) / 1000000D").alias("ssim"))
