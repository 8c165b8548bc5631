"""Results of reading images as nested rows and as JSON lines, and regions as a table function for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Blocks of lines with their boxes and, where they were read, their text.
LAYOUT = "struct<blocks: array<struct<block: bigint, lines: array<struct<line: int, x0: int, y0: int, x1: int, y1: int, text: string>>>>>"


def layout(lines: DataFrame) -> DataFrame:
    """lines (image_id, block, line, x0, y0, x1, y1 and, if there is one, text): image_id, layout; a row for each image."""
    text = F.col("text") if "text" in lines.columns else F.lit(None).cast("string").alias("text")
    own = lines.groupBy("image_id", "block").agg(F.array_sort(F.collect_list(F.struct("line", "x0", "y0", "x1", "y1", text))).alias("lines"))
    return own.groupBy("image_id").agg(F.struct(F.array_sort(F.collect_list(F.struct("block", "lines"))).alias("blocks")).cast(LAYOUT).alias("layout"))


def as_json(layouts: DataFrame) -> DataFrame:
    return layouts.select("image_id", F.to_json("layout").alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """Layouts again; a text that is not one gives null."""
    return texts.select("image_id", F.from_json("json", LAYOUT, {"mode": "PERMISSIVE"}).alias("layout"))


def lines_of(layouts: DataFrame) -> DataFrame:
    """image_id, block, line, x0, y0, x1, y1, text: a row for each line."""
    return layouts.select("image_id", F.explode("layout.blocks").alias("b")).select("image_id", "b.block", F.explode("b.lines").alias("l")).select("image_id", "block", "l.*")


def register_functions(spark: SparkSession) -> None:
    """Makes image_regions known to SQL: select * from image_regions(table(pixels) partition by (image_id), 128)."""
    spark.udtf.register("image_regions", ImageRegions)


@udtf(returnType="image_id bigint, label bigint, x0 int, y0 int, x1 int, y1 int, area bigint")
class ImageRegions:
    """Connected regions over a value of the pixels (image_id, y, x, v) of each partition, which is one image that a task can hold; larger ones go through tiles.

    Labels are places in the raster that the pixels span from (0, 0) on. Rows without a value or place are left out.
    """

    def __init__(self):
        self.image, self.over, self.pixels = None, 128, []

    def eval(self, row, over: int = 128):
        self.image, self.over = row["image_id"], over
        if row["v"] is not None and row["y"] is not None and row["x"] is not None:
            self.pixels.append((row["y"], row["x"], row["v"]))

    def terminate(self):
        if not self.pixels:
            return
        from lumagrid.operators.regions import linked_runs

        y, x, v = np.array(self.pixels).T
        mask = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        mask[y.astype(int), x.astype(int)] = v > self.over
        w = mask.shape[1]
        first, last, root = linked_runs(mask)
        for r in np.unique(root).tolist():
            own = root == r
            a, b = first[own], last[own]
            yield self.image, int(first[r]), int((a % w).min()), int((a // w).min()), int((b % w).max()), int((a // w).max()), int((b - a + 1).sum())
