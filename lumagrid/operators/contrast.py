"""Contrast-limited adaptive equalisation: clipped cumulative tables of tiles, interpolated between the tiles' middles.

Pixels are counted by image, tile and value before anything moves, so an image sends at most 256 rows a tile. A tile's
table tells for each value how many pixels are at or below it, with counts over a limit cut and spread evenly over all
values. All numbers are whole, so results do not depend on the order of sums. The tables of an image come back to its
row as one array, and every pixel looks up the four tiles around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a grey value in tables.
PARTS = 4096


def _tile(tiles: int) -> str:
    """The tile of pixel i; tiles are equal but for the last ones."""
    return f"((i div w) div ((h + {tiles - 1}) div {tiles})) * {tiles} + (i % w) div ((w + {tiles - 1}) div {tiles})"


def tables(images: DataFrame, tiles: int = 2, limit: float = 2.0) -> DataFrame:
    """image_id, m: for each tile in order and each value from 0 to 255 what it becomes, in parts of a grey value."""
    some = images.where("v is not null and h > 0 and w > 0")
    pixels = some.select("image_id", "h", "w", F.posexplode("v").alias("i", "p")).where("p is not null").selectExpr("image_id", f"cast({_tile(tiles)} as int) as tile", "greatest(0, least(255, cast(p as int))) as p", "1L as c")
    bottom = some.selectExpr("image_id", f"explode(sequence(0, {tiles * tiles - 1})) as tile", "0 as p", "0L as c")
    counts = pixels.unionByName(bottom).groupBy("image_id", "tile", "p").agg(F.sum("c").alias("c"))
    tile = W.partitionBy("image_id", "tile")
    up = tile.orderBy("p")
    counts = counts.withColumn("n", F.sum("c").over(tile)).withColumn("own", F.expr(f"least(c, greatest(1L, cast(floor({float(limit)}D * n / 256) as long)))"))
    steps = counts.select("image_id", "tile", "p", "n", (F.col("n") - F.sum("own").over(tile)).alias("spare"), F.sum("own").over(up.rowsBetween(W.unboundedPreceding, 0)).alias("below"), (F.coalesce(F.lead("p").over(up), F.lit(256)) - 1).alias("last"))
    dense = steps.selectExpr("image_id", "tile", "n", "spare", "below", "explode(sequence(p, last)) as p")
    value = F.expr(f"cast((below * 256 + (p + 1) * spare) * 255 * {PARTS} div (256 * greatest(1L, n)) as int)")
    own = dense.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("tile", "p", value.alias("m")))).alias("all_"))
    return own.select("image_id", F.expr("transform(all_, e -> e.m)").alias("m"))


def adapted(images: DataFrame, tiles: int = 2, limit: float = 2.0) -> DataFrame:
    """Rasters whose values are changed by the tables of the tiles around them."""
    length = lambda side: f"(({side} + {tiles - 1}) div {tiles})"
    last = lambda side: f"cast(({side} - 1) div {length(side)} as int)"
    # a pixel's distance from the middle of the first tile in half pixels; two lengths of a tile are the whole way to the next one
    reach = lambda at, side: f"greatest(0, 2 * ({at}) - {length(side)} + 1)"
    low = lambda at, side: f"cast(least({last(side)}, {reach(at, side)} div (2 * {length(side)})) as int)"
    part = lambda at, side: f"cast(if({low(at, side)} >= {last(side)}, 0, {reach(at, side)} % (2 * {length(side)})) as long)"
    spots = f"transform(sequence(0, h * w - 1), i -> struct({low('i div w', 'h')} as ty, {part('i div w', 'h')} as fy, {low('i % w', 'w')} as tx, {part('i % w', 'w')} as fx, if(s.v[i] is null, null, greatest(0, least(255, cast(s.v[i] as int)))) as p))"
    look = lambda dy, dx: f"s.m[(least({tiles - 1}, q.ty + {dy}) * {tiles} + least({tiles - 1}, q.tx + {dx})) * 256 + q.p]"  # noqa: E731  a tile beyond the last one has no part
    row = lambda dy: f"({look(dy, 0)} * (s.x - q.fx) + {look(dy, 1)} * q.fx)"
    total = f"({row(0)} * (s.y - q.fy) + {row(1)} * q.fy)"
    value = f"cast((2 * {total} + s.y * s.x * {PARTS}) div (2 * s.y * s.x * {PARTS}) as int)"
    bound = f"struct(v, m, cast(2 * {length('h')} as long) as y, cast(2 * {length('w')} as long) as x)"
    joined = images.join(tables(images, tiles, limit), "image_id", "left")
    return joined.withColumn("v", F.expr(f"if(m is null, v, transform(array({bound}), s -> transform({spots}, q -> {value}))[0])")).select(*images.columns)
