"""Images as DataFrames: files, packed rasters, pixel tables, and a sink for PNG files.

Packed rasters (image_id, h, w, v array<int>) keep an image in one row, so that per-image work never shuffles; pixel
tables (image_id, y, x, v) are for statistics over many images.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, where the scan gives less than half as many tasks: a small file is one task otherwise, and kernels are work for each row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() < cores else rows


def vectors_as_images(vectors: DataFrame, side: int = 8, extra: tuple[str, ...] = ()) -> DataFrame:
    """Vectors of side * side components as images, v = clamp(floor((e + 0.5) * 256), 0, 255); other vectors are left out."""
    v = F.expr("transform(embedding, e -> cast(greatest(0, least(255, floor((cast(e as double) + 0.5D) * 256))) as int))")
    return vectors.where(F.size("embedding") == side * side).select(F.col("vec_id").alias("image_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), v.alias("v"), *extra)


def to_pixels(images: DataFrame, values: str = "v") -> DataFrame:
    return images.select("image_id", "w", F.posexplode(values).alias("i", "v")).select("image_id", F.expr("cast(i div w as int)").alias("y"), F.expr("cast(i % w as int)").alias("x"), "v")


def sheet(images: DataFrame, across: int) -> tuple[DataFrame, DataFrame]:
    """Rasters of one size laid out by their ids, so many in a row, as one image (id 0): its pixel table, and its size as a table of one row."""
    at = images.where("image_id >= 0").select("h", "w", "image_id", F.posexplode("v").alias("i", "v"))
    pixels = at.selectExpr("0L as image_id", f"cast((image_id div {across}) * h + i div w as int) as y", f"cast((image_id % {across}) * w + i % w as int) as x", "v")
    sizes = images.where("image_id >= 0").groupBy().agg(F.max("image_id").alias("last"), F.max("h").alias("h"), F.max("w").alias("w")).where("last is not null")
    return pixels, sizes.selectExpr("0L as image_id", f"cast((last div {across} + 1) * h as int) as image_h", f"cast({across} * w as int) as image_w")


def to_packed(pixels: DataFrame) -> DataFrame:
    """The inverse of to_pixels for whole images: one shuffle by image."""
    grouped = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return grouped.select("image_id", "h", "w", F.expr("transform(p, e -> e.v)").alias("v"))


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, height, width, channels, data (row-major BGR bytes) and error, which is set where a file cannot be decoded."""
    return described(spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(path))


def described(raw: DataFrame) -> DataFrame:
    """Rows of Spark's image source as those of read_images."""
    bad = F.col("image.height") < 0
    return raw.select(F.col("image.origin").alias("path"), *(F.when(~bad, F.col(f"image.{a}")).alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))), F.when(bad, F.lit("not a readable image")).alias("error"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with their bytes; content is not read where it is not asked for."""
    return spark.read.format("binaryFile").load(path)


def _mapped(images: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(height, width, channels, bytes) gives arrays of int32, one for each output row; undecodable rows are left out."""

    def work(batches):
        for batch in batches:
            for path, h, w, c, data in zip(*(batch.column(k) for k in range(5))):
                bytes_ = np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py())
                for more, v in kernel(bytes_):
                    values = pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), *(pa.array([m], pa.int32()) for m in (*more, v.shape[0], v.shape[1])), values], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return images.where("error is null").select("path", "height", "width", "channels", "data").mapInArrow(work, schema)


def grey(images: DataFrame) -> DataFrame:
    """read_images rows as packed rasters of grey values (Rec. 601 weights in integers); undecodable rows are left out."""

    def kernel(a):
        a = a.astype(np.int64)
        yield (), a[:, :, 0] if a.shape[2] < 3 else (114 * a[:, :, 0] + 587 * a[:, :, 1] + 299 * a[:, :, 2] + 500) // 1000

    return _mapped(images, kernel, "image_id string, h int, w int, v array<int>")


def channels(images: DataFrame) -> DataFrame:
    """read_images rows as one packed raster for each colour: image_id, c (0 blue, 1 green, 2 red, 3 opacity; 0 alone is grey), h, w, v.

    Operators that work within a row keep c; for those that group by image, give `each_channel`.
    """
    return _mapped(images, lambda a: (((k,), a[:, :, k]) for k in range(a.shape[2])), "image_id string, c int, h int, w int, v array<int>")


def each_channel(rasters: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An operator on packed rasters, applied to the rasters of channels() one colour at a time: its rows with image_id and c."""
    named = rasters.withColumn("image_id", F.concat_ws("#", F.col("c").cast("string"), "image_id")).drop("c")
    out = operator(named)
    return out.withColumn("c", F.substring_index("image_id", "#", 1).cast("int")).withColumn("image_id", F.expr("substr(image_id, instr(image_id, '#') + 1)"))


def merged(rasters: DataFrame) -> DataFrame:
    """The inverse of channels(): image_id, h, w, channels and v with the colours of a pixel side by side."""
    whole = rasters.groupBy("image_id", "h", "w").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("p"))
    return whole.select("image_id", "h", "w", F.size("p").alias("channels"), F.expr("flatten(transform(sequence(0, h * w - 1), i -> transform(p, x -> x.v[i])))").alias("v"))


def png(values: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3 or 4: blue, green, red, opacity) image as the bytes of a PNG file."""
    values = values.astype(np.uint8)
    h, w, c = (*values.shape, 1)[:3]
    if c >= 3:
        values = values[:, :, [2, 1, 0, 3][:c]]
    kind = {1: 0, 3: 2, 4: 6}[c]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), values.reshape(h, w * c)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def file_name(image_id: str) -> str:
    """A name for an image's file: its own where that is plain, else its last part with a digest of the whole (ids may be URIs)."""
    if re.fullmatch(r"[A-Za-z0-9_-]{1,100}", image_id):
        return image_id
    stem = re.sub(r"[^A-Za-z0-9_-]", "_", image_id.rstrip("/").rpartition("/")[2].partition(".")[0])[:60]
    return f"{stem}-{hashlib.sha256(image_id.encode()).hexdigest()[:16]}"


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _PngWriter(DataSourceWriter):
    """Files are written under hidden names of their own and take their final ones when the whole job commits."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def write(self, rows):
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for r in rows:
            shape = (r.h, r.w) if len(r.v) == r.h * r.w else (r.h, r.w, -1)
            name = file_name(r.image_id)
            hidden = f".{name}.{uuid.uuid4().hex}"
            with open(f"{self.folder}/{hidden}", "wb") as f:
                f.write(png(np.array(r.v).reshape(shape)))
            files.append((hidden, name))
        return _Written(files)

    def commit(self, messages):
        for hidden, name in (f for m in messages if m for f in m.files):
            os.replace(f"{self.folder}/{hidden}", f"{self.folder}/{name}.png")

    def abort(self, messages):
        for hidden, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(f"{self.folder}/{hidden}"):
                os.remove(f"{self.folder}/{hidden}")


class PngDataSource(DataSource):
    """df.write.format("png").save(folder): one file per packed raster; the folder must be a mounted one that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return "image_id string, h int, w int, v array<int>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PngWriter(self.options["path"])


def write_png(images: DataFrame, folder: str) -> None:
    """Packed rasters, grey or merged colours, as PNG files named by image_id (see file_name)."""
    images.sparkSession.dataSource.register(PngDataSource)
    images.select(F.col("image_id").cast("string").alias("image_id"), "h", "w", "v").write.format("png").mode("append").save(folder)
