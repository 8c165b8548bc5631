"""Structured streaming over a folder of image files: every operator on packed rasters works on it, since all are stateless."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumagrid.sources.images import described, grey

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.pgm", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


#: Marks between the fields of a header: white space, or a comment to the end of its line.
_GAP = rb"(?:\s|#[^\n\r]*[\n\r])+"
_HEAD = re.compile(rb"P5" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)(?:#[^\n\r]*)?\s")


def _grey_map(content: bytes | None) -> tuple[int, int, np.ndarray] | None:
    """Height, width and values 0 to 255 of a binary grey map of one or two bytes a sample; None if it is broken."""
    m = _HEAD.match(content or b"")
    if not m:
        return None
    w, h, most = (int(x) for x in m.groups())
    kind = np.dtype(np.uint8 if most < 256 else ">u2")
    if not 0 < most < 65536 or w * h == 0 or len(content) - m.end() < w * h * kind.itemsize:
        return None
    v = np.frombuffer(content, kind, w * h, m.end()).astype(np.int64)
    return h, w, (np.minimum(v, most) * 255 + most // 2) // most


def decode_pgm(files: DataFrame) -> DataFrame:
    """Binary grey maps (P5) as packed rasters with an error column; broken files keep their row, without a raster."""

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _grey_map(content)
                values = pa.array([None], pa.list_(pa.int32())) if found is None else pa.ListArray.from_arrays(pa.array([0, found[2].size], pa.int32()), pa.array(found[2].astype(np.int32)))
                h, w = found[:2] if found else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), values, pa.array([None if found else "not a readable image"], pa.string())], ["image_id", "h", "w", "v", "error"])

    return files.select("path", "content").mapInArrow(work, "image_id string, h int, w int, v array<int>, error string")


def pictures_to_parquet(stream: DataFrame, folder: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch of picture files is read by the image source, made grey, passed through apply and written under its batch number: a batch that is run again replaces its own files."""

    def one(files: DataFrame, batch: int) -> None:
        paths = [r.path for r in files.select("path").collect()]  # at most per_trigger names
        if paths:
            spark = files.sparkSession
            read = spark.read.format("image").option("dropInvalid", False).load(paths)
            apply(grey(described(read))).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Write apply(stream) file by file; exactly once by the sink's log. Takes what is there and stops."""
    return apply(stream).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
