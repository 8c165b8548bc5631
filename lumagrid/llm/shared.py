"""Sessions, scratch tables and size checks that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that are sent to a Python worker at once, where the session says nothing else.
BATCH_BYTES = 15 << 18
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_VECTORED = "parquet.hadoop.vectored.io.enabled"
#: Scratch folders of each session, in the order in which they were written.
_written: dict[str, list[str]] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Bound what the session's tasks hold outside the heap, as options that stay set where the session says nothing else.

    Arrow batches are bounded by bytes: 10,000 rows of long texts are many for a worker that shares its executor's memory,
    and both sides hold batches that come and go. Parquet's vectored reads are off: each of their threads keeps a buffer
    as long as the longest range that it read from a local file.
    """
    for key, value in ((_BATCH, str(BATCH_BYTES)), (_VECTORED, "false")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only in local mode, where all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str = "llm") -> str:
    """A new folder name in the shared folder, known to `clean`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from the files: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def done(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, before the work that wrote them ends."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)
        own = _written.get(df.sparkSession.sparkContext.applicationId, [])
        if df.scratch_path in own:
            own.remove(df.scratch_path)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Delete scratch tables of this session; results that still read them must have been written before."""
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in own[since:]:
        _delete(spark, path)
    del own[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables that are written inside are deleted at the end, but for those that the given function keeps (it writes what is not written yet); all of them where the work fails."""
    own = _written.setdefault(spark.sparkContext.applicationId, [])
    since, kept = len(own), set()

    def keep(df: DataFrame) -> DataFrame:
        out = df if getattr(df, "scratch_path", None) else saved(df)
        kept.add(out.scratch_path)
        return out

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        inside = own[since:]
        for path in inside:
            if path not in kept:
                _delete(spark, path)
        own[since:] = [p for p in inside if p in kept]


def partitions(df: DataFrame) -> int:
    """How many groups work that is dealt out by a hash should have: as many as the session's shuffles."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case (Spark's names clash without regard to it)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def crc(column: str, n: int):
    """crc32 of a column as text, modulo n; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


#: Keys up to which the side of a semi-join is broadcast (16 MB of long keys).
SMALL = 2_000_000


def only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of df whose key is in keys: broadcast up to a size, else by shuffle."""
    keys = saved(keys.select(on).where(F.col(on).isNotNull()).distinct())
    return df.join(F.broadcast(keys) if keys.count() <= SMALL else keys, on, "left_semi")
