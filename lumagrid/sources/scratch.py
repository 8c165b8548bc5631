"""Tables that iterative operators write between their rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, where all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-rounds-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Rounds:
    """Tables of successive rounds: each is written whole and read back, so lineage ends there, and the ones before it are deleted when told so."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/rounds-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int = 1) -> None:
        """Delete all tables but the last ones; results must not read the others any more."""
        jvm = self.spark.sparkContext._jvm
        for path in self.paths[: len(self.paths) - keep]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = self.paths[len(self.paths) - keep :]
