"""Tables written between steps, in the folder that the cluster's executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a local session that names none gets one of its own, a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Steps:
    """Tables that cut the lineage of a loop; each can be dropped once nothing reads it, and goes with the session's end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/steps/{name}-{uuid.uuid4().hex}", 0
        fs, at = hadoop(spark, self.base)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def stored(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            fs, at = hadoop(self.spark, self.paths.pop(id(table))[0])
            fs.delete(at, True)
