"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back, so that a lost
executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own only where a local session names none, as in tests; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.getParent())
    fs.deleteOnExit(hadoop)
    return path


#: Shuffle files are deleted when their query ends. What is stored is read from its table, so they are needed no more.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read back; its shuffle files are gone, whatever the session sets for other queries."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back."""
    return written(df, fresh_path(df.sparkSession, name))


class Scratch:
    """Tables that an operator needs only until its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        out = written(df, path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all; nothing may read them any more."""
        for key in [id(t) for t in tables] or list(self.paths):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[0])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_fields(schema: StructType, **fields: DataType) -> StructType:
    """The schema with these fields after its own; schema itself stays as it is."""
    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in fields.items())])


def unused(taken: list[str], *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to be none of those taken (in any case)."""
    held = {c.lower() for c in taken}
    return [next(n for n in ("_" * k + name for k in range(1, 100)) if n.lower() not in held) for name in names]


def raw(column: pa.Array) -> Iterator[memoryview | None]:
    """The bytes of each string or binary value, without copies; None for nulls."""
    values = column.cast(pa.large_binary())
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    whole = memoryview(data) if data is not None else memoryview(b"")
    for i, there in enumerate(values.is_valid().to_pylist()):
        yield whole[ends[i] : ends[i + 1]] if there else None


def slices(batch: pa.RecordBatch, text_col: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about 4 MB of text; a longer text is a slice of its own."""
    ends = np.cumsum([len(t) if t is not None else 0 for t in raw(batch.column(text_col))])
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def released(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches; when a task ends, its Python worker, which is used again, gives memory back."""

    @functools.wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
