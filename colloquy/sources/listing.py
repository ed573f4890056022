"""Discovery on the executors: folders are listed level by level, patterns matched by Spark, caps reported as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import Steps
from .discovery import MAX_DEPTH, MAX_ENTRIES, Platform, _fixed_part, expand

#: Folders that one task lists, roughly.
FOLDERS = 64
ENTRIES = "root string, path string, is_dir boolean, length long, error string"


def regex_of(pattern: str) -> str:
    """A glob over path segments as a regular expression; ** is any number of segments."""
    out = ""
    for k, part in enumerate(pattern.split("/")):
        if part == "**":
            out += "(/[^/]*)*"
            continue
        one, i = "", 0
        while i < len(part):
            c = part[i]
            end = part.find("]", i + 2) if c == "[" else -1
            if end > 0:
                one += "[" + part[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if part[i + 1] == "!" else 0) + "]"
                i = end
            else:
                one += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
        out += ("/" if k else "") + one
    return f"^{out}$"


def opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        rows = []
        for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
            try:
                system, at = opened(path)
                scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
                rows += [(root, scheme + e.path, e.type == fs.FileType.Directory, e.size, None) for e in system.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True)) if e.type != fs.FileType.NotFound]
            except OSError as error:
                rows.append((root, path, False, None, str(error)[:200]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["root", "path", "is_dir", "length", "error"])


def listed(spark: SparkSession, roots: list[str], max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(files: root, path, length; cuts: root, path, reason) below roots, breadth first.

    A folder that is deeper than max_depth, one of a root that has more than max_entries entries by the end of a level, and
    one that can't be read is a row of cuts. The frontier is a table: a level's folders are dealt to tasks.
    """
    steps = Steps(spark, "listing")
    frontier = spark.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "root string, path string")
    levels, cuts = [], []
    for _ in range(max_depth):
        found = steps.stored(frontier.repartition(F.xxhash64("path") % FOLDERS).mapInArrow(_entries, ENTRIES))
        levels.append(found)
        cuts.append(found.where("error is not null").select("root", "path", F.col("error").alias("reason")))
        seen = levels[0]
        for more in levels[1:]:
            seen = seen.unionByName(more)
        full = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > max_entries).select("root")
        below = found.where("is_dir").select("root", "path")
        cuts.append(below.join(full, "root", "left_semi").withColumn("reason", F.lit("entries")))
        frontier = below.join(full, "root", "left_anti")
        if frontier.isEmpty():
            break
    else:
        cuts.append(frontier.withColumn("reason", F.lit("depth")))
    files, cut = seen.where("not is_dir and error is null").select("root", "path", "length"), cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)
    return files, cut


def discovered(spark: SparkSession, harnesses: list[tuple[str, str, str, list[str]]], platform: Platform, only: tuple[str, ...] = (), most: int = 400) -> tuple[DataFrame, DataFrame]:
    """(files: harness, kind, path, length; cuts: root, path, reason): the files that the templates of harnesses name, each
    once per harness. A harness's files beyond the first so many, in order of path, are rows of cuts."""
    rows = [(key, kind, _fixed_part(p), regex_of(p)) for key, _, kind, templates in harnesses if not only or key in only for t in templates for p in expand(t, platform)]
    rows = [r for r in rows if r[2] not in ("", "/")]
    if not rows:
        return spark.createDataFrame([], "harness string, kind string, path string, length long"), spark.createDataFrame([], "root string, path string, reason string")
    files, cuts = listed(spark, [r[2] for r in rows])
    patterns = spark.createDataFrame(rows, "harness string, kind string, root string, pattern string")  # some for each harness
    found = files.join(F.broadcast(patterns), "root").where("path rlike pattern").dropDuplicates(["harness", "path"])
    place = F.row_number().over(Window.partitionBy("harness").orderBy("path"))
    found = Steps(spark, "discovered").stored(found.withColumn("_place", place))
    over = found.where(F.col("_place") > most).select("root", "path", F.concat(F.lit("more files of "), "harness").alias("reason"))
    return found.where(F.col("_place") <= most).select("harness", "kind", "path", "length"), cuts.unionByName(over)


def contents(files: DataFrame) -> DataFrame:
    """files (path and more) with ``data``, their bytes, read where the row is; null where a file can't be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # a file at a time
                part = batch.slice(k, 1)
                try:
                    system, at = opened(part.column("path")[0].as_py())
                    with system.open_input_file(at) as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([data], pa.binary())], names=[*part.schema.names, "data"])

    return files.repartition(F.xxhash64("path") % (4 * FOLDERS)).mapInArrow(read, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, data binary")
