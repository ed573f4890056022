"""The scan: store files to one messages table, with per-file outcomes and session context."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, parent, project_of_encoded, project_of_path
from ..tables import Steps
from . import exports, json_docs, jsonl, markdown, oplog, sqlite_source
from .listing import contents

MAX_BYTES = 64 << 20
#: Names of index files, and extensions by format.
INDEX_FILES = ("sessions.json", "projects.json", "taskHistory.json", "sessions.jsonl", "storage.json", "workspace.json", "history_item.json")
SQLITE_EXT, TEXT_EXT = ("db", "sqlite", "sqlite3", "vscdb"), ("json", "jsonl", "ndjson", "md", "zst", "zstd")


def formats(files: DataFrame) -> DataFrame:
    """files (path, kind, length) with ``format`` and, for what isn't read, ``reason``. Order is precedence."""
    name = F.regexp_replace(basename(F.col("path")), r"\.zstd?\z", "")
    ext = F.lower(F.regexp_extract(basename(F.col("path")), r"\.([A-Za-z0-9]+)\z", 1))
    inner = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    kind = F.coalesce("kind", F.lit(""))
    fmt = (
        F.when(name.isin(*INDEX_FILES) | name.rlike(r"\.checkpoint\..*\.jsonl\z"), "skipped").when(kind == "detect-only", "detected_only")
        .when(ext.isin(*SQLITE_EXT) | (kind.startswith("sqlite") & ~ext.isin(*TEXT_EXT)), "sqlite").when(ext == "sql", "sqlite").when(F.col("length") > MAX_BYTES, "skipped")
        .when(kind == "chatgpt-export", "tree").when(kind == "claude-web-export", "lines").when((inner == "md") | (kind == "markdown"), "markdown")
        .when(inner.isin("jsonl", "ndjson"), "jsonl").when(inner == "json", "json").otherwise("jsonl")
    )
    reason = F.when(name.isin(*INDEX_FILES), "index file").when((fmt == "skipped") & (F.col("length") > MAX_BYTES), "too large").when(fmt == "skipped", "checkpoint copy")
    return files.withColumns({"format": fmt, "reason": reason})


def texts(files: DataFrame) -> DataFrame:
    """path, harness, format and the content as text of files; those whose name ends with .zst are unpacked."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                out.append(data.decode("utf-8", "replace") if data is not None and not path.endswith((".zst", ".zstd")) else _unpacked(data))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["path", "harness", "format", "content"])

    return contents(files.select("path", "harness", "format")).mapInArrow(unpack, "path string, harness string, format string, content string")


def _unpacked(data: bytes | None) -> str | None:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data).decode("utf-8", "replace") if data is not None else None
    except zstandard.ZstdError:
        return None


def sidecars(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(folder, workspace) of the workspace.json files two folders above chat logs in a folder chatSessions."""
    chats = files.where(basename(parent(F.col("path"))) == "chatSessions").select(parent(F.col("path"), 2).alias("folder")).distinct()
    held = contents(chats.withColumn("path", F.concat("folder", F.lit("/workspace.json")))).where("data is not null")
    v = F.try_parse_json(F.decode("data", "UTF-8"))
    return held.select("folder", F.coalesce(F.try_variant_get(v, "$.folder", "string"), F.try_variant_get(v, "$.workspace", "string")).alias("workspace")).where("workspace is not null")


def scan(spark: SparkSession, stores: list[tuple[str, str, str]] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, files): messages of all stores (harness, kind, path) in canonical shape plus path, harness, native_id,
    title, cwd, project, started_ms; files with their status (parsed, empty, detected_only, skipped) and reason.

    stores is a list, or a frame with ``length`` such as listing.discovered gives. Files are read once, by tasks, and their
    texts and records stored; only paths of databases come to the driver.
    """
    if not isinstance(stores, DataFrame):
        stores = spark.createDataFrame([(h, k, p, os.path.getsize(p)) for h, k, p in stores], "harness string, kind string, path string, length long")
    steps = Steps(spark, "scan")
    files = steps.stored(formats(stores))
    databases = [r.path for r in files.where("format = 'sqlite'").select("path").distinct().collect()]
    held = steps.stored(texts(files.where("format in ('tree', 'lines', 'markdown', 'jsonl', 'json')").dropDuplicates(["path"])).where("content is not null"))
    of = lambda *fs: held.where(F.col("format").isin(*fs))

    json_files = of("json").withColumn("v", F.try_parse_json("content"))
    lines = of("jsonl").unionByName(json_files.where("v is null").drop("v"))  # a .json file that isn't one may hold lines
    records = steps.stored(jsonl.records(lines))
    shape = jsonl.shapes(records)
    logs = records.where("v is not null").join(shape.where("shape = 'vscode-chat-log'").select("path"), "path", "left_semi")
    documents = json_files.where("v is not null").select("path", "harness", "v").unionByName(oplog.documents(logs).join(files.select("path", "harness"), "path").select("path", "harness", "v"))
    said_lines, context_lines = jsonl.read_records(records, shape)
    said_docs, context_docs = json_docs.read_json(documents)
    said_md, context_md = markdown.read_markdown(of("markdown"))
    names = ["path", "cwd", "native_id", "title", "started_ms"]
    context = context_lines.select(names).join(context_docs.select("path"), "path", "left_anti").unionByName(context_docs.select(names)).unionByName(context_md.select(names))
    single = said_lines.unionByName(said_docs).unionByName(said_md).join(context, "path", "left")

    many = exports.tree_messages(of("tree").select("path", F.try_parse_json("content").alias("v")).where("v is not null"))
    many = many.unionByName(exports.line_messages(jsonl.records(of("lines"))))
    many = many.unionByName(sqlite_source.messages(sqlite_source.read_sqlite(spark, databases)).withColumn("title", F.lit(None).cast("string")))
    many = many.withColumns({"cwd": F.lit(None).cast("string"), "started_ms": F.lit(None).cast("long")})
    found = single.unionByName(many.select(single.columns)).withColumn("file", F.substring_index("path", "#", 1))
    found = with_sidecar(found.join(files.select(F.col("path").alias("file"), "harness"), "file"), sidecars(spark, files))
    native = F.coalesce("native_id", F.regexp_replace(basename(F.col("file")), r"\.[A-Za-z0-9.]+\z", ""))
    project = F.coalesce(project_of_path(F.col("cwd")), project_of_encoded(basename(parent(F.col("file")))), project_of_path(parent(F.col("file"))))
    messages = found.withColumns({"native_id": native, "project": project, "session_id": F.concat_ws(":", "harness", native)})
    spoken = messages.select(F.col("file").alias("path")).distinct().withColumn("_said", F.lit(True))
    status = F.when(F.col("format").isin("skipped", "detected_only"), F.col("format")).when(F.col("_said"), "parsed").otherwise("empty")
    return messages, files.join(spoken, "path", "left").withColumn("status", status).drop("_said")


def with_sidecar(messages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Working directories from the workspace.json beside a chat folder: sidecars (folder, workspace) are joined on the
    grandparent folder; what the log itself says comes first."""
    rows = messages.withColumn("_folder", parent(F.col("file"), 2)).join(sidecars.select(F.col("folder").alias("_folder"), "workspace"), "_folder", "left")
    return rows.withColumn("cwd", F.coalesce("cwd", F.regexp_replace("workspace", "^file://", ""))).drop("_folder", "workspace")
