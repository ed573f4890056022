"""Append-only transcripts as a stream: what was appended is read, and nothing else.

The source lists a folder and gives out byte ranges of the files that have grown; its offset is how long each file was. Per
file, state holds where the next range begins, the start of an unfinished line and the number of lines; per session, the
last turn, which may go on; per mutation log, its document. A range that comes before its predecessor waits for it; one that
was seen before is skipped; a file that has become shorter was rewritten, and begins a new generation that replaces
the old one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.normalize import cleaned
from ..sources import jsonl, oplog

#: Bytes of a file that one task reads.
RANGE = 8 << 20
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Grown(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        self.path, self.generation, self.start, self.end = path, generation, start, end


class GrownFiles(DataSourceStreamReader):
    """Byte ranges that files of a folder (and those below it) have grown by; ``endings`` picks files."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.endings = options["path"], tuple(options.get("endings", ".jsonl,.ndjson").split(","))
        self.range = int(options.get("range", RANGE))
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.type == fs.FileType.File and f.path.endswith(self.endings):
                generation, length = self.seen.get(f.path, (0, 0))
                self.seen[f.path] = [generation + (f.size < length), f.size]
        return {"files": {p: list(x) for p, x in sorted(self.seen.items())}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {p: list(x) for p, x in end["files"].items()} | self.seen  # after a restart the offset is all there is
        out = []
        for path, (generation, length) in end["files"].items():
            before, done = start["files"].get(path, (0, 0))
            first = done if before == generation else 0
            out += [Grown(path, generation, at, min(length, at + self.range)) for at in range(first, length, self.range)]
        return out

    def read(self, part: Grown) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with system.open_input_file(part.path) as f:
            f.seek(part.start)
            yield part.path, part.generation, part.start, f.read(part.end - part.start)


class AppendLogs(DataSource):
    """``spark.readStream.format("append_logs").load(folder)``: rows (path, generation, start, data)."""

    @classmethod
    def name(cls) -> str:
        return "append_logs"

    def schema(self) -> str:
        return "path string, generation long, start long, data binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrownFiles(self.options)


class Lines(StatefulProcessor):
    """Ranges of a file to its complete lines, numbered from 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "generation long, next long, pos long, tail binary")
        self.early = handle.getMapState("early", "start long", "data binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = sorted(rows, key=lambda r: (r.generation, r.start))
        generation, after, pos, tail = tuple(self.at.get()) if self.at.exists() else (0, 0, 0, b"")
        for k, r in enumerate(held):
            if r.generation < generation or (r.generation == generation and r.start + len(r.data) <= after):
                continue
            if r.generation > generation:
                generation, after, pos, tail = r.generation, 0, 0, b""
                self.early.clear()
            if r.start > after:
                self.early.updateValue((r.start,), (bytes(r.data),))
                continue
            waiting = {s[0]: d[0] for s, d in self.early.iterator()} if self.early.exists() else {}
            data = bytes(r.data)[after - r.start :]
            after = r.start + len(r.data)
            while after in waiting:
                self.early.removeKey((after,))
                data += bytes(waiting[after])
                after += len(waiting[after])
            *whole, tail = (bytes(tail) + data).split(b"\n")
            for line in whole:
                yield Row(path=key[0], generation=generation, pos=pos, line=line.decode("utf-8", "replace"))
                pos += 1
        self.at.update((generation, after, pos, bytes(tail)))

    def close(self) -> None:
        pass


class Turns(StatefulProcessor):
    """Messages of a session to its merged turns: each batch gives the turns that are new or have grown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "generation long, msg_idx int, src_pos long, role string, text string, ts_ms long, tools string, merged int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = sorted(rows, key=lambda r: (r.generation, r.src_pos))
        turn = list(self.last.get()) if self.last.exists() else None
        for r in held:
            tools = json.loads(r.tools or "[]")
            if turn and r.generation < turn[0]:
                continue
            if turn and r.generation > turn[0]:
                turn = None
            if turn and turn[3] == r.role and bool(json.loads(turn[6])) == bool(tools):
                turn[4] += "\n\n" + r.text
                turn[6], turn[7] = json.dumps(json.loads(turn[6]) + tools), turn[7] + 1
                continue
            if turn and turn[0] == r.generation:
                yield self._row(key, turn)
            turn = [r.generation, turn[1] + 1 if turn else 0, r.src_pos, r.role, r.text, r.ts_ms, json.dumps(tools), 1]
        if turn:
            self.last.update(tuple(turn))
            yield self._row(key, turn)

    def _row(self, key: Any, t: list) -> Row:
        return Row(session_id=key[0], generation=t[0], msg_idx=t[1], src_pos=t[2], role=t[3], text=t[4], ts_ms=t[5], tools=t[6], merged=t[7])

    def close(self) -> None:
        pass


class Documents(StatefulProcessor):
    """Lines of a mutation log to its document, folded on from the last batch's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("document", "generation long, begun boolean, document string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        generation, begun, document = tuple(self.held.get()) if self.held.exists() else (0, False, "null")
        document = json.loads(document)
        for r in sorted(rows, key=lambda r: (r.generation, r.pos)):
            if r.generation > generation:
                generation, begun, document = r.generation, False, None
            try:
                operation = json.loads(r.line)
            except ValueError:
                continue
            if r.generation == generation and isinstance(operation, dict):
                document = oplog.fold([operation], document, begun)
                begun = begun or operation.get("kind") == oplog.INITIAL
        self.held.update((generation, begun, json.dumps(document)))
        if begun:
            yield Row(path=key[0], generation=generation, document=json.dumps(document, ensure_ascii=False))

    def close(self) -> None:
        pass


def lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, generation, pos, line): complete lines as files grow. The stream needs the RocksDB state store, set here."""
    spark.conf.set(*STATE_STORE)
    spark.dataSource.register(AppendLogs)
    grown = spark.readStream.format("append_logs").options(**options).load(folder)
    return grown.groupBy("path").transformWithState(Lines(), "path string, generation long, pos long, line string", "Append", "None")


def messages(spark: SparkSession, folder: str, shape: str, **options: str) -> DataFrame:
    """(path, generation and the columns of messages) of a folder whose logs have one dialect (a shape of jsonl.DIALECTS)."""
    rows = lines(spark, folder, **options).where("line rlike '^\\\\s*[{\\\\[]'")
    # The generation travels in the path, which projections of dialects hand through.
    rows = rows.select(F.concat_ws("\n", F.col("generation").cast("string"), "path").alias("path"), "pos", F.lit(shape).alias("shape"), F.try_parse_json("line").alias("v")).where("v is not null")
    said = jsonl.plain_messages(rows)
    return said.withColumns({"generation": F.substring_index("path", "\n", 1).cast("long"), "path": F.expr("substr(path, locate('\n', path) + 1)")})


def turns(spark: SparkSession, folder: str, shape: str, **options: str) -> DataFrame:
    """Merged turns by file (session_id is its path) as they come and grow; a consumer keeps, of each session's newest
    generation, the last row of each msg_idx (``upserted``)."""
    said = cleaned(messages(spark, folder, shape, **options).withColumn("session_id", F.col("path")))
    rows = said.select("session_id", "generation", "src_pos", "role", "text", "ts_ms", F.to_json("tools").alias("tools"))
    out = "session_id string, generation long, msg_idx int, src_pos long, role string, text string, ts_ms long, tools string, merged int"
    return rows.groupBy("session_id").transformWithState(Turns(), out, "Append", "None")


def documents(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, generation, document) of mutation logs, each time that they have grown."""
    return lines(spark, folder, **options).groupBy("path").transformWithState(Documents(), "path string, generation long, document string", "Append", "None")


def upserted(emitted: DataFrame, batch: str = "batch") -> DataFrame:
    """What the rows of all batches come to: the newest generation's turns, each as the last batch gave it."""
    newest = emitted.groupBy("session_id").agg(F.max("generation").alias("generation"))
    held = emitted.join(newest, ["session_id", "generation"])
    names = [c for c in emitted.columns if c not in ("session_id", "generation", "msg_idx", batch)]
    last = F.max_by(F.struct(*names), F.struct(batch, "merged")).alias("x")
    return held.groupBy("session_id", "msg_idx").agg(last).select("session_id", "msg_idx", "x.*")
