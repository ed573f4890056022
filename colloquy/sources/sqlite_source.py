"""A Spark data source for SQLite stores, opened read-only: a partition per range of row ids of a file's table, so a large
database is read by many tasks; as a stream, the rows behind the largest row id seen.

Rows are (path, tbl, kind, session, pos, role, payload, ts): for key-value stores the rows whose key begins
``bubbleId:``, for others those of the table that looks most like messages. Text and roles are made of them by Spark
expressions, see ``messages``. ``.sql`` scripts are run into a database in memory first, each in one task. pos is the row id, or the place in a view.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, StringStartsWith

from ..functions.roles import epoch_ms
from .content import with_parts
from .jsonl import is_string, s, v

#: Candidate columns, in order of preference.
ROLE_COLS = ("role", "author", "sender", "type", "source", "who")
TEXT_COLS = ("text", "content", "message", "body", "value", "data", "parts", "payload", "json")
ID_COLS = ("session_id", "sessionId", "conversation_id", "conversationId", "thread_id", "chat_id", "cid")
TS_COLS = ("timestamp", "created_at", "createdAt", "created", "ts", "time", "updated_at")
KEY_PREFIX = "bubbleId:"
LEAST_SCORE = 2

SCHEMA = "path string, tbl string, kind string, session string, pos long, role string, payload string, ts string"


#: Row ids that one task reads.
RANGE = 200_000


class SqliteSource(DataSource):
    """Options: ``paths`` (one per line), ``keyPrefix``, ``range`` and ``columns`` (comma-separated; only these are read)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_store"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = {f.split()[0]: f for f in SCHEMA.split(", ")}
        return ", ".join(fields[c] for c in wanted) if wanted else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema.names)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SqliteStreamReader(self.options, schema.names)


class Rows(InputPartition):
    """Rows of a table with low < row id <= high; a table without row ids, or a script, as a whole (high is None)."""

    def __init__(self, path: str, table: str | None = None, kind: str | None = None, low: int = 0, high: int | None = None):
        self.path, self.table, self.kind, self.low, self.high = path, table, kind, low, high


class _Stores:
    """What batch and stream readers share: finding tables, cutting them into ranges, reading one."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.prefix, self.range, self.names = options.get("keyPrefix", KEY_PREFIX), int(options.get("range", RANGE)), names
        self.kind: str | None = None
        self.session_prefix: str | None = None

    def chosen(self, db: sqlite3.Connection) -> list[tuple[str, str]]:
        """(table, kind): the key-value tables with such keys, else the table that looks most like messages."""
        found = tables(db)
        keyed = [(t, "kv") for t, columns in found.items() if key_column(t, columns) and next(key_value_rows(db, "", t, columns, self.prefix), None)]
        if keyed:
            return keyed
        best = max(found, key=lambda t: score(t, found[t]), default=None)
        return [(best, "table")] if best is not None and score(best, found[best]) >= LEAST_SCORE else []

    def last_row(self, db: sqlite3.Connection, table: str) -> int | None:
        try:
            return db.execute(f"SELECT coalesce(max(rowid), 0) FROM {_quoted(table)}").fetchone()[0]
        except sqlite3.Error:
            return None  # a view, or a table without row ids

    def ranges(self, path: str, low: dict[str, int] | None = None) -> Iterator[tuple[Rows, int | None]]:
        """The ranges of a store behind these row ids by table, and each table's last row id."""
        if path.endswith(".sql"):
            yield Rows(path), None
            return
        db = opened(path)
        if db is None:
            return
        try:
            for table, kind in self.chosen(db):
                last = self.last_row(db, table)
                if self.kind not in (None, kind):
                    continue
                if last is None:
                    yield Rows(path, table, kind), None
                    continue
                for at in range((low or {}).get(table, 0), last, self.range):
                    yield Rows(path, table, kind, at, min(last, at + self.range)), last
        finally:
            db.close()

    def rows(self, part: Rows) -> Iterator[tuple]:
        db = opened(part.path)
        if db is None:
            return
        try:
            for table, kind in [(part.table, part.kind)] if part.table else self.chosen(db):
                columns = tables(db).get(table, [])
                if self.kind in (None, kind):
                    found = key_value_rows(db, part.path, table, columns, self.prefix + (self.session_prefix or ""), part.low, part.high, self.names) if kind == "kv" else table_rows(db, part.path, table, columns, part.low, part.high, self.names)
                    for row in found:
                        yield tuple(row[n] for n in self.names)
        finally:
            db.close()


class SqliteReader(_Stores, DataSourceReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Filters on the kind and on a session's prefix are taken over; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kind = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("session",):
                self.session_prefix = f.value
                yield f
            else:
                yield f

    def partitions(self) -> list[Rows]:
        return [part for path in self.paths for part, _ in self.ranges(path)] or [Rows("")]

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition and partition.path:
            yield from self.rows(partition)


class SqliteStreamReader(_Stores, DataSourceStreamReader):
    """Offsets are the last row id of each table of each store. Scripts and tables without row ids aren't streamed."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out: dict[str, dict[str, int]] = {}
        for path in self.paths:
            for part, last in self.ranges(path):
                if last is not None:
                    out.setdefault(path, {})[part.table] = last
        return out

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        out = []
        for path, lasts in end.items():
            for part, _ in self.ranges(path, start.get(path)):
                if part.high is not None and part.low < lasts.get(part.table, 0):
                    part.high = min(part.high, lasts[part.table])  # rows that came after the offset was taken are the next batch's
                    out.append(part)
        return out

    def read(self, partition: Rows) -> Iterator[tuple]:
        return self.rows(partition)


def opened(path: str) -> sqlite3.Connection | None:
    local = re.sub(r"^file:/*", "/", path)
    try:
        if local.endswith(".sql"):
            db = sqlite3.connect(":memory:")
            with open(local, encoding="utf-8") as script:
                db.executescript(script.read())
        else:
            db = sqlite3.connect(f"file:{local}?mode=ro", uri=True)
        db.execute("SELECT count(*) FROM sqlite_master")
    except (sqlite3.Error, OSError):
        return None
    return db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(db: sqlite3.Connection) -> dict[str, list[str]]:
    names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY rowid")]
    return {n: [c[1] for c in db.execute(f"PRAGMA table_info({_quoted(n)})")] for n in names}


def _text(x) -> str | None:
    return x.decode("utf-8", "replace") if isinstance(x, bytes) else None if x is None else str(x)


def key_column(table: str, columns: list[str]) -> str | None:
    """The key of a key-value table; None for other tables."""
    if not re.search("kv|itemtable", table, re.IGNORECASE) or "value" not in columns:
        return None
    return "key" if "key" in columns else next((c for c in columns if "key" in c.lower()), None)


def _select(db: sqlite3.Connection, table: str, expressions: list[str], where: list[str], values: list, low: int, high: int | None) -> Iterator[tuple]:
    """(pos, values...): by row id in a range, or all of a table without row ids, counted."""
    if high is not None:
        yield from db.execute(f"SELECT rowid, {', '.join(expressions)} FROM {_quoted(table)} WHERE {' AND '.join(['rowid > ? AND rowid <= ?', *where])} ORDER BY rowid", (low, high, *values))
        return
    condition = f" WHERE {' AND '.join(where)}" if where else ""
    for pos, row in enumerate(db.execute(f"SELECT {', '.join(expressions)} FROM {_quoted(table)}{condition}", values)):
        yield (pos, *row)


def key_value_rows(db: sqlite3.Connection, path: str, table: str, columns: list[str], prefix: str, low: int = 0, high: int | None = None, names: list[str] | None = None) -> Iterator[dict]:
    """The rows of a key-value table whose key begins so; the session is the key's second part."""
    key = _quoted(key_column(table, columns))
    end = prefix[:-1] + chr(ord(prefix[-1]) + 1)
    value = "value" if names is None or "payload" in names else "NULL"
    for pos, k, v_ in _select(db, table, [key, value], [f"{key} >= ?", f"{key} < ?"], [prefix, end], low, high):
        yield {"path": path, "tbl": table, "kind": "kv", "session": (_text(k).split(":") + [""])[1] or "cursor", "pos": pos, "role": None, "payload": _text(v_), "ts": None}


def score(table: str, columns: list[str]) -> int:
    """How much a table looks like messages; 0 without a text column."""
    if not any(c in columns for c in TEXT_COLS):
        return 0
    return 2 * any(c in columns for c in ROLE_COLS) + any(c in columns for c in ID_COLS) + 3 * ("message" in table.lower())


def table_rows(db: sqlite3.Connection, path: str, table: str, columns: list[str], low: int = 0, high: int | None = None, names: list[str] | None = None) -> Iterator[dict]:
    """The rows of a table of messages; the payload is the first text that isn't empty."""
    pick = lambda known, name: next((c for c in known if c in columns), None) if names is None or name in names else None
    role, session, ts = pick(ROLE_COLS, "role"), pick(ID_COLS, "session"), pick(TS_COLS, "ts")
    spoken = next((c for c in ROLE_COLS if c in columns), None)
    texts = [c for c in TEXT_COLS if c in columns and c != spoken] if names is None or "payload" in names else []
    wanted = [_quoted(c) if c else "NULL" for c in (session, role, ts)] + [_quoted(c) for c in texts]
    for pos, *row in _select(db, table, wanted, [], [], low, high):
        payload = next((t for t in map(_text, row[3:]) if t), None)
        yield {"path": path, "tbl": table, "kind": "table", "session": _text(row[0]) if session else "default", "pos": pos, "role": _text(row[1]), "payload": payload, "ts": _text(row[2])}


def read_sqlite(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters over
    return spark.read.format("sqlite_store").options(**options).option("paths", "\n".join(paths)).load()


def stream_sqlite(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """The rows of stores as they are added: messages() takes them."""
    spark.dataSource.register(SqliteSource)
    return spark.readStream.format("sqlite_store").options(**options).option("paths", "\n".join(paths)).load()


def messages(rows: DataFrame) -> DataFrame:
    """Messages of store rows. A key-value bubble's type 1 is the user, 2 the assistant (the documented intent: the
    reference never gets there). A payload that is JSON is walked, other text is taken as it is."""
    rows = rows.where("payload is not null").withColumn("v", F.try_parse_json(F.when(F.col("payload").rlike(r'^\s*[{\["]'), F.col("payload"))))
    number = F.try_variant_get("v", "$.type", "int")
    bubble = F.when(number == 1, "user").when(number == 2, "assistant").otherwise(s("role"))
    role = F.when(F.col("kind") == "kv", bubble).otherwise(F.coalesce("role", s("role")))
    boxed = F.schema_of_variant("v").startswith("OBJECT")
    spoken = F.when(is_string(v("text")) & (s("text") != ""), v("text"))
    content = F.when(F.col("v").isNull(), F.col("payload").cast("variant")).when(boxed & (F.col("kind") == "kv"), F.coalesce(spoken, v("richText"), v("content"), v("message")))
    content = content.when(boxed, F.coalesce(v("content"), v("text"), v("message"), F.col("v"))).otherwise(F.col("v"))
    ts = F.coalesce("ts", F.try_variant_get("v", "$.createdAt", "string"), F.try_variant_get("v", "$.timestamp", "string"))
    told = rows.select("path", "session", "pos", role.alias("role"), ts.alias("ts"), content.alias("content"))
    out = with_parts(told, F.col("content")).where("p.text <> ''")
    return out.select(
        F.concat_ws("#", "path", "session").alias("path"), F.col("session").alias("native_id"), F.col("pos").alias("src_pos"), "role", "p.text", epoch_ms(F.col("ts")).alias("ts_ms"), "p.tools", "p.thinking_chars",
    )
