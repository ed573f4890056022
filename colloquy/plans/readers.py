"""Queries over the readers: the given conversations are written as logs of one format, which its reader reads back."""

from __future__ import annotations

import itertools
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources import exports, json_docs, jsonl, markdown, oplog, sqlite_source
from ..tables import shared_folder
from .oracle import _strip

c = F.col


def _talk(spark: SparkSession, sf_dir: str, roles: tuple[str, ...] = ("user", "assistant", "system")) -> DataFrame:
    """(id, n, role, text): turns of these roles, numbered from 0."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(c("role").isin(*roles) & (F.length(strip(c("text"))) > 0))
    return rows.select(c("conv_id").cast("string").alias("id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("n"), "role", "text")


def _obj(**fields) -> Column:
    return F.struct(*((f if isinstance(f, Column) else F.lit(f)).alias(k) for k, f in fields.items()))


def _listed(rows: DataFrame, item: Column) -> DataFrame:
    """(id, items): an item per turn, in order."""
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))), lambda e: e["x"]).alias("items"))


def _path(ending: str) -> Column:
    return F.concat(F.lit("/logs/"), c("id"), F.lit(f".{ending}"))


def _lines(rows: DataFrame, record: Column, head: Column | None = None) -> DataFrame:
    """(path, content) of JSON Lines logs: a record per turn, behind a head."""
    text = F.array_join("items", "\n")
    return _listed(rows, record).select(_path("jsonl").alias("path"), (text if head is None else F.concat_ws("\n", head, text)).alias("content"))


def _read(files: DataFrame) -> DataFrame:
    said, context = jsonl.read_jsonl(files)
    return said.join(context.select("path", "cwd", "native_id"), "path", "left").select("path", "src_pos", "role", "text", F.size("tools").alias("n_tools"), "cwd", "native_id")


def reader_pi(spark, sf_dir):
    record = F.to_json(_obj(type="message", message=_obj(role=c("role"), content=c("text"))))
    return _read(_lines(_talk(spark, sf_dir), record, F.to_json(_obj(type="session", id=c("id"), cwd=F.concat(F.lit("/w/"), c("id")), version=1))))


def reader_claude(spark, sf_dir):
    """Users' content is a text; assistants' has a text block and a tool call."""
    own = {"uuid": F.concat_ws("-", "id", "n"), "sessionId": c("id"), "cwd": F.concat(F.lit("/w/"), c("id"))}
    blocks = F.array(F.to_variant_object(_obj(type="text", text=c("text"))), F.to_variant_object(_obj(type="tool_use", name="read", input=_obj(file_path="a.py"))))
    record = F.when(c("role") == "assistant", F.to_json(_obj(type=c("role"), message=_obj(role=c("role"), content=blocks), **own))).otherwise(F.to_json(_obj(type=c("role"), message=_obj(role=c("role"), content=c("text")), **own)))
    return _read(_lines(_talk(spark, sf_dir), record))


def reader_codex_rollout(spark, sf_dir):
    record = F.to_json(_obj(type="response_item", payload=_obj(type="message", role=c("role"), content=F.array(_obj(type="input_text", text=c("text"))))))
    return _read(_lines(_talk(spark, sf_dir), record, F.to_json(_obj(type="session_meta", payload=_obj(id=c("id"), cwd=F.concat(F.lit("/w/"), c("id")))))))


def reader_codex_history(spark, sf_dir):
    return _read(_lines(_talk(spark, sf_dir, ("user",)), F.to_json(_obj(session_id=c("id"), ts=1_700_000_000, text=c("text")))))


def reader_antigravity(spark, sf_dir):
    """Sources in capitals; users' texts in request tags."""
    tagged = F.when(c("role") == "user", F.concat(F.lit("<USER_REQUEST>"), "text", F.lit("</USER_REQUEST>"))).otherwise(c("text"))
    source = F.when(c("role") == "user", "USER_EXPLICIT").when(c("role") == "assistant", "MODEL").otherwise("SYSTEM")
    return _read(_lines(_talk(spark, sf_dir), F.to_json(_obj(step_index=c("n"), source=source, created_at="2024-01-01T00:00:00Z", content=tagged))))


def reader_event_logs(spark, sf_dir):
    """Types like user.message in one conversation, user/message in the next."""
    sep = F.when(c("id").cast("long") % 2 == 0, ".").otherwise("/")
    record = F.to_json(_obj(type=F.concat("role", sep, F.lit("message")), data=_obj(content=c("text"))))
    return _read(_lines(_talk(spark, sf_dir), record, F.to_json(_obj(type=F.concat(F.lit("session"), sep, F.lit("start")), data=_obj(sessionId=c("id"))))))


def reader_acp(spark, sf_dir):
    """Each turn comes in two chunks."""
    half = F.greatest(F.lit(1), F.floor(F.length("text") / 2)).cast("int")
    kind = F.when(c("role") == "user", "user_message_chunk").otherwise("agent_message_chunk")
    chunk = lambda t: F.to_json(_obj(timestamp=1_700_000_000, params=_obj(update=_obj(sessionUpdate=kind, content=_obj(type="text", text=t)))))
    record = F.concat_ws("\n", chunk(F.substr("text", F.lit(1), half)), chunk(F.substr("text", half + 1)))
    return _read(_lines(_talk(spark, sf_dir, ("user", "assistant")), record, F.to_json(_obj(info=_obj(cwd=F.concat(F.lit("/w/"), c("id")), id=c("id"))))))


def reader_kimi(spark, sf_dir):
    """Users' messages are whole, assistants' come in two parts."""
    whole = F.to_json(_obj(type="context.append_message", time=1_700_000_000, message=_obj(role="user", content=c("text"))))
    part = lambda t: F.to_json(_obj(type="context.append_loop_event", event=_obj(part=_obj(type="text", text=t))))
    record = F.when(c("role") == "user", whole).otherwise(F.concat_ws("\n", part(c("text")), part(F.lit("and so on"))))
    return _read(_lines(_talk(spark, sf_dir, ("user", "assistant")), record))


def reader_generic(spark, sf_dir):
    who = F.when(c("role") == "user", "human").when(c("role") == "assistant", "ai").otherwise(c("role"))
    return _read(_lines(_talk(spark, sf_dir), F.concat_ws("\n", F.to_json(_obj(role=who, content=c("text"), session_id=c("id"))), F.lit("{broken"))))


def _pairs(spark, sf_dir) -> DataFrame:
    """(id, n, ask, answer): users' turns with the assistant's turn behind them."""
    by = Window.partitionBy("id").orderBy("n")
    rows = _talk(spark, sf_dir, ("user", "assistant")).withColumn("answer", F.when(F.lead("role").over(by) == "assistant", F.lead("text").over(by)))
    return rows.where("role = 'user'").select("id", "n", c("text").alias("ask"), F.coalesce("answer", F.lit("")).alias("answer"))


def _documents(spark, sf_dir, files: DataFrame, harness: str) -> DataFrame:
    said, context = json_docs.read_json(files.withColumn("harness", F.lit(harness)).select("path", "harness", "v"))
    return said.join(context.select("path", "cwd", "native_id"), "path", "left").select("path", "src_pos", "role", strip(c("text")).alias("text"), F.size("tools").alias("n_tools"), "cwd", "native_id")


def reader_mutation_log(spark, sf_dir):
    """An editor's log: an empty document, then each request pushed, and its answer set in a mutation of its own."""
    ask = F.to_json(_obj(kind=2, k=F.array(F.lit("requests")), v=F.array(_obj(message=_obj(text=c("ask"))))))
    at = F.row_number().over(Window.partitionBy("id").orderBy("n")) - 1
    rows = _pairs(spark, sf_dir).withColumn("at", at)
    answer = F.concat(F.lit('{"kind":1,"k":["requests",'), c("at").cast("string"), F.lit(',"response"],"v":'), F.to_json(F.array(_obj(value=c("answer")))), F.lit("}"))
    files = _lines(rows, F.concat_ws("\n", ask, answer), F.to_json(_obj(kind=0, v=_obj(sessionId=c("id"), requests=F.array().cast("array<string>")))))
    records = jsonl.records(files)
    shape = jsonl.shapes(records).where("shape = 'vscode-chat-log'")
    return _documents(spark, sf_dir, oplog.documents(records.join(shape.select("path"), "path")), "vscode")


def _json_files(rows: DataFrame, document: Column) -> DataFrame:
    return rows.select(_path("json").alias("path"), F.try_parse_json(F.to_json(document)).alias("v"))


def reader_json_history(spark, sf_dir):
    rows = _listed(_talk(spark, sf_dir), _obj(message=_obj(role=c("role"), content=c("text"))))
    return _documents(spark, sf_dir, _json_files(rows, _obj(history=c("items"), workspaceDirectory=F.concat(F.lit("/w/"), c("id")), sessionId=c("id"))), "continue")


def reader_json_thread(spark, sf_dir):
    rows = _listed(_talk(spark, sf_dir), _obj(role=c("role"), content=F.array(_obj(type="text", text=c("text")))))
    return _documents(spark, sf_dir, _json_files(rows, _obj(id=c("id"), messages=c("items"))), "zed")


def reader_json_array(spark, sf_dir):
    return _documents(spark, sf_dir, _json_files(_listed(_talk(spark, sf_dir), _obj(role=c("role"), content=c("text"))), c("items")), "cline")


def reader_json_gemini(spark, sf_dir):
    who = F.when(c("role") == "assistant", "gemini").otherwise("user")
    rows = _listed(_talk(spark, sf_dir, ("user", "assistant")), _obj(type=who, content=c("text")))
    return _documents(spark, sf_dir, _json_files(rows, _obj(sessionId=c("id"), messages=c("items"))), "gemini")


def reader_markdown(spark, sf_dir):
    """Users' lines begin with ####; a tool line, which is no part of a turn, follows each assistant's turn."""
    text = strip(c("text"))
    block = F.when(c("role") == "user", F.regexp_replace(text, "(?m)^", "#### ")).otherwise(F.concat(text, F.lit("\n> Tokens: 5")))
    files = _listed(_talk(spark, sf_dir, ("user", "assistant")), block).select(_path("md").alias("path"), F.concat(F.lit("# aider chat started at 2024-01-01 10:00:00\n"), F.array_join("items", "\n")).alias("content"))
    said, context = markdown.read_markdown(files)
    return said.join(context.select("path", "started_ms"), "path", "left").select("path", "src_pos", "role", "text", "started_ms")


def reader_tree_export(spark, sf_dir):
    """A conversation is a tree: a root, its turns one below another, and an older branch beside the last turn."""
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    node = F.struct(
        name(c("n") + 1).alias("key"), _obj(parent=F.when(c("n") == 0, "root").otherwise(name(c("n"))), children=F.array(name(c("n") + 2)), message=_obj(author=_obj(role=c("role")), content=_obj(parts=F.array(c("text"))))).alias("value")
    )
    rows = _listed(_talk(spark, sf_dir), node)
    old = F.struct(F.lit("old").alias("key"), _obj(parent=name(F.size("items") - 1), children=F.array().cast("array<string>"), message=_obj(author=_obj(role="assistant"), content=_obj(parts=F.array(F.lit("old branch"))))).alias("value"))
    tree = _obj(conversation_id=c("id"), title=F.concat(F.lit("Talk "), c("id")), current_node=name(F.size("items")), mapping=F.map_from_entries(F.concat(c("items"), F.array(old))))
    said = exports.tree_messages(rows.select(_path("json").alias("path"), F.try_parse_json(F.to_json(F.array(tree))).alias("v")))
    return said.select("path", "native_id", "title", "src_pos", "role", "text")


def reader_line_export(spark, sf_dir):
    who = F.when(c("role") == "user", "human").otherwise(c("role"))
    rows = _listed(_talk(spark, sf_dir), _obj(sender=who, text=c("text"), created_at="2024-01-01T00:00:00Z"))
    files = rows.select(_path("jsonl").alias("path"), F.to_json(_obj(uuid=c("id"), name=F.concat(F.lit("Talk "), c("id")), chat_messages=c("items"))).alias("content"))
    return exports.line_messages(jsonl.records(files)).select("path", "native_id", "title", "src_pos", "role", "text", "ts_ms")


#: Turns that a database holds, about: files grow in number, not in size.
TURNS_PER_FILE = 200_000


def _databases(spark: SparkSession, rows: DataFrame, key_value: bool, least: int = 4) -> list[str]:
    """Databases in the shared folder, written by tasks: conversations dealt to files by their number, inserted as they come."""
    folder = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}".removeprefix("file://")
    files = max(least, -(-rows.count() // TURNS_PER_FILE))
    names = ("key", "value") if key_value else ("session_id", "role", "content", "created_at")

    def dealt_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                yield from zip(*(part.column(n).to_pylist() for n in ("file", *names)), strict=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for file, held in itertools.groupby(dealt_rows(batches), key=lambda r: r[0]):
            path = f"{folder}/{file}.db"
            part = f"{path}.{uuid.uuid4().hex}"
            db = sqlite3.connect(part)
            db.execute("CREATE TABLE cursorDiskKV(key TEXT, value BLOB)" if key_value else "CREATE TABLE messages(session_id TEXT, role TEXT, content TEXT, created_at INTEGER)")
            marks = ", ".join("?" * len(names))
            db.executemany(f"INSERT INTO {'cursorDiskKV' if key_value else 'messages'} VALUES ({marks})", (r[1:] for r in held))
            db.commit()
            db.close()
            os.replace(part, path)  # a task that is run again leaves the same file
            yield pa.RecordBatch.from_pydict({"path": [path]})

    dealt = rows.withColumn("file", c("order") % files).repartition(files, "file").sortWithinPartitions("file", "order", "n")
    return sorted(r.path for r in dealt.select("file", *names).mapInArrow(write, "path string").collect())  # as many as files


def reader_sqlite_table(spark, sf_dir):
    rows = _talk(spark, sf_dir).select("n", c("id").cast("long").alias("order"), c("id").alias("session_id"), "role", c("text").alias("content"), F.lit(1_700_000_000).cast("long").alias("created_at"))
    said = sqlite_source.messages(sqlite_source.read_sqlite(spark, _databases(spark, rows, False)))
    return _numbered(said).select("native_id", "n", "role", "text", "ts_ms")


def reader_sqlite_key_value(spark, sf_dir):
    value = F.to_json(_obj(type=F.when(c("role") == "user", 1).otherwise(2), text=c("text")))
    rows = _talk(spark, sf_dir, ("user", "assistant")).select("n", c("id").cast("long").alias("order"), F.concat_ws(":", F.lit("bubbleId"), "id", "n").alias("key"), value.alias("value"))
    said = sqlite_source.messages(sqlite_source.read_sqlite(spark, _databases(spark, rows, True)))
    return _numbered(said).select("native_id", "n", "role", "text")


def _numbered(said: DataFrame) -> DataFrame:
    return said.withColumn("n", F.row_number().over(Window.partitionBy("path", "native_id").orderBy("src_pos")) - 1)


def queries() -> dict:
    found = (
        reader_pi, reader_claude, reader_codex_rollout, reader_codex_history, reader_antigravity, reader_event_logs, reader_acp, reader_kimi, reader_generic, reader_mutation_log, reader_json_history, reader_json_thread,
        reader_json_array, reader_json_gemini, reader_markdown, reader_tree_export, reader_line_export, reader_sqlite_table, reader_sqlite_key_value,
    )
    return {f.__name__: f for f in found}


def _talk_sql(roles: str = "'user', 'assistant', 'system'") -> str:
    return f"""c AS (
  SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, {_strip('text')} AS text FROM conversations WHERE role IN ({roles}) AND {_strip('text')} <> '')"""


def _log_sql(pos: str, roles: str = "'user', 'assistant', 'system'", role: str = "role", text: str = "text", tools: str = "0", cwd: str = "NULL", native: str = "NULL", ending: str = "jsonl") -> str:
    return f"""WITH {_talk_sql(roles)}
SELECT '/logs/' || id || '.{ending}' AS path, ({pos})::BIGINT AS src_pos, {role} AS role, {text} AS text, ({tools})::INTEGER AS n_tools, {cwd}::VARCHAR AS cwd, {native}::VARCHAR AS native_id FROM c"""


def oracle_sql() -> dict[str, str]:
    two, own = "'user', 'assistant'", "'/w/' || id"
    vscode = f"""WITH {_talk_sql(two)},
p AS (SELECT id, n, text AS ask, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer, role FROM c WINDOW w AS (PARTITION BY id ORDER BY n)),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k FROM p WHERE role = 'user')
SELECT '/logs/' || id || '.jsonl' AS path, (2 * k)::BIGINT AS src_pos, 'user' AS role, ask AS text, 0::INTEGER AS n_tools, NULL::VARCHAR AS cwd, id AS native_id FROM q
UNION ALL SELECT '/logs/' || id || '.jsonl', (2 * k + 1)::BIGINT, 'assistant', answer, 0::INTEGER, NULL::VARCHAR, id FROM q WHERE answer <> ''"""
    lines = "len(string_split(text, chr(10))) + CASE role WHEN 'assistant' THEN 1 ELSE 0 END"
    return {
        "reader_pi": _log_sql("n + 1", cwd=own, native="id"), "reader_claude": _log_sql("n", tools="CASE role WHEN 'assistant' THEN 1 ELSE 0 END", cwd=own, native="id"),
        "reader_codex_rollout": _log_sql("n + 1", cwd=own, native="id"), "reader_codex_history": _log_sql("n", "'user'"), "reader_antigravity": _log_sql("n"), "reader_event_logs": _log_sql("n + 1", native="id"),
        "reader_acp": _log_sql("1 + 2 * n", two, cwd=own, native="id"),
        "reader_kimi": _log_sql("sum(CASE role WHEN 'user' THEN 1 ELSE 2 END) OVER (PARTITION BY id ORDER BY n) - CASE role WHEN 'user' THEN 1 ELSE 2 END", two, text="text || CASE role WHEN 'assistant' THEN chr(10) || 'and so on' ELSE '' END"),
        "reader_generic": _log_sql("2 * n", role="CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END", native="id"), "reader_mutation_log": vscode,
        "reader_json_history": _log_sql("n", cwd=own, native="id", ending="json"), "reader_json_thread": _log_sql("n", native="id", ending="json"), "reader_json_array": _log_sql("n", ending="json"),
        "reader_json_gemini": _log_sql("n", two, native="id", ending="json"),
        "reader_markdown": f"""WITH {_talk_sql(two)}, m AS (SELECT *, sum({lines}) OVER (PARTITION BY id ORDER BY n) - ({lines}) + 1 AS pos FROM c)
SELECT '/logs/' || id || '.md' AS path, pos::BIGINT AS src_pos, role, text, epoch_ms(TIMESTAMP '2024-01-01 10:00:00')::BIGINT AS started_ms FROM m WHERE role = 'user' OR n > 0""",
        "reader_tree_export": f"""WITH {_talk_sql()} SELECT '/logs/' || id || '.json#' || id AS path, id AS native_id, 'Talk ' || id AS title, n::BIGINT AS src_pos, role, text FROM c WHERE role IN ({two})""",
        "reader_line_export": f"""WITH {_talk_sql()} SELECT '/logs/' || id || '.jsonl#' || id AS path, id AS native_id, 'Talk ' || id AS title, n::BIGINT AS src_pos, role, text, epoch_ms(TIMESTAMP '2024-01-01 00:00:00')::BIGINT AS ts_ms FROM c""",
        "reader_sqlite_table": f"WITH {_talk_sql()} SELECT id AS native_id, n::INTEGER AS n, role, text, 1700000000000::BIGINT AS ts_ms FROM c",
        "reader_sqlite_key_value": f"WITH {_talk_sql(two)} SELECT id AS native_id, n::INTEGER AS n, role, text FROM c",
    }
