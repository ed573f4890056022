"""JSON Lines logs: records as variants, shape by ordered predicates over the first records, one projection per dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import epoch_ms
from ..functions.text import strip
from .content import parts_of

HEAD = 40
#: Roles and types by dialect.
ROLES = ("user", "assistant", "system", "tool", "human", "ai", "model", "developer", "gemini")
EVENT_ROLES = ("user", "assistant", "system", "human", "ai", "model", "tool")
NOT_CONVERSATION = (
    "token_count function_call function_call_output tool_result tool_use reasoning summary metadata session_meta turn_context checkpoint state error event"
).split()


def v(path: str, of: str = "v") -> Column:
    """A variant inside a record."""
    return F.try_variant_get(F.col(of), f"$.{path}", "variant")


def is_string(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))


def s(path: str, of: str = "v") -> Column:
    """The string at a path; null for values of other types (a cast would give their JSON)."""
    return F.when(is_string(v(path, of)), F.try_variant_get(F.col(of), f"$.{path}", "string"))


def scalar(*paths: str) -> Column:
    """The first string or number as text."""
    return F.coalesce(*(F.when(~F.schema_of_variant(v(p)).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(F.col("v"), f"$.{p}", "string")) for p in paths))


def has(path: str) -> Column:
    """Present and not null."""
    return F.coalesce(F.schema_of_variant(v(path)) != "VOID", F.lit(False))


def is_number(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(v(path)).rlike("INT|DECIMAL|DOUBLE|FLOAT"), F.lit(False))


def records(files: DataFrame) -> DataFrame:
    """files (path, content text and more) -> a row per line that begins like JSON: path, pos, v (null if malformed)."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    return fenced(lines.where("line rlike '^[{\\\\[]'").withColumns({"pos": F.col("pos").cast("long"), "v": F.try_parse_json("line")}), ["path", "pos", "v"])


def fenced(rows: DataFrame, columns: list[str]) -> DataFrame:
    """These columns behind a generator, which keeps the optimizer from writing their expressions out at every use:
    a dialect's columns are long, and used many times over."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def shapes(rows: DataFrame, head: int = HEAD) -> DataFrame:
    """path -> shape, partial (a malformed line). The first predicate that any of the first records meets decides."""
    t = s("type")
    pos = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    tests: list[tuple[str, Column]] = [
        ("kimi", t.isin("context.append_loop_event", "context.append_message")),
        ("grok-acp", s("params.update.sessionUpdate").isNotNull()),
        ("copilot-cli", t.isin("session.start", "user.message", "assistant.message", "session.shutdown")),
        ("deepseek", t.contains("/")),
        ("vscode-chat-log", ((scalar("kind") == "0") & (has("v.requests") | has("v.sessionId"))) | (is_number("kind") & F.schema_of_variant(v("k")).startswith("ARRAY"))),
        ("pi", (t == "session") & (has("cwd") | has("version"))),
        ("codex-rollout", (t == "session_meta") | (s("payload.type") == "session_meta")),
        ("codex-history", has("session_id") & has("ts") & s("text").isNotNull() & ~has("type")),
        ("antigravity", is_number("step_index") | (has("source") & has("created_at") & has("content"))),
        ("claude", s("uuid").isNotNull() & (v("parentUuid").isNotNull() | has("sessionId"))),
    ]
    talk = F.bool_or(F.coalesce(t.isin("user", "assistant", "gemini"), F.lit(False)))
    good = rows.where("v is not null").withColumn("_n", pos).where(F.col("_n") <= head)
    agg = [F.bool_or(F.coalesce(test, F.lit(False))).alias(f"t{k}") for k, (_, test) in enumerate(tests)]
    agg += [talk.alias("talk"), *(F.bool_or(v(p).isNotNull()).alias(n) for n, p in (("mc", "message.content"), ("mp", "message.parts"), ("c", "content")))]
    agg.append(F.bool_or(F.coalesce((t == "message") & has("message.role"), F.lit(False))).alias("pi2"))
    shape = F.when(F.col("t0"), tests[0][0])
    for k, (name, _) in enumerate(tests[1:], 1):
        shape = shape.when(F.col(f"t{k}"), name)
    shape = shape.when(F.col("talk") & F.col("mc"), "claude").when(F.col("talk") & F.col("mp"), "gemini").when(F.col("talk") & F.col("c"), "claude").when(F.col("pi2"), "pi").otherwise("generic")
    found = good.groupBy("path").agg(*agg).select("path", shape.alias("shape"))
    bad = rows.groupBy("path").agg(F.bool_or(F.col("v").isNull()).alias("partial"))
    return found.join(bad, "path")


#: A dialect projects records to these columns; a null role or content skips the record.
Projection = dict[str, Column]


def _none() -> Projection:
    null = F.lit(None).cast("string")
    return {"role": null, "content": F.lit(None).cast("variant"), "ts": null, "cwd": null, "native": null, "title": null, "began": null}


def pi() -> Projection:
    meta = s("type") == "session"
    return _none() | {"role": F.when(s("type") == "message", s("message.role")), "content": v("message.content"), "ts": scalar("timestamp"), "cwd": F.when(meta, s("cwd")), "native": F.when(meta, scalar("id")), "began": F.when(meta, scalar("timestamp"))}


def claude() -> Projection:
    spoken = s("type").isin("user", "assistant", "system", "gemini", "model") & ~F.coalesce(F.try_variant_get(F.col("v"), "$.isMeta", "boolean"), F.lit(False))
    return _none() | {"role": F.when(spoken, F.coalesce(s("message.role"), s("type"))), "content": F.coalesce(v("message.content"), v("message.parts"), v("content"), v("parts")), "ts": scalar("timestamp"), "cwd": s("cwd"), "native": scalar("sessionId")}


def codex_rollout() -> Projection:
    p = lambda x: F.coalesce(s(f"payload.{x}"), s(x))
    kind, meta = p("type"), (s("type") == "session_meta") | (s("payload.type") == "session_meta")
    item = (kind == "message") | (s("type") == "response_item") | (kind == "response_item")
    role = F.when(meta, None).when(item, p("role")).when((kind == "user_message") & p("message").isNotNull(), "user").when((kind == "agent_message") & p("message").isNotNull(), "assistant")
    content = F.when(item, F.coalesce(v("payload.content"), v("content"))).otherwise(F.coalesce(v("payload.message"), v("message")))
    return _none() | {"role": role, "content": content, "ts": scalar("timestamp"), "cwd": F.when(meta | (s("type") == "turn_context"), p("cwd")), "native": F.when(meta, p("id"))}


def codex_history() -> Projection:
    return _none() | {"role": F.when(s("text").isNotNull(), "user"), "content": v("text"), "ts": scalar("ts")}


def antigravity() -> Projection:
    source = F.lower(strip(F.coalesce(s("source"), s("role"), F.lit(""))))
    role = (
        F.when(source.startswith("user"), "user").when((source == "model") | source.startswith("assistant") | source.startswith("agent"), "assistant")
        .when(source.startswith("tool") | source.startswith("function"), "tool").when(source.startswith("system"), "system").when(F.lower(s("type")).isin(*ROLES), s("type"))
    )
    raw = F.coalesce(s("content"), s("text"))
    meta = F.regexp_extract(raw, r"(?s)<ADDITIONAL_METADATA>(.*?)</ADDITIONAL_METADATA>", 1)
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)<ADDITIONAL_METADATA>.*?</ADDITIONAL_METADATA>", ""), r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", "$1")
    bare = F.regexp_replace(bare, r"</?[A-Z_][A-Z0-9_]*>", "")
    content = F.when(raw.isNotNull(), bare.cast("variant")).otherwise(F.coalesce(v("content"), v("text")))
    return _none() | {"role": role, "content": content, "ts": scalar("created_at", "timestamp"), "cwd": F.coalesce(s("cwd"), F.get_json_object(meta, "$.cwd")), "native": scalar("conversation_id", "conversationId")}


def event_log(sep: str) -> Callable[[], Projection]:
    def project() -> Projection:
        t = F.coalesce(s("type"), F.lit(""))
        head = F.substring_index(t, sep, 1)
        content = F.coalesce(v("data.content"), v("data.message"), v("data.text"), F.when(~has("data"), F.coalesce(v("content"), v("message"), v("text"))))
        return _none() | {
            "role": F.when(head.isin(*EVENT_ROLES), head), "content": content, "ts": scalar("timestamp"), "cwd": F.coalesce(s("data.context.cwd"), s("data.cwd"), s("cwd")),
            "native": scalar("data.sessionId", "data.id", "id", "sessionId"), "title": F.when(t.endswith(f"{sep}title"), s("data.title")), "began": scalar("data.startTime", "data.createdAt", "createdAt", "timestamp"),
        }

    return project


def generic() -> Projection:
    kind = F.lower(F.coalesce(s("type"), s("payload.type"), F.lit("")))
    known = lambda p: F.when(F.lower(s(p)).isin(*ROLES), s(p))
    role = F.coalesce(*map(known, ("role", "message.role", "payload.role", "payload.message.role", "payload.author.role", "author.role")), F.when(kind.isin(*ROLES), kind))
    content = F.coalesce(*map(v, ("content", "message.content", "message.parts", "payload.content", "payload.message.content", "payload.message.parts", "payload.text", "payload.message.text", "text")))
    bare = is_string(F.col("v"))
    return _none() | {
        "role": F.when(bare, "assistant").when(~kind.isin(*NOT_CONVERSATION), role), "content": F.when(bare, F.col("v")).otherwise(content), "ts": scalar("timestamp", "ts", "created_at", "created", "time"),
        "cwd": F.coalesce(s("cwd"), s("payload.cwd"), s("workspace"), s("working_directory")), "native": scalar("sessionId", "session_id", "payload.sessionId", "payload.id", "conversation_id", "id"),
    }


DIALECTS: dict[str, Callable[[], Projection]] = {
    "pi": pi, "claude": claude, "gemini": claude, "codex-rollout": codex_rollout, "codex-history": codex_history, "antigravity": antigravity,
    "copilot-cli": event_log("."), "deepseek": event_log("/"), "generic": generic,
}
#: Dialects whose last working directory counts; of others the first.
LAST_CWD = ("codex-rollout", "grok-acp")


def register_extractor(shape: str, projection: Callable[[], Projection]) -> None:
    DIALECTS[shape] = projection


OUT = ["path", "src_pos", "role", "text", "ts_ms", "tools", "thinking_chars"]


def plain_messages(rows: DataFrame) -> DataFrame:
    """Messages of records (path, shape, pos, v) in dialects with one message per record."""
    columns = {n: None for n in _none()}
    for shape, project in DIALECTS.items():
        for n, c in project().items():
            columns[n] = F.when(F.col("shape") == shape, c) if columns[n] is None else columns[n].when(F.col("shape") == shape, c)
    out = fenced(rows.where(F.col("shape").isin(*DIALECTS)).select("path", "pos", *(columns[n].alias(n) for n in ("role", "content", "ts"))), ["path", "pos", "role", "content", "ts"])
    parts = out.where("role is not null and content is not null").withColumn("p", parts_of(F.col("content")))
    said = fenced(parts, ["path", "pos", "role", "ts", "p"]).where("p.text <> '' or size(p.tools) > 0")
    return said.select("path", F.col("pos").alias("src_pos"), "role", "p.text", epoch_ms(F.col("ts")).alias("ts_ms"), "p.tools", "p.thinking_chars")


def context(rows: DataFrame) -> DataFrame:
    """path -> cwd, native_id, title, started_ms of records (path, shape, pos, v)."""
    columns = {n: None for n in ("cwd", "native", "title", "began")}
    extra = {"grok-acp": lambda: _none() | {"cwd": s("info.cwd"), "native": scalar("info.id")}}
    for shape, project in (DIALECTS | extra).items():
        for n in columns:
            c = project()[n]
            columns[n] = F.when(F.col("shape") == shape, c) if columns[n] is None else columns[n].when(F.col("shape") == shape, c)
    out = fenced(rows.select("path", "pos", "shape", *(c.alias(n) for n, c in columns.items())), ["path", "pos", "shape", *columns])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    cwd = F.when(F.first("shape").isin(*LAST_CWD), F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("pos")))).otherwise(first("cwd"))
    return out.groupBy("path").agg(cwd.alias("cwd"), first("native").alias("native_id"), first("title").alias("title"), epoch_ms(first("began")).alias("started_ms"))


def acp_messages(rows: DataFrame) -> DataFrame:
    """Chunks of one role in a row are one message; chunks keep their own spaces (the reference trims them away)."""
    kind = F.coalesce(s("params.update.sessionUpdate"), F.lit(""))
    role = F.when(kind.startswith("user"), "user").when(kind.startswith("agent"), "assistant")
    content = F.coalesce(v("params.update.content"), v("params.update.text"))
    chunk = F.coalesce(s("params.update.content"), s("params.update.text"), s("params.update.content.text"), parts_of(content)["text"])
    part = rows.where("shape = 'grok-acp'").select("path", "pos", role.alias("role"), chunk.alias("text"), scalar("timestamp").alias("ts")).where("role is not null and text <> ''")
    held = F.array_sort(F.collect_list(F.struct("pos", "text")))
    out = _islands(part).groupBy("path", "i").agg(F.min("pos").alias("src_pos"), F.first("role").alias("role"), F.array_join(F.transform(held, lambda x: x["text"]), "").alias("text"), F.min_by("ts", "pos").alias("ts"))
    return _shaped(out.withColumns({"text": strip(F.col("text")), "ts_ms": epoch_ms(F.col("ts")), "thinking_chars": F.lit(0).cast("long")}))


def _islands(part: DataFrame) -> DataFrame:
    """Numbers runs of one role within a path."""
    by = Window.partitionBy("path").orderBy("pos")
    flagged = part.withColumn("_new", F.coalesce(F.col("role") != F.lag("role").over(by), F.lit(True)).cast("int"))
    return flagged.withColumn("i", F.sum("_new").over(by)).drop("_new")


def kimi_messages(rows: DataFrame) -> DataFrame:
    """Whole user messages; an assistant's streamed parts are one message up to the next user turn or tool call."""
    own = rows.where("shape = 'kimi'")
    whole = s("type") == "context.append_message"
    role = F.lower(F.coalesce(s("message.role"), F.lit("")))
    content = F.when(whole, v("message.content")).when(s("type") == "context.append_loop_event", v("event.part"))
    who = F.when(whole & role.isin("user", "human"), "user").otherwise("assistant")
    part = own.select("path", "pos", who.alias("who"), parts_of(content).alias("p"), scalar("time", "timestamp").alias("ts"), content.isNotNull().alias("ok")).where("ok")
    calls = F.size("p.tools") > 0
    # A user turn, a call, and what follows a call each begin a run of their own.
    part = part.withColumn("role", F.concat("who", F.when((F.col("who") == "user") | calls, F.col("pos").cast("string")).otherwise("")))
    held = F.array_sort(F.collect_list(F.when(F.col("p.text") != "", F.struct("pos", "p.text"))))
    out = _islands(part).groupBy("path", "i").agg(
        F.min("pos").alias("src_pos"), F.first("who").alias("role"), F.array_join(F.transform(held, lambda x: x["text"]), "\n").alias("text"), F.min_by("ts", "pos").alias("ts"),
        F.flatten(F.collect_list("p.tools")).alias("tools"), F.sum("p.thinking_chars").alias("thinking_chars"),
    )
    return _shaped(out.withColumn("ts_ms", F.when(F.col("role") == "user", epoch_ms(F.col("ts")))))


def _shaped(rows: DataFrame) -> DataFrame:
    if "tools" not in rows.columns:
        rows = rows.withColumn("tools", F.array().cast("array<struct<name: string, input: string>>"))
    return rows.where("text <> '' or size(tools) > 0").select(OUT)


def read_jsonl(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages by path, context by path with shape and partial) of files (path, content)."""
    rows = records(files)
    return read_records(rows, shapes(rows))


def read_records(rows: DataFrame, shape: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of records and their files' shapes."""
    known = rows.where("v is not null").join(shape.select("path", "shape"), "path")
    messages = plain_messages(known).unionByName(acp_messages(known)).unionByName(kimi_messages(known))
    return messages, shape.join(context(known), "path", "left")
