"""JSON documents: one variant per file, dispatched by which key holds an array, exploded into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import epoch_ms
from .content import with_parts
from .jsonl import OUT, is_string, s, scalar, v

#: An array is one of messages if so many of its elements have a role or a type.
LEAST_SHARE = 0.6


def _array(path: str, of: str = "v") -> Column:
    """The elements of an array at a path, else null."""
    x = F.try_variant_get(F.col(of), path, "variant")
    return F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(F.col(of), path, "array<variant>"))


def _first_array(*keys: str) -> Column:
    return F.coalesce(*(_array(f"$.{k}") for k in keys))


def kinds(docs: DataFrame) -> DataFrame:
    """docs (path, harness, v) with ``kind``: gemini, vscode, continue, thread, messages or null, and ``items``."""
    asks = _first_array("requests", "turns")
    top = _array("$")
    talks = lambda xs: F.size(F.filter(xs, lambda m: F.coalesce(F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.type", "string")).isNotNull())) >= LEAST_SHARE * F.size(xs)
    many = lambda xs: F.coalesce((F.size(xs) > 0) & talks(xs), F.lit(False))
    history, thread = _array("$.history"), _first_array("messages", "thread", "items")
    gemini = _first_array("messages", "history")
    kind = (
        F.when((F.col("harness") == "gemini") & gemini.isNotNull(), "gemini").when(asks.isNotNull(), "vscode").when(history.isNotNull(), "continue")
        .when(thread.isNotNull(), "thread").when(many(top), "messages")
    )
    items = F.when(kind == "gemini", gemini).when(kind == "vscode", asks).when(kind == "continue", history).when(kind == "thread", thread).when(kind == "messages", top)
    return docs.withColumns({"kind": kind, "items": items})


def _response(path: str) -> Column:
    """A VS Code answer: its string, or its parts' values joined by blank lines."""
    one = lambda x: F.coalesce(F.when(is_string(x), F.try_variant_get(x, "$", "string")), *(F.when(is_string(F.try_variant_get(x, f"$.{k}", "variant")), F.try_variant_get(x, f"$.{k}", "string")) for k in ("value", "text", "content")))
    return F.coalesce(s(path, "m"), F.array_join(F.filter(F.transform(_array(f"$.{path}", "m"), one), lambda t: F.coalesce(t != "", F.lit(False))), "\n\n"))


def read_json(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages by path, context by path) of docs (path, harness, v)."""
    held = kinds(docs).where("kind is not null")
    items = held.select("path", "kind", F.posexplode("items").alias("pos", "m"))
    pairs = items.where("kind = 'vscode'")
    asked = F.coalesce(s("message.text", "m"), s("message.value", "m"), s("request.message", "m"), s("message", "m"))
    stamp = F.try_variant_get("m", "$.timestamp", "string")
    turns = F.array(F.struct(F.lit("user").alias("role"), asked.alias("text")), F.struct(F.lit("assistant").alias("role"), F.coalesce(F.nullif(_response("response"), F.lit("")), _response("responses")).alias("text")))
    vscode = pairs.select("path", "pos", stamp.alias("ts"), F.posexplode(turns).alias("k", "t")).where("t.text <> ''")
    vscode = vscode.select("path", (F.col("pos") * 2 + F.col("k")).cast("long").alias("src_pos"), "t.role", "t.text", epoch_ms(F.col("ts")).alias("ts_ms"), F.array().cast("array<struct<name: string, input: string>>").alias("tools"), F.lit(0).cast("long").alias("thinking_chars"))

    at = lambda *ps: F.coalesce(*(v(p, "m") for p in ps))
    text = lambda *ps: F.coalesce(*(F.try_variant_get("m", f"$.{p}", "string") for p in ps))
    kind = F.col("kind")
    role = (
        F.when(kind == "gemini", F.when(s("type", "m") == "gemini", "assistant").when(s("type", "m") == "user", "user").otherwise(s("role", "m")))
        .when(kind == "continue", F.coalesce(s("message.role", "m"), s("role", "m"))).when(kind == "thread", F.coalesce(s("role", "m"), s("author.role", "m"), s("type", "m"))).otherwise(s("role", "m"))
    )
    content = F.when(kind == "continue", at("message.content", "message.parts", "content", "parts")).when(kind == "thread", at("content", "text", "message")).otherwise(at("content", "parts", "text"))
    said = items.where("kind <> 'vscode'").select("path", F.col("pos").cast("long").alias("src_pos"), role.alias("role"), text("timestamp", "created", "ts").alias("ts"), content.alias("content"))
    said = with_parts(said, F.col("content")).where("p.text <> '' or size(p.tools) > 0")
    said = said.select("path", "src_pos", "role", "p.text", epoch_ms(F.col("ts")).alias("ts_ms"), "p.tools", "p.thinking_chars")
    meta = held.select(
        "path", F.coalesce(s("workspaceDirectory"), s("workspace.workspaceLocation"), s("workspaceFolder.folderUri"), s("workspaceUri")).alias("cwd"), scalar("sessionId", "id").alias("native_id"),
        F.coalesce(s("customTitle"), s("title")).alias("title"), epoch_ms(scalar("creationDate", "startTime", "created", "createdAt")).alias("started_ms"),
    )
    return vscode.unionByName(said).select(OUT), meta
