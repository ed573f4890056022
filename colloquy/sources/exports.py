"""Web exports: conversation trees and per-line conversations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import epoch_ms, number_ms
from .content import with_parts
from .jsonl import is_string, s, scalar, v

_TOOLS = "array<struct<name: string, input: string>>"


def path_through(mapping: dict, current: str | None) -> list[str]:
    """Node ids from the root to the shown leaf: up from current, or down each node's last child if there is none."""
    chain: list[str] = []
    if current in mapping:
        seen: set[str] = set()
        node = current
        while node in mapping and node not in seen:
            seen.add(node)
            chain.append(node)
            node = mapping[node].get("parent")
        return chain[::-1]
    roots = [k for k, n in mapping.items() if not n.get("parent") or n["parent"] not in mapping]
    node, seen = (roots[0] if roots else None), set()
    while node in mapping and node not in seen:
        seen.add(node)
        chain.append(node)
        children = [c for c in mapping[node].get("children") or [] if c in mapping]
        node = children[-1] if children else None
    return chain


def tree_messages(docs: DataFrame) -> DataFrame:
    """Messages of an export whose conversations are trees: docs (path, v) with an array of {mapping, current_node}.

    The shown branch is a walk over one conversation's tree, which is a small helper; everything else is expressions.
    """
    talks = docs.select("path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("n", "c"))
    talks = talks.withColumn("native_id", F.coalesce(s("conversation_id", "c"), s("id", "c"), F.col("n").cast("string")))

    @F.pandas_udf("array<string>")
    def shown(trees: pd.Series) -> pd.Series:
        out = []
        for t in trees:
            tree = json.loads(t)
            mapping = tree.get("mapping") or {}
            nodes = [mapping[k].get("message") for k in path_through(mapping, tree.get("current_node"))]
            out.append([json.dumps(m, ensure_ascii=False) for m in nodes if m])
        return pd.Series(out)

    rows = talks.select("path", "native_id", s("title", "c").alias("title"), F.posexplode(shown(F.to_json("c"))).alias("pos", "j")).withColumn("v", F.try_parse_json("j"))
    role, hidden = s("author.role"), F.coalesce(F.try_variant_get("v", "$.metadata.is_visually_hidden_from_conversation", "boolean"), F.lit(False))
    rows = with_parts(rows.where(role.isin("user", "assistant") & ~hidden), F.coalesce(v("content.parts"), v("content.text"), v("content")))
    return rows.where("p.text <> ''").select(
        F.concat_ws("#", "path", "native_id").alias("path"), "native_id", "title", F.col("pos").cast("long").alias("src_pos"), role.alias("role"), "p.text",
        number_ms(F.try_variant_get("v", "$.create_time", "double")).alias("ts_ms"), "p.tools", "p.thinking_chars",
    )


def line_messages(records: DataFrame) -> DataFrame:
    """Messages of an export with one conversation per line: records (path, pos, v) with chat_messages."""
    talks = records.where("v is not null").withColumn("native_id", F.coalesce(scalar("uuid", "id"), F.col("pos").cast("string")))
    rows = talks.select("path", "native_id", F.coalesce(s("name"), s("title")).alias("title"), F.posexplode(F.try_variant_get("v", "$.chat_messages", "array<variant>")).alias("pos", "m"))
    role = F.when(s("sender", "m") == "human", "user").otherwise(F.coalesce(s("sender", "m"), s("role", "m")))
    plain = F.when(is_string(v("text", "m")) & (s("text", "m") != ""), v("text", "m"))
    rows = with_parts(rows, F.coalesce(plain, v("content", "m")))
    return rows.where("p.text <> ''").select(
        F.concat_ws("#", "path", "native_id").alias("path"), "native_id", "title", F.col("pos").cast("long").alias("src_pos"), role.alias("role"), "p.text",
        epoch_ms(F.try_variant_get("m", "$.created_at", "string")).alias("ts_ms"), "p.tools", "p.thinking_chars",
    )
