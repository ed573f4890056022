"""Transcripts, payloads, slices and digests: bounded texts made of turns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import clip, code_blocks, duration, indent, middle_cut, middle_out, strip, strip_end

#: Fixed values.
USER_CHARS, ASSISTANT_CHARS, FINAL_CHARS, TOOL_ARG_CHARS, COMMAND_CHARS = 4000, 700, 3000, 90, 120
PATH_KEYS = ("file_path", "filePath", "path", "filename", "file", "notebook_path", "target_file", "absolute_path")
COMMAND_KEYS, SEARCH_KEYS = ("command", "cmd", "script"), ("pattern", "query", "glob", "regex")
WRITE_TOOLS = r"(?i)write|edit|create|patch|apply|insert|replace|str_replace|notebook_edit|multi_edit"
READ_TOOLS = r"(?i)read|view|cat|open|show|load|fetch_file"
SEARCH_TOOLS = r"(?i)grep|search|find|glob|list|ls|ripgrep|semantic"
PROSE_PATH = r"""(?:^|[\s`'"(])((?:[A-Za-z]:[\\/])?[A-Za-z0-9_.-]+(?:[\\/][A-Za-z0-9_.-]+)+\.[A-Za-z0-9]{1,6})(?::\d+)?"""
PAYLOAD_CHARS, PAYLOAD_MESSAGES = 24_000, 120
SLICE_CHARS, CONTEXT_CHARS, CONTEXT_SHARE, MARKER_ROOM, LEAST_BODY = 12_000, 1200, 0.3, 80, 120
DIGEST_CHARS, HEADER_CHARS, OVERHEAD = 24_000, 900, 400

def _session() -> WindowSpec:
    return Window.partitionBy("session_id")



def picked(input_json: Column, keys: tuple[str, ...]) -> Column:
    """The first of these keys that holds a string that isn't blank."""
    parsed = F.try_parse_json(input_json)
    one = lambda k: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING", strip(F.try_variant_get(parsed, f"$.{k}", "string")))
    return F.coalesce(*(F.nullif(one(k), F.lit("")) for k in keys))


def tool_summary(tools: Column) -> Column:
    """`` | tools: name(argument), name``, or nothing."""
    def one(t):
        arg = picked(t["input"], PATH_KEYS + COMMAND_KEYS + SEARCH_KEYS)
        return F.when(arg.isNull(), t["name"]).otherwise(F.concat(t["name"], F.lit("("), F.substring(F.substring_index(arg, "\n", 1), 1, TOOL_ARG_CHARS), F.lit(")")))

    return F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, F.concat(F.lit(" | tools: "), F.array_join(F.transform(tools, one), ", "))).otherwise("")


def rendered_turns(turns: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """turns with ``line``, their part of a transcript; null for system and tool turns. The last assistant turn of each
    scope (the session, or a topic) may be longer."""
    by = Window.partitionBy(*(scope or ["session_id"]))
    last = F.max(F.when(F.col("role") == "assistant", F.col("msg_idx"))).over(by)
    stamp = F.coalesce(F.date_format(F.timestamp_millis("ts_ms"), "HH:mm"), F.lit(""))
    head = lambda who: F.concat(F.lit("[turn "), F.col("msg_idx").cast("string"), F.lit(f"] {who} "), stamp)
    body = F.when(F.col("msg_idx") == last, clip(F.col("text"), FINAL_CHARS, True)).otherwise(clip(F.col("text"), ASSISTANT_CHARS, True))
    blocks = F.slice(code_blocks(F.col("text")), 1, 2)
    code = F.when((F.size(blocks) > 0) & ~body.contains("```"), F.concat(F.lit("\n  code from this turn:\n"), F.array_join(F.transform(blocks, lambda b: indent(b, 4)), "\n"))).otherwise("")
    user = F.concat(head("USER"), F.lit("\n"), indent(clip(F.col("text"), USER_CHARS, True)), F.lit("\n"))
    assistant = F.concat(head("ASSISTANT"), tool_summary(F.col("tools")), F.lit("\n"), indent(body), code, F.lit("\n"))
    return turns.withColumn("line", F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant))


def ordered_text(lines: Column, order: Column, sep: str = "\n") -> Column:
    """An aggregate: lines in order, nulls left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(lines.isNotNull(), F.struct(order.alias("o"), lines.alias("x"))))), lambda p: p["x"]), sep)


def transcripts(turns: DataFrame) -> DataFrame:
    return rendered_turns(turns).groupBy("session_id").agg(strip(ordered_text(F.col("line"), F.col("msg_idx"))).alias("transcript"))


def payload(turns: DataFrame, max_chars: int = PAYLOAD_CHARS, max_messages: int = PAYLOAD_MESSAGES) -> DataFrame:
    """The turns of each session's quiz payload: both ends of a long session, each text capped, up to the first turn
    that no longer fits (the first turn always does)."""
    each = max(600, min(4000, max_chars // 6))
    total = F.count("*").over(_session())
    ends = (total <= max_messages) | (F.col("msg_idx") < max_messages // 3) | (F.col("msg_idx") >= total - -(-max_messages * 2 // 3))
    capped = F.when(F.length("text") > each, F.concat(F.substring("text", 1, each), F.lit("…"))).otherwise(F.col("text"))
    rows = turns.withColumns({"message_count": total, "_keep": ends}).where("_keep").drop("_keep")
    by = _session().orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("text", capped)
    # Used characters only grow, so what comes after an overflow overflows as well, but for the first turn.
    rows = rows.withColumns({"used": F.sum(F.length("text")).over(by), "_place": F.row_number().over(_session().orderBy("msg_idx"))})
    over = F.max(F.when((F.col("used") > max_chars) & (F.col("_place") > 1), 1).otherwise(0)).over(by)
    return rows.withColumn("_over", over).where("_over = 0").select("session_id", "msg_idx", "role", "text", "used", "message_count")


def preceding_context(turns: DataFrame, topics: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """session_id, topic_id -> context: the user turn before each topic and the conclusion after it; empty for the first."""
    so_far = _session().orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    user = F.col("role") == "user"
    last_user = F.last(F.when(user, F.struct("msg_idx", "text")), ignorenulls=True).over(so_far)
    last_answer = F.last(F.when(F.col("role") == "assistant", F.struct("msg_idx", "text")), ignorenulls=True).over(so_far)
    at = turns.select("session_id", F.col("msg_idx").alias("msg_from"), last_user.alias("u"), last_answer.alias("a"))
    rows = topics.join(at, ["session_id", "msg_from"], "left")
    head = "--- PRECEDING CONTEXT (background from earlier in the same session; not part of this topic) ---\n"
    part = lambda who, m, share: F.concat(F.lit("\n[turn "), m["msg_idx"].cast("string"), F.lit(f"] {who} (earlier)\n"), clip(strip(m["text"]), int(budget * share)), F.lit("\n"))
    answer = F.when(F.col("a.msg_idx") > F.col("u.msg_idx"), part("ASSISTANT", F.col("a"), 0.5)).otherwise("")
    whole = F.concat(F.lit(head), part("USER", F.col("u"), 0.35), answer)
    cut = F.when(F.length(whole) > budget, F.concat(F.substring(whole, 1, budget), F.lit("\n… (earlier context truncated)\n\n"))).otherwise(whole)
    return rows.select("session_id", "topic_id", F.when(F.col("u").isNull(), "").otherwise(F.concat(cut, F.lit("\n"))).alias("context"))


def topic_slices(turns: DataFrame, topics: DataFrame, max_chars: int = SLICE_CHARS, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """A bounded text per kept topic: context, header and rendered turns within max_chars.

    A topic that is a range of characters of one message has just these as its body; one that begins or ends within a
    message has that message cut before it is rendered.
    """
    kept = topics.where("kept")
    kept = kept.withColumns({c: F.lit(None).cast("int") for c in ("char_from", "char_to") if c not in topics.columns})
    context = preceding_context(turns, kept, min(context_chars, int(max_chars * CONTEXT_SHARE)))
    inside = turns.join(kept.select("session_id", "topic_id", "msg_from", "msg_to", "char_from", "char_to"), "session_id").where("msg_idx between msg_from and msg_to")
    start = F.when(F.col("msg_idx") == F.col("msg_from"), F.coalesce("char_from", F.lit(0))).otherwise(0)
    stop = F.when(F.col("msg_idx") == F.col("msg_to"), F.coalesce("char_to", F.length("text"))).otherwise(F.length("text"))
    inside = inside.withColumn("text", F.substr("text", start + 1, stop - start))
    part = F.col("char_from").isNotNull() & (F.col("msg_from") == F.col("msg_to"))
    lines = rendered_turns(inside, ["session_id", "topic_id"]).withColumn("line", F.when(part, F.col("text")).otherwise(F.col("line")))
    body = lines.groupBy("session_id", "topic_id").agg(strip(ordered_text(F.col("line"), F.col("msg_idx"))).alias("body"))
    rows = kept.join(body, ["session_id", "topic_id"]).join(context, ["session_id", "topic_id"])
    header = F.concat(F.lit("--- TOPIC: "), F.col("label"), F.lit(" (turns "), F.col("msg_from").cast("string"), F.lit("-"), F.col("msg_to").cast("string"), F.lit(") ---\n\n"))
    room = F.greatest(F.lit(LEAST_BODY), F.lit(max_chars) - F.length(header) - F.length("context") - MARKER_ROOM)
    omitted = F.greatest(F.length("body") - room, F.lit(0))
    cut = F.when(omitted > 0, F.concat(F.substr("body", F.lit(1), room), F.lit("\n… ("), omitted.cast("string"), F.lit(" chars of this topic omitted)"))).otherwise(F.col("body"))
    text = F.concat("context", header, cut)
    return rows.select("session_id", "topic_id", "label", text.alias("text"), F.length(text).alias("chars"), F.length("context").alias("context_chars"), omitted.alias("truncated"))


def slice_stats(slices: DataFrame, max_chars: int = SLICE_CHARS) -> DataFrame:
    """Per session: how many prompts, their characters together and at most, how many were cut, and the bound of each."""
    return slices.groupBy("session_id").agg(
        F.count("*").alias("prompt_count"), F.sum("chars").alias("slice_chars"), F.max("chars").alias("largest_slice"), F.count_if(F.col("truncated") > 0).alias("cut_slices"), F.lit(max_chars).alias("max_chars_per_prompt"),
    )


def touched(turns: DataFrame) -> DataFrame:
    """session_id, kind (edited, read, searched, ran, mentioned), value, times, first_seen: what tools and prose touched."""
    calls = turns.select("session_id", "msg_idx", F.posexplode("tools").alias("p", "t")).withColumn("seen", F.col("msg_idx").cast("long") * 1000 + F.col("p"))
    name = F.col("t.name")
    path, command, query = (picked(F.col("t.input"), keys) for keys in (PATH_KEYS, COMMAND_KEYS, SEARCH_KEYS))
    path = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    found = F.array(
        F.when(path.isNotNull() & (F.length(path) <= 240) & name.rlike(WRITE_TOOLS), F.struct(F.lit("edited").alias("kind"), path.alias("value"))),
        F.when(path.isNotNull() & (F.length(path) <= 240) & ~name.rlike(WRITE_TOOLS) & name.rlike(READ_TOOLS), F.struct(F.lit("read").alias("kind"), path.alias("value"))),
        F.when(command.isNotNull(), F.struct(F.lit("ran").alias("kind"), F.substring(F.substring_index(command, "\n", 1), 1, COMMAND_CHARS).alias("value"))),
        F.when(query.isNotNull() & name.rlike(SEARCH_TOOLS), F.struct(F.lit("searched").alias("kind"), F.substring(query, 1, 80).alias("value"))),
    )
    used = calls.select("session_id", "seen", F.explode(F.array_compact(found)).alias("f")).select("session_id", "seen", "f.kind", "f.value")
    prose = F.regexp_extract_all("text", F.lit(PROSE_PATH), F.lit(1))
    said = turns.where("role = 'assistant'").select("session_id", F.col("msg_idx").cast("long").alias("m"), F.posexplode(prose).alias("p", "v"))
    said = said.select("session_id", (F.col("m") * 1000 + F.col("p")).alias("seen"), F.lit("mentioned").alias("kind"), F.translate("v", "\\", "/").alias("value")).where("not startswith(value, 'http') and length(value) <= 240")
    return used.unionByName(said).groupBy("session_id", "kind", "value").agg(F.count("*").alias("times"), F.min("seen").alias("first_seen"))


def relevant_paths(found: DataFrame) -> DataFrame:
    """Edited paths by touches, then read ones, each once."""
    first = F.when(F.col("kind") == "edited", 0).otherwise(1)
    rows = found.where("kind in ('edited', 'read')").select("session_id", F.struct(first.alias("k"), (-F.col("times")).alias("n"), "first_seen", "value").alias("e"))
    return rows.groupBy("session_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["value"])).alias("relevant"))


def digests(turns: DataFrame, sessions: DataFrame, budget: int = DIGEST_CHARS, hard_max: int | None = None) -> DataFrame:
    """A bounded digest per session: header, then the transcript with its middle cut out; text never passes hard_max.

    The project section needs a work tree and a git history and isn't part of this engine.
    """
    c = F.col
    lines = [
        F.lit("# Session digest\n"), F.concat(F.lit("title:      "), c("title")),
        F.concat(F.lit("started:    "), F.coalesce(F.date_format(F.timestamp_millis("started_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("unknown"))),
        F.concat(F.lit("duration:   "), duration(c("updated_ms") - c("started_ms"))),
        F.format_string("turns:      %d messages (%d user, %d assistant)", c("messages"), c("user_turns"), c("messages") - c("user_turns")),
        F.concat(F.lit("tool calls: "), c("tool_calls").cast("string")),
        F.concat(F.lit("omitted:    "), F.format_number("reasoning_chars", 0), F.lit(" chars of model reasoning, and all tool output bodies")),
    ]
    header = clip(F.concat_ws("\n", *lines), HEADER_CHARS, True)
    room = max(200, budget - HEADER_CHARS - OVERHEAD)
    rows = sessions.join(ends(turns, room), "session_id")
    text = F.concat(header, F.lit("\n\n## Conversation\n\n"), c("conversation"))
    if hard_max:
        text = F.when(F.length(text) > hard_max, F.concat(F.substring(text, 1, max(0, hard_max - 80)), F.lit("\n\n… (hard limit reached: "), (F.length(text) - hard_max).cast("string"), F.lit(" chars omitted)"))).otherwise(text)
    return rows.select("session_id", text.alias("text"), F.length(text).alias("chars"), F.greatest(c("transcript_chars") - F.length("conversation"), F.lit(0)).cast("int").alias("omitted"))


def ends(turns: DataFrame, most: int) -> DataFrame:
    """session_id, transcript_chars, conversation: each transcript with its middle cut out, so that at most so many characters
    stay. Running sums tell from each turn's place whether any of it stays; only such turns are put together, so no cell
    holds more than the room and a turn at either end of it."""
    c = F.col
    head, tail = middle_cut(most)
    lines = rendered_turns(turns).where("line is not null").select("session_id", "msg_idx", "line")
    whole = Window.partitionBy("session_id")
    by = whole.orderBy("msg_idx")
    # A line and the break behind it; behind the last one, what trimming takes off is no part of the transcript.
    lines = lines.withColumn("_last", F.lead("msg_idx").over(by).isNull()).withColumn("_n", F.when(c("_last"), F.length(strip_end(c("line")))).otherwise(F.length("line") + 1).cast("long"))
    lines = lines.withColumns({"_end": F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(whole)})
    fits, first, second = c("_all") <= most, c("_end") - c("_n") < head, c("_end") > c("_all") - tail
    kept = lines.where(fits | first | second).groupBy("session_id").agg(
        F.first("_all").alias("transcript_chars"), ordered_text(F.when(fits | first, c("line")), c("msg_idx")).alias("_a"), ordered_text(F.when(~fits & second, c("line")), c("msg_idx")).alias("_b")
    )
    return kept.select("session_id", "transcript_chars", F.when(c("transcript_chars") <= most, strip(c("_a"))).otherwise(middle_out(c("_a"), strip_end(c("_b")), c("transcript_chars"), head, tail)).alias("conversation"))
