"""Queries over the smaller parts: texts, paths, tools, validation, the store's tables, lists. Each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import normalize, quiz, render, reports, store
from .oracle import _quote, _strip, _strip_end

c = F.col


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def statements(spark, sf_dir):
    """What documents without a user's words are about."""
    return load(spark, sf_dir, "documents").select("doc_id", text.statement_of(c("text"), c("doc_id") + 1).alias("statement"))


def middles_cut(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clip_middle(c("text"), 400).alias("text"))


def durations(spark, sf_dir):
    """Times since a user's event before, and how long ago an event was at the end of 2030."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(c("ts").cast("timestamp"))
    ev = load(spark, sf_dir, "events").withColumn("ms", ms)
    return ev.select("event_id", text.duration(c("ms") - F.lag("ms").over(by)).alias("gap"), text.time_ago(F.lit(1_924_905_600_000), c("ms")).alias("ago"))


def code_fences(spark, sf_dir):
    """Fenced blocks of documents that have one put in, some of them with a language; long ones don't count."""
    fenced = F.concat(F.lit("before\n```"), F.when(c("doc_id") % 2 == 0, "py").otherwise(""), F.lit("\n"), text.strip(c("text")), F.lit("\n```\nafter"))
    found = load(spark, sf_dir, "documents").where("not contains(text, '```')").select("doc_id", text.code_blocks(fenced).alias("b"))
    return found.select("doc_id", F.size("b").alias("blocks"), F.get("b", F.lit(0)).alias("first"))


def text_entropy(spark, sf_dir):
    """Of items of the benchmark."""
    return load(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.round(text.entropy(c("text")), 6).alias("entropy"))


def gap_splits(spark, sf_dir):
    """Every sixth word of an item is a gap."""
    words = F.split("text", " ")
    gapped = F.array_join(F.transform(words, lambda w, i: F.when(i % 6 == 5, F.concat(F.lit("{{blank_"), (F.floor(i / 6) + 1).cast("string"), F.lit("}}"))).otherwise(w)), " ")
    keys, between = text.gap_parts(gapped)
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(keys, ",").alias("keys"), F.size(between).alias("parts"), F.array_join(between, "|").alias("between"))


def json_replies(spark, sf_dir):
    """Replies bare, in a fence, in prose, and broken."""
    body = F.to_json(F.struct(c("item_id").alias("id"), "text"))
    k = c("item_id") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is "), body, F.lit(" as asked"))).otherwise(F.concat(F.lit("{oops "), body))
    v = text.json_of(reply)
    return load(spark, sf_dir, "benchmark").select("item_id", F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.text", "string").alias("text"))


def environment_lines(spark, sf_dir):
    lines = F.concat(F.lit("# made\nexport A="), c("c_name"), F.lit("\nB = \""), c("c_mktsegment"), F.lit("\"\nbroken line\nA="), c("c_custkey").cast("string"))
    m = text.env_map(lines)
    return load(spark, sf_dir, "customer").select("c_custkey", F.size(m).alias("n"), m["A"].alias("a"), m["B"].alias("b"))


def project_names(spark, sf_dir):
    """Projects of working directories made of nations, regions and suppliers, some of them encoded as folder names."""
    s = load(spark, sf_dir, "supplier")
    low = F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", ""))
    path = F.concat(F.lit("/home/u"), c("s_nationkey").cast("string"), F.lit("/work/"), low, F.when(c("s_suppkey") % 3 == 0, "/src").otherwise(""))
    return s.select(
        "s_suppkey", paths.project_of_path(path).alias("project"), paths.project_of_encoded(F.concat(F.lit("-home-"), low, F.lit("-x"))).alias("encoded"), paths.basename(path).alias("base"),
        paths.relative_to_root(F.concat(path, F.lit("/a/b.py")), path).alias("below"), paths.relative_to_root(F.lit("/etc/x"), path).alias("outside"),
    )


def _tool_turns(spark, sf_dir) -> DataFrame:
    """Users' events as assistant turns with a tool call: edits, reads, commands and searches of a few files."""
    k, number = c("event_id") % 4, F.concat(F.lit("f"), (c("event_id") % 11).cast("string"))
    name = F.when(k == 0, "Edit").when(k == 1, "read_file").when(k == 2, "shell").otherwise("grep")
    given = F.when(k <= 1, F.to_json(F.struct(F.concat(F.lit("./src/"), number, F.lit(".py")).alias("file_path")))).when(k == 2, F.to_json(F.struct(F.concat(F.lit("run "), number, F.lit("\nmore")).alias("command")))).otherwise(F.to_json(F.struct(number.alias("pattern"))))
    said = F.when(c("event_id") % 5 == 0, F.concat(F.lit("see lib/"), number, F.lit(".js and more"))).otherwise("done")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = load(spark, sf_dir, "events")
    return ev.select(c("user_id").cast("string").alias("session_id"), (F.row_number().over(by) - 1).alias("msg_idx"), F.lit("assistant").alias("role"), said.alias("text"), F.array(F.struct(name.alias("name"), given.alias("input"))).alias("tools"))


def touched_things(spark, sf_dir):
    return render.touched(_tool_turns(spark, sf_dir)).select("session_id", "kind", "value", "times")


def relevant_files(spark, sf_dir):
    found = render.relevant_paths(render.touched(_tool_turns(spark, sf_dir)))
    return found.select("session_id", F.array_join("relevant", ",").alias("relevant"))


def tool_calls(spark, sf_dir):
    return reports.tool_counts(_tool_turns(spark, sf_dir))


def listed_sessions(spark, sf_dir):
    """Customers' orders as sessions: the finished ones of a priority, newest first."""
    o = load(spark, sf_dir, "orders").select(c("o_orderkey").alias("session_id"), c("o_orderpriority").alias("harness"), F.unix_date(c("o_orderdate").cast("date")).alias("updated_ms"), (c("o_orderstatus") == "F").alias("quiz_ready"))
    found = reports.session_list(o, "1-URGENT", ready_only=True)
    return found.select("session_id", "updated_ms", F.row_number().over(Window.orderBy(F.desc_nulls_last("updated_ms"), "session_id")).alias("place"))


def newest_quizzes(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(c("o_custkey").alias("session_id"), c("o_orderkey").alias("quiz_id"), F.unix_date(c("o_orderdate").cast("date")).alias("created_at"))
    return store.newest(o, "session_id", "created_at", "quiz_id").select("session_id", "quiz_id")


def replaced_coverage(spark, sf_dir):
    """Order lines as coverage: orders divisible by three get one new range; what each covers then."""
    old = load(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("quiz_id"), c("l_linenumber").cast("int").alias("range_from"), (c("l_linenumber") + F.floor(c("l_quantity"))).cast("int").alias("range_to"))
    new = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("quiz_id"), F.lit(0).alias("range_from"), F.lit(5).alias("range_to"))
    return store.covered_messages(store.replace_group(old, new, "quiz_id"))


def deleted_quizzes(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(c("o_orderkey").alias("quiz_id"), c("o_custkey").alias("session_id"))
    return store.delete_keys(o, load(spark, sf_dir, "lineitem").where("l_quantity > 40").select(c("l_orderkey").alias("quiz_id")), "quiz_id")


def attempt_progress(spark, sf_dir):
    """Orders as attempts: lines are answers, prices are scores."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct(c("l_linenumber").cast("string").alias("k"), F.lit("x").alias("v"))))).alias("answers"))
    o = load(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    attempts = o.select(c("o_orderkey").alias("quiz_id"), (c("o_orderkey") % 4).cast("int").alias("position"), "answers", F.when(c("o_orderstatus") == "F", 1).cast("long").alias("completed_at"), (c("o_orderkey") % 7).cast("double").alias("score"), (c("o_orderkey") % 3 * 4).cast("double").alias("max_score"), F.lit(None).cast("long").alias("updated_at"), F.lit(9).cast("long").alias("started_at"))
    return store.progress(attempts)


def validated_questions(spark, sf_dir):
    """Replies made of order lines: choices with and without a right key, gaps with and without an answer, open questions."""
    n, part = c("l_linenumber"), c("l_partkey") % 4
    option = lambda k: F.struct(F.lit(k).alias("key"), F.concat(F.lit(f"option {k} "), n.cast("string")).alias("text"))
    null = lambda t: F.lit(None).cast(t)
    kind = F.when(part <= 1, "mcq").when(part == 2, "cloze").otherwise("open")
    q = F.struct(
        kind.alias("type"), F.when(n == 7, " ").otherwise(F.concat(F.lit(" why "), n.cast("string"))).alias("prompt"), F.array(n.cast("int"), (n + 3).cast("int")).alias("sourceTurns"),
        F.when(part <= 1, F.array(option("A"), option("B"))).alias("options"), F.when(part == 0, "B").when(part == 1, "Z").alias("correctOptionKey"), F.when(part == 2, F.lit("x = {{blank_1}} + {{blank_2}}")).alias("codeWithGaps"),
        F.when(part == 2, F.when(n % 2 == 0, F.array(F.struct(F.lit("blank_1").alias("key"), F.lit("1").alias("answer")), F.struct(F.lit("blank_2").alias("key"), F.lit("2").alias("answer")))).otherwise(F.array(F.struct(F.lit("blank_1").alias("key"), F.lit("1").alias("answer"))))).alias("blanks"),
        F.when((part == 3) & (n > 2), F.array(F.struct(F.lit("names it").alias("criterion"), null("double").alias("weight")))).alias("rubric"),
    )
    replies = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("o"), part.alias("p"), F.to_json(q).alias("j")))).alias("x"))
    body = F.concat(F.lit('{"questions":['), F.array_join(F.transform("x", lambda e: e["j"]), ","), F.lit("]}"))
    results = replies.select(c("l_orderkey").alias("session_id"), F.lit("t1").alias("topic_id"), F.lit("L").alias("label"), F.lit(2).alias("msg_from"), F.lit(6).alias("msg_to"), F.array(F.lit("mcq"), F.lit("cloze"), F.lit("open")).alias("types"), body.alias("json"))
    found = quiz.validated(results)[0]
    return found.select("session_id", "question_id", "type", "prompt", F.array_join(F.transform("source_turns", lambda x: x.cast("string")), ",").alias("turns"), "correct_key", "issue")


def clean_messages(spark, sf_dir):
    """Documents and users' tool output as messages: empty ones and tools' go, roles are normalised, texts trimmed."""
    role = F.element_at(F.array(*map(F.lit, ("human", "Assistant", "tool", "system", "function"))), (c("doc_id") % 5 + 1).cast("int"))
    said = F.when(c("doc_id") % 7 == 0, " \n ").otherwise(F.concat(F.lit(" \n"), "text", F.lit("\t")))
    rows = load(spark, sf_dir, "documents").select(c("source").alias("session_id"), c("doc_id").alias("src_pos"), role.alias("role"), said.alias("text"), F.lit(-1).cast("long").alias("ts_ms"))
    return normalize.cleaned(rows).select("session_id", "src_pos", "role", "text", "ts_ms")


def queries() -> dict:
    found = (
        statements, middles_cut, durations, code_fences, text_entropy, gap_splits, json_replies, environment_lines, project_names, touched_things, relevant_files, tool_calls, listed_sessions, newest_quizzes, replaced_coverage,
        deleted_quizzes, attempt_progress, validated_questions, clean_messages,
    )
    return {f.__name__: f for f in found}


def _tools_sql() -> str:
    """u: session_id, m, p, kind, value, seen of what tools and prose touched."""
    return """ev AS (SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS m, event_id % 4 AS k, event_id AS e, 'f' || (event_id % 11) AS f FROM events),
u AS (
  SELECT session_id, m * 1000 AS seen, ['edited', 'read', 'ran', 'searched'][k + 1] AS kind, CASE k WHEN 0 THEN 'src/' || f || '.py' WHEN 1 THEN 'src/' || f || '.py' WHEN 2 THEN 'run ' || f ELSE f END AS value FROM ev
  UNION ALL SELECT session_id, m * 1000, 'mentioned', 'lib/' || f || '.js' FROM ev WHERE e % 5 = 0)"""


def oracle_sql() -> dict[str, str]:
    squeeze = lambda x: _strip(f"regexp_replace({x}, '[\\s\\x0b\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')")
    bare = "plain"
    for opening in text.NARRATION:
        bare = f"regexp_replace({bare}, '(?i){_quote(opening)}', '')"
    return {
        "statements": rf"""WITH a AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: length({_strip('p')}) > 20)[1], text) AS part FROM documents),
b AS (SELECT doc_id, {squeeze("regexp_replace(regexp_replace(part, '(?s)```.*?```', ' ', 'g'), '[#*_`>]', '', 'g')")} AS plain FROM a),
d AS (SELECT doc_id, CASE WHEN length({_strip(bare)}) > 20 THEN {_strip(bare)} ELSE plain END AS told FROM b),
e AS (SELECT doc_id, {_strip(r"substr(coalesce(nullif(regexp_extract(told, '^(.{20,110}?[.!?])(\s|$)', 1), ''), told), 1, 100)")} AS out FROM d)
SELECT doc_id, coalesce(nullif(out, ''), 'continued (turn ' || (doc_id + 1) || ')') AS statement FROM e""",
        "middles_cut": f"""SELECT doc_id, CASE WHEN length(text) > 400 THEN {_strip_end('substr(text, 1, 208)')} || chr(10) || chr(10) || '… (' || (length(text) - 336) || ' chars omitted from the middle) …' || chr(10) || chr(10)
  || regexp_replace(right(text, 128), '^[\\s\\x0b\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', '') ELSE text END AS text FROM documents""",
        "durations": """WITH e AS (SELECT event_id, epoch_us(ts::TIMESTAMP) // 1000 AS ms, epoch_us(ts::TIMESTAMP) // 1000 - lag(epoch_us(ts::TIMESTAMP) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
m AS (SELECT *, round(gap / 60000.0::DOUBLE)::BIGINT AS mins, (1924905600000 - ms) // 86400000 AS days FROM e)
SELECT event_id, CASE WHEN gap IS NULL OR gap <= 0 THEN 'unknown' WHEN mins < 60 THEN mins || 'm' WHEN mins % 60 = 0 THEN (mins // 60) || 'h' ELSE (mins // 60) || 'h ' || (mins % 60) || 'm' END AS gap,
  CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 30 THEN days || 'd' WHEN days < 365 THEN (days // 30) || 'mo' ELSE (days // 365) || 'y' END AS ago FROM m""",
        "code_fences": f"""WITH b AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE strpos(text, '```') = 0)
SELECT doc_id, (length(t) BETWEEN 1 AND 900)::INTEGER AS blocks, CASE WHEN length(t) BETWEEN 1 AND 900 THEN t END AS first FROM b""",
        "text_entropy": """WITH ch AS (SELECT item_id, unnest(string_split(text, '')) AS x FROM benchmark WHERE text <> ''), n AS (SELECT item_id, x, count(*) AS k FROM ch GROUP BY ALL), s AS (SELECT item_id, sum(k) AS total FROM n GROUP BY item_id)
SELECT item_id, round(-sum(k / total::DOUBLE * log2(k / total::DOUBLE)), 6) AS entropy FROM n JOIN s USING (item_id) GROUP BY item_id""",
        "gap_splits": """WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(1, len(ws) // 6 + 1), lambda k: 'blank_' || k), ',') AS keys, (len(ws) // 6 + 1)::INTEGER AS parts,
  array_to_string(list_transform(range(len(ws) // 6 + 1), lambda g: CASE WHEN g > 0 AND len(ws) > 6 * g THEN ' ' ELSE '' END || array_to_string(ws[6 * g + 1 : least(6 * g + 5, len(ws))], ' ') || CASE WHEN len(ws) >= 6 * g + 6 THEN ' ' ELSE '' END), '|') AS between FROM w""",
        "json_replies": "SELECT item_id, CASE WHEN item_id % 4 < 3 THEN item_id END AS id, CASE WHEN item_id % 4 < 3 THEN text END AS text FROM benchmark",
        "environment_lines": "SELECT c_custkey, 2::INTEGER AS n, c_custkey::VARCHAR AS a, c_mktsegment AS b FROM customer",
        "project_names": """WITH s AS (SELECT s_suppkey, s_nationkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) AS low FROM supplier)
SELECT s_suppkey, 'u' || s_nationkey || '/' || low AS project, 'home/' || low || '/x' AS encoded, CASE WHEN s_suppkey % 3 = 0 THEN 'src' ELSE low END AS base, 'a/b.py' AS below, NULL::VARCHAR AS outside FROM s""",
        "touched_things": f"WITH {_tools_sql()} SELECT session_id, kind, value, count(*) AS times FROM u GROUP BY session_id, kind, value",
        "relevant_files": f"""WITH {_tools_sql()}, g AS (SELECT session_id, kind, value, count(*) AS n, min(seen) AS first FROM u WHERE kind IN ('edited', 'read') GROUP BY session_id, kind, value),
o AS (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY kind, n DESC, first, value) AS r FROM g), f AS (SELECT session_id, value, min(r) AS r FROM o GROUP BY session_id, value)
SELECT session_id, string_agg(value, ',' ORDER BY r) AS relevant FROM f GROUP BY session_id""",
        "tool_calls": "SELECT ['Edit', 'read_file', 'shell', 'grep'][event_id % 4 + 1] AS name, count(*) AS calls FROM events GROUP BY event_id % 4",
        "listed_sessions": """SELECT o_orderkey AS session_id, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS updated_ms, row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey)::INTEGER AS place FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""",
        "newest_quizzes": "SELECT session_id, quiz_id FROM (SELECT o_custkey AS session_id, o_orderkey AS quiz_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
        "replaced_coverage": """SELECT quiz_id, max(range_to) + 1 AS covered_messages FROM (
  SELECT l_orderkey AS quiz_id, (l_linenumber + floor(l_quantity))::INTEGER AS range_to FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
  UNION ALL SELECT o_orderkey, 5 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY quiz_id""",
        "deleted_quizzes": "SELECT o_orderkey AS quiz_id, o_custkey AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
        "attempt_progress": """WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS quiz_id, (o_orderkey % 4)::INTEGER AS position, coalesce(n, 0) > 0 AS resumable, o_orderstatus = 'F' AS completed, coalesce(n, 0)::INTEGER AS answered,
  CASE WHEN o_orderkey % 3 > 0 THEN round((o_orderkey % 7)::DOUBLE / (o_orderkey % 3 * 4) * 100, 1) ELSE 0.0 END AS percentage, 9::BIGINT AS updated_at FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
        "validated_questions": """WITH q AS (SELECT l_orderkey AS session_id, l_linenumber AS n, l_partkey % 4 AS part FROM lineitem), k AS (SELECT *, CASE WHEN part <= 1 THEN 'mcq' WHEN part = 2 THEN 'cloze' ELSE 'open' END AS type FROM q)
SELECT session_id, 't1-' || type || '-' || row_number() OVER (PARTITION BY session_id, type ORDER BY n, part) AS question_id, type, CASE WHEN n = 7 THEN '' ELSE 'why ' || n END AS prompt,
  array_to_string(list_filter([n, n + 3], lambda x: x BETWEEN 2 AND 6), ',') AS turns, CASE part WHEN 0 THEN 'B' WHEN 1 THEN 'Z' END AS correct_key,
  CASE WHEN n = 7 THEN 'empty prompt' WHEN part = 1 THEN 'correct key matches no option' WHEN part = 2 AND n % 2 = 1 THEN 'no answer for blank_2' WHEN part = 3 AND n <= 2 THEN 'no rubric' END AS issue FROM k""",
        "clean_messages": f"""SELECT source AS session_id, doc_id AS src_pos, ['user', 'assistant', '', 'system', ''][doc_id % 5 + 1] AS role, {_strip('text')} AS text, NULL::BIGINT AS ts_ms FROM documents
WHERE doc_id % 7 <> 0 AND doc_id % 5 NOT IN (2, 4) AND {_strip('text')} <> ''""",
    }
