"""Queries over the given tables, one or more for each operator family. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws, roles, text
from ..functions.hashes import turn_text
from ..operators import normalize, quiz, redact, render, reports, splitting, store, topics
from . import parts, readers

#: Without times and files a boundary scores 3 at most, so these tables are cut at a lower threshold than the default.
THRESHOLD = 1.97


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.merged_turns(normalize.cleaned(normalize.from_conversations(load(spark, sf_dir, "conversations"))))


def session_catalog(spark, sf_dir):
    """Sessions with their rollup, quiz-ready ones, longest first."""
    found = normalize.sessions(_turns(spark, sf_dir)).where("quiz_ready")
    return found.select("session_id", "messages", "user_turns", "chars", "tool_calls", "title").orderBy(F.desc("chars"), "session_id")


def harness_report(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("harness", F.col("source"))
    status = F.when(F.col("text").isNull(), "skipped").when(F.length("text") < 100, "empty").otherwise("parsed")
    files = docs.select("harness", status.alias("status"), F.length("text").cast("long").alias("length"))
    sessions = docs.where("length(text) >= 100").select("harness", (F.length("text") >= normalize.READY_CHARS).alias("quiz_ready"), F.length("text").cast("long").alias("chars"))
    return reports.harness_report(files, sessions)


def role_normalized(spark, sf_dir):
    a = load(spark, sf_dir, "conversations").select("role")
    b = load(spark, sf_dir, "events").select(F.col("event_type").alias("role"))
    return a.unionByName(b).groupBy("role", roles.normal_role(F.col("role")).alias("normal")).agg(F.count("*").alias("n"))


def epoch_ms_tolerant(spark, sf_dir):
    """Seconds, milliseconds, ISO texts and garbage, by event id."""
    ev = load(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.floor(F.col("ms") / 1000).cast("string")).when(k == 1, F.col("ms").cast("string")).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    return ev.select("event_id", roles.epoch_ms(raw).alias("ts_ms"))


def title_derivation(spark, sf_dir):
    a = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), text.title_of(F.col("text")).alias("title"))
    b = load(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), text.title_of(F.col("text")).alias("title"))
    return a.unionByName(b)


def merged_turns(spark, sf_dir):
    """Runs of one event type per user as merged turns: the given conversations have no adjacent turns of one role."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = load(spark, sf_dir, "events").withColumn("pos", F.row_number().over(by).cast("long"))
    rows = ev.select(F.col("user_id").cast("string").alias("session_id"), F.col("pos").alias("src_pos"), F.col("event_type").alias("role"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"), F.lit(None).cast("long").alias("ts_ms"), F.lit(None).cast("array<struct<name: string, input: string>>").alias("tools"), F.lit(0).cast("long").alias("thinking_chars"))
    return normalize.merged_turns(rows).select("session_id", "msg_idx", "role", "text", F.col("merged").cast("long").alias("merged"))


def dedupe_first(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("path"), "source")
    return normalize.first_of(docs, ["path"], ["doc_id"]).select("doc_id", "source")


def cap_per_group(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return normalize.capped(docs, ["source"], [F.desc("n_chars"), "doc_id"], 5)


def search_substring(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.col("lang").alias("project"), F.col("source").alias("harness_name"))
    return reports.search(docs, "Apache License").select("doc_id")


def exchanges(spark, sf_dir):
    found = topics.exchanges(_turns(spark, sf_dir))
    return found.select("session_id", "exchange", F.col("start"), F.col("end"), "chars", "substantive", F.size("tokens").alias("n_tokens"))


def token_jaccard(spark, sf_dir):
    """Adjacent exchanges' word overlap."""
    by = Window.partitionBy("session_id").orderBy("exchange")
    found = topics.exchanges(_turns(spark, sf_dir))
    return found.withColumn("before", F.lag("tokens").over(by)).where("before is not null").select("session_id", "exchange", F.round(text.jaccard(F.col("before"), F.col("tokens")), 9).alias("jaccard"))


def boundary_scores(spark, sf_dir):
    found = topics.boundaries(topics.exchanges(_turns(spark, sf_dir))).where("score is not null")
    return found.select("session_id", "exchange", F.round("score", 9).alias("score"))


def segments(spark, sf_dir):
    found = topics.segments(topics.exchanges(_turns(spark, sf_dir)), THRESHOLD)
    return found.groupBy("session_id", "segment").agg(F.min("start").alias("msg_from"), F.max("end").alias("msg_to"), F.count("*").alias("exchanges"))


def _topics(spark, sf_dir) -> DataFrame:
    return topics.topics(_turns(spark, sf_dir), THRESHOLD, max_topics=2)


def topics_ranked(spark, sf_dir):
    return _topics(spark, sf_dir).select("session_id", "msg_from", "msg_to", "exchanges", "chars", F.round("interest", 6).alias("interest"), "rank", "kept", "topic_id")


def topic_labels(spark, sf_dir):
    return _topics(spark, sf_dir).select("session_id", "msg_from", "label")


def topic_stats(spark, sf_dir):
    found = topics.topic_stats(_topics(spark, sf_dir))
    return found.withColumn("coverage", F.round("coverage", 9))


def topics_split_by_size(spark, sf_dir):
    """Topics where segments are over-long, which needs the grouped path."""
    found = splitting.derive_topics(_turns(spark, sf_dir), THRESHOLD, max_chars=1500, min_chars=200)
    return found.select("session_id", "msg_from", "msg_to", "chars", "sub_split", "kept", "topic_id")


def pause_gaps(spark, sf_dir):
    """Pauses between a user's events, weighed as topic boundaries weigh them."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = load(spark, sf_dir, "events").withColumn("gap_s", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(by)) / 1e6)
    score = F.when(F.col("gap_s") > 7200, 3.0).when(F.col("gap_s") > 1800, 1.5).otherwise(0.0)
    return ev.groupBy("user_id").agg(F.sum(score).alias("pause_score"), F.count_if(F.col("gap_s") > 1800).alias("pauses"), F.count("*").alias("events"))


def payload_prefix(spark, sf_dir):
    return render.payload(_turns(spark, sf_dir), max_chars=1800, max_messages=6).select("session_id", "msg_idx", "role", "text", "used", "message_count")


def preceding_context(spark, sf_dir):
    return render.preceding_context(_turns(spark, sf_dir), _topics(spark, sf_dir).where("kept"), 600)


def rendered_transcript(spark, sf_dir):
    return render.transcripts(_turns(spark, sf_dir))


def topic_slices(spark, sf_dir):
    return render.topic_slices(_turns(spark, sf_dir), _topics(spark, sf_dir), max_chars=1500)


def digest(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return render.digests(turns, normalize.sessions(turns), budget=2400, hard_max=2400)


def slice_statistics(spark, sf_dir):
    return render.slice_stats(topic_slices(spark, sf_dir), 1500)


def seeded_draws(spark, sf_dir):
    """Three draws of the exact generator for every event, seeded by its number."""
    ev = load(spark, sf_dir, "events")
    return ev.select("event_id", *(draws.draw(F.col("event_id") * 2654435761, F.lit(k)).alias(f"draw_{k}") for k in (1, 2, 3)))


def seeded_shuffle(spark, sf_dir):
    """Every customer's orders in the exact shuffle of the customer's number."""
    held = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    return held.select("o_custkey", F.array_join(draws.shuffled(F.col("x"), F.col("o_custkey")).cast("array<string>"), ",").alias("shuffled"))


def resumed_steps(spark, sf_dir):
    """Order lines as steps, orders as attempts: every second line answered, some of lines that the quiz doesn't have."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("n"))
    found = li.select("session_id", F.concat(F.lit("s"), F.col("n").cast("string")).alias("step_id"), (F.col("n") - 1).alias("position"))
    pairs = lambda prefix: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("m").cast("string")).alias("k"), F.concat(F.lit(prefix), F.col("m").cast("string")).alias("v"))))))
    asked = li.where("n % 2 = 0").select("session_id", F.explode(F.array("n", F.col("n") + 5)).alias("m")).distinct()
    attempts = asked.groupBy("session_id").agg(pairs("a").alias("answers"), pairs("r").alias("results"), F.max("m").alias("position"))
    return quiz.resumed(found, attempts)[0]


def phase_counts(spark, sf_dir):
    """Order lines as steps: the first two of an order are flashcards."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linenumber") <= 2, "flashcard").otherwise("mcq").alias("type"))
    return quiz.phase_counts(li)


def session_lines(spark, sf_dir):
    found = normalize.sessions(_turns(spark, sf_dir))
    return found.select("session_id", reports.session_line(F.lit(0)).alias("line"))


def payload_lines(spark, sf_dir):
    return reports.payload_line(render.payload(_turns(spark, sf_dir), max_chars=1800, max_messages=6))


def redaction_report(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return redact.by_kind(redact.redact_messages(docs), ("source",))


def redacted_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = redact.redact_messages(docs).where("size(findings) > 0")
    return found.select("doc_id", F.size("findings").cast("long").alias("findings"), "text")


def fingerprints(spark, sf_dir):
    return store.fingerprints(_turns(spark, sf_dir))


def _quizzes(spark, sf_dir) -> DataFrame:
    """A stored quiz for two sessions of three: some edited since, some extended, some with other settings or versions."""
    turns = _turns(spark, sf_dir)
    n = F.col("session_id").cast("long")
    sized = turns.withColumn("_n", F.count("*").over(Window.partitionBy("session_id"))).withColumn("covered", F.when(n % 5 == 1, F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(F.col("_n")))
    then = sized.withColumn("text", F.when((n % 7 == 3) & (F.col("msg_idx") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    held = store.fingerprints(then, F.col("covered")).join(sized.groupBy("session_id").agg(F.first("covered").cast("int").alias("covered_messages")), "session_id").where(n % 3 != 0)
    return held.select("session_id", F.concat(F.lit("q"), F.col("session_id")).alias("quiz_id"), "fingerprint", "covered_messages", F.when(n % 11 == 4, "other").otherwise("same").alias("settings_key"), F.when(n % 13 == 5, "0").otherwise("1").alias("generator_version"), F.lit(1).cast("long").alias("created_at"))


def staleness(spark, sf_dir):
    return store.staleness(_turns(spark, sf_dir), _quizzes(spark, sf_dir), "same").select("session_id", "state", "new_messages")


def quiz_button(spark, sf_dir):
    found = store.staleness(_turns(spark, sf_dir), _quizzes(spark, sf_dir), "same")
    resumable = F.col("session_id").cast("long") % 4 == 0
    return found.withColumn("b", quiz.button(F.col("state"), resumable, F.lit(2), F.col("new_messages"))).select("session_id", "b.action", "b.label", "b.reason")


def readiness(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    found = quiz.readiness(normalize.sessions(turns), topics.topics(turns, THRESHOLD), 3)
    return found.withColumn("reasons", F.array_join("reasons", "; "))


def quiz_plan(spark, sf_dir):
    found = quiz.plan(topics.topics(_turns(spark, sf_dir), THRESHOLD), 4, ("mcq", "cloze"), seed=7)
    return found.select("session_id", "topic_id", "msg_from", "ordinal", F.array_join("types", ",").alias("types"), "question_count", "shortfall")


def deck_assignment(spark, sf_dir):
    return quiz.deck_slots(quiz.plan(topics.topics(_turns(spark, sf_dir), THRESHOLD), 6, seed=3)).groupBy("type").agg(F.count("*").alias("slots"))


def _letter(n):
    return F.element_at(F.array(*map(F.lit, "ABCD")), (n % 4 + 1).cast("int"))


def mcq_grading(spark, sf_dir):
    """Labelled documents as answers: right where the document's number and its letter agree."""
    rows = load(spark, sf_dir, "labels").select("doc_id", "quality")
    given = F.when(F.col("quality") == 1, F.lower(_letter(F.col("doc_id")))).otherwise(_letter(F.col("doc_id") + 1))
    return rows.select("doc_id", quiz.mcq_mark(_letter(F.col("doc_id")), F.concat(F.lit(" "), given)).alias("awarded"))


def cloze_grading(spark, sf_dir):
    """Every word of a benchmark item is a blank, odd ones with an alternative, answered with more or less right texts."""
    k = F.col("item_id") % 3
    name = lambda i: F.concat(F.lit("blank_"), (i + 1).cast("string"))
    alternatives = lambda i: F.when(i % 2 == 0, F.array(F.lit("alt")))
    told = lambda w, i: (
        F.when(i % 2 == 0, F.when(k == 0, F.concat(F.lit(' "'), F.upper(w), F.lit("';  "))).when(k == 1, "ALT").otherwise("wrong")).otherwise(F.when(k == 1, "").otherwise(w))
    )
    words = F.split("text", " ")
    blanks = F.transform(words, lambda w, i: F.struct(name(i).alias("key"), w.alias("answer"), alternatives(i).alias("alternatives")))
    given = F.map_from_entries(F.transform(words, lambda w, i: F.struct(name(i), told(w, i))))
    return load(spark, sf_dir, "benchmark").select("item_id", F.round(quiz.cloze_mark(blanks, given), 6).alias("awarded"))


def weighted_rubric(spark, sf_dir):
    """Order lines as rubric criteria: quantity weighs, discount is the mark."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("w"), (F.col("l_discount") * 12).cast("double").alias("a")))).alias("x"))
    mark = quiz.rubric_mark(F.transform("x", lambda e: e["w"]), F.transform("x", lambda e: e["a"]))
    # Cut, not rounded: sums in another order differ in their last bits, which a tie would bring out.
    mark = F.floor(mark * 1e6 + 0.3) / 1e6
    return rows.select("l_orderkey", mark.alias("mark"), quiz.open_verdict(mark).alias("verdict"))


def score_bands(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_discount") * 1000).cast("double") / F.count("*")).alias("raw"))
    return rows.select(F.round(F.col("raw") * 1.4 - 10, 4).alias("pct")).select(quiz.band(F.col("pct")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def attempt_scores(spark, sf_dir):
    """Customers as attempts, their orders as questions."""
    o = load(spark, sf_dir, "orders")
    graded = o.select(F.col("o_custkey").alias("attempt_id"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 3 / 2.0)).alias("awarded"), (F.col("o_orderkey") % 3 == 2).alias("correct"), (F.col("o_orderkey") % 7 > 0).alias("attempted"))
    return quiz.attempts(graded).withColumn("score", F.round("score", 3))


def latest_attempt(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("quiz_id"), F.col("o_orderkey").alias("attempt_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("started_at"), F.when(F.col("o_orderkey") % 2 == 0, F.unix_date(F.col("o_orderdate").cast("date")) + 30).alias("updated_at"))
    return store.latest_attempts(o).select("quiz_id", "attempt_id")


def upsert_quiz(spark, sf_dir):
    """Customers as stored quizzes, some of them and some new ones coming in."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("quiz_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("model"))
    new = c.where("quiz_id % 3 = 0").select((F.col("quiz_id") * 2).alias("quiz_id"), F.concat(F.lit("new "), "title").alias("title"), F.lit("NEXT").alias("model"))
    return store.upsert(c, new, "quiz_id", ("model",))


def anti_absent(spark, sf_dir):
    """Orders without a line of 45 pieces or more."""
    registry = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return reports.absent_harnesses(registry, load(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("harness")))


def store_stats(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    quizzes = o.select(F.col("o_custkey").alias("session_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("created_at"))
    return store.stats(quizzes, o.where("o_orderkey % 2 = 0"))


def json_props(spark, sf_dir):
    p = F.try_parse_json("props")
    return load(spark, sf_dir, "events").select("event_id", F.try_variant_get(p, "$.k", "long").alias("k"))


def json_shape_counts(spark, sf_dir):
    p = F.try_parse_json("props")
    kind = F.when(p.isNull(), "malformed").when(F.schema_of_variant(F.try_variant_get(p, "$.k", "variant")) == "BIGINT", "number").otherwise("other")
    return load(spark, sf_dir, "events").groupBy("event_type", kind.alias("kind")).agg(F.count("*").alias("n"))


def fence_and_error_features(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", (F.regexp_count(t, F.lit("```")) / 2.0).alias("code_blocks"), F.regexp_count(t, F.lit(topics.ERRORS)).cast("long").alias("errors"), (F.length(text.strip(t)) > 80).alias("substantive"), F.regexp_count(t, F.lit("\n")).cast("long").alias("breaks")
    )


def tolerant_answers(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", text.answer_key(F.concat(F.lit(" \"'`"), F.col("text"), F.lit(";', "))).alias("answer"))


def clipped_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 200).alias("head"), text.clip(F.col("text"), 500, True).alias("counted"))


def turn_parts(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return rows.select("session_id", "msg_idx", F.sha2(turn_text(F.col("role"), F.col("text")), 256).alias("turn_sha"))


def grouped_sessions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("harness"), F.col("n_chars").alias("updated_ms"), F.col("doc_id").alias("session_id"))
    return reports.grouped(docs, shown=3).select("harness", "size", F.array_join(F.transform("newest", lambda e: e["session_id"].cast("string")), ",").alias("newest"))


def queries() -> dict:
    names = (
        session_catalog, harness_report, role_normalized, epoch_ms_tolerant, title_derivation, merged_turns, dedupe_first, cap_per_group, search_substring, exchanges, token_jaccard, boundary_scores, segments, topics_ranked,
        topic_labels, topic_stats, topics_split_by_size, pause_gaps, payload_prefix, preceding_context, rendered_transcript, topic_slices, digest, redaction_report, redacted_text, fingerprints, staleness, quiz_button, readiness,
        quiz_plan, deck_assignment, mcq_grading, cloze_grading, weighted_rubric, score_bands, attempt_scores, latest_attempt, upsert_quiz, anti_absent, store_stats, json_props, json_shape_counts, fence_and_error_features,
        tolerant_answers, clipped_texts, turn_parts, grouped_sessions, slice_statistics, seeded_draws, seeded_shuffle, resumed_steps, phase_counts, session_lines, payload_lines,
    )
    return {f.__name__: f for f in names} | readers.queries() | parts.queries()
