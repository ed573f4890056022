"""Quiz planning, validation of generated questions, grading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.draws import shuffled
from ..functions.text import answer_key, strip

#: Fixed values.
TYPES = ("mcq", "cloze", "open")
QUESTIONS, FLASHCARDS_PER_TOPIC, MIN_TURNS, MIN_CHARS, MIN_TOPIC_CHARS, MIN_EXCHANGES, CHARS_PER_TYPE = 6, 2, 1, 400, 700, 1, 250
PASS_MARK = 0.85
BANDS = ((25, "unfamiliar"), (50, "partial"), (75, "solid"))

def _session() -> WindowSpec:
    return Window.partitionBy("session_id")



def topic_floor(n_types: int) -> int:
    return max(MIN_TOPIC_CHARS, max(1, n_types) * CHARS_PER_TYPE)


def usable(n_types: int) -> Column:
    return (F.col("chars") >= topic_floor(n_types)) & (F.col("exchanges") >= MIN_EXCHANGES)


def readiness(sessions: DataFrame, topics: DataFrame, n_types: int = 0) -> DataFrame:
    """A row per session: ready, level (empty, thin, partial, ready) and reasons."""
    held = topics.where("kept").groupBy("session_id").agg(F.count("*").alias("topics"), F.count_if(usable(n_types)).alias("usable_topics"))
    rows = sessions.join(held, "session_id", "left").na.fill(0, ["topics", "usable_topics"])
    turns, chars, n, good = (F.col(c) for c in ("user_turns", "chars", "topics", "usable_topics"))
    text = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    reasons = F.array_compact(
        F.array(
            F.when(turns < MIN_TURNS, text("only ", turns.cast("string"), F.when(turns == 1, " user turn").otherwise(" user turns"), f", need {MIN_TURNS}")),
            F.when(chars < MIN_CHARS, text("only ", chars.cast("string"), f" characters, need {MIN_CHARS}")),
            F.when(n == 0, "no topic could be derived").when(good == 0, text("all ", n.cast("string"), f" topic(s) are below {topic_floor(n_types)} characters")),
        )
    )
    level = F.when((turns == 0) | (chars == 0), "empty").when(good == 0, "thin").when(n > good, "partial").otherwise("ready")
    ready = (good > 0) & (turns >= MIN_TURNS) & (chars >= MIN_CHARS)
    return rows.select("session_id", ready.alias("ready"), level.alias("level"), reasons.alias("reasons"), "topics", "usable_topics")


def plan(topics: DataFrame, questions: int = QUESTIONS, types: tuple[str, ...] = TYPES, seed: int = 0, from_message: int = 0, exact: bool = False) -> DataFrame:
    """The deck: a row per selected topic with the types asked of it.

    As many topics as questions by types are drawn by a seeded hash, or, when exact, by the reference's own generator and
    shuffle (of a session's usable topics in order of time), and dealt types topic by topic; no topic is asked one type twice. Topics before from_message are left
    out after derivation, so that indices stay those of the whole session. shortfall is what a session can't support.
    """
    types = tuple(dict.fromkeys(t for t in types if t in TYPES))
    asked = max(0, questions) if types else 0
    needed = max(1, -(-asked // len(types))) if types else 1
    fit = topics.where("kept").where(usable(len(types)) & (F.col("msg_from") >= from_message))
    if exact:
        order = F.array_sort(F.collect_list("msg_from"))
        first = fit.groupBy("session_id").agg(F.slice(shuffled(order, F.lit(seed)), 1, needed).alias("x")).select("session_id", F.explode("x").alias("msg_from"))
        drawn = fit.join(first, ["session_id", "msg_from"], "left_semi")
    else:
        drawn = fit.withColumn("_d", F.row_number().over(_session().orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "session_id", "msg_from"), 256), "msg_from"))).where(F.col("_d") <= needed).drop("_d")
    ordinal = F.row_number().over(_session().orderBy("msg_from")) - 1
    size = F.count("*").over(_session())
    rows = drawn.withColumns({"ordinal": ordinal, "deck_size": size})
    count = F.least(F.lit(asked), F.col("deck_size") * len(types))
    mine = F.filter(F.sequence(F.lit(0), F.lit(max(0, asked - 1))), lambda i: (i < count) & (i % F.col("deck_size") == F.col("ordinal")))
    table = F.array(*map(F.lit, types)) if types else F.array().cast("array<string>")
    dealt = F.transform(mine, lambda i: F.element_at(table, (F.floor(i / F.col("deck_size")) % max(1, len(types)) + 1).cast("int"))) if types else table
    return rows.select("session_id", "topic_id", "label", "msg_from", "msg_to", "chars", "ordinal", dealt.alias("types"), count.cast("int").alias("question_count"), (F.lit(asked) - count).cast("int").alias("shortfall"), F.lit(FLASHCARDS_PER_TOPIC).alias("flashcards"))


def deck_slots(deck: DataFrame) -> DataFrame:
    """A row per (topic, type)."""
    return deck.select("session_id", "topic_id", F.explode("types").alias("type"))


#: What a generator returns for a topic, as from_json reads it.
RESULT = (
    "flashcards array<struct<front: string, back: string, sourceTurns: array<int>>>, questions array<struct<type: string, prompt: string, explanation: string, sourceTurns: array<int>,"
    " options: array<struct<key: string, text: string>>, correctOptionKey: string, codeWithGaps: string, language: string,"
    " blanks: array<struct<key: string, answer: string, alternatives: array<string>>>,"
    " rubric: array<struct<criterion: string, weight: double, mustMention: array<string>>>, referenceAnswer: string>>"
)


def _filled(x: Column) -> Column:
    return F.coalesce(strip(x), F.lit("")) != ""


def validated(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, flashcards) of results: session_id, topic_id, label, msg_from, msg_to, types, json.

    Every question comes back with ``issue``, null if it is good. Ids count questions of a type within their topic,
    dropped ones too. Citations outside the topic's turns are left out. An extra blank without a gap stays, as in the
    reference.
    """
    rows = results.withColumn("r", F.from_json("json", RESULT))
    cited = lambda turns: F.filter(F.coalesce(turns, F.array().cast("array<int>")), lambda n: (n >= F.col("msg_from")) & (n <= F.col("msg_to")))
    cards = rows.select("session_id", "topic_id", "label", "msg_from", "msg_to", F.explode("r.flashcards").alias("c")).where(_filled(F.col("c.front")) & _filled(F.col("c.back")))
    cards = cards.select("session_id", "topic_id", F.col("label").alias("topic_label"), strip(F.col("c.front")).alias("front"), strip(F.col("c.back")).alias("back"), cited(F.col("c.sourceTurns")).alias("source_turns"))

    q = rows.select("session_id", "topic_id", "label", "msg_from", "msg_to", "types", F.posexplode("r.questions").alias("pos", "q"))
    kind = F.col("q.type")
    only = lambda t, c: F.when(kind == t, c)
    # What is trimmed is trimmed once: first all fields, then elements with an empty one go, and then keys are filled in.
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    options = F.transform("q.options", lambda o: F.struct(strip(o["key"]).alias("key"), strip(o["text"]).alias("text")))
    options = F.filter(F.coalesce(options, F.array().cast("array<struct<key: string, text: string>>")), lambda o: filled(o["text"]))
    options = F.transform(options, lambda o, i: F.struct(F.when(filled(o["key"]), o["key"]).otherwise(F.element_at(F.array(*map(F.lit, "ABCDEFGHIJ")), F.least(i + 1, F.lit(10)))).alias("key"), o["text"].alias("text")))
    blanks = F.transform("q.blanks", lambda b: F.struct(strip(b["key"]).alias("key"), strip(b["answer"]).alias("answer"), b["alternatives"].alias("alternatives")))
    blanks = F.filter(F.coalesce(blanks, F.array().cast("array<struct<key: string, answer: string, alternatives: array<string>>>")), lambda b: filled(b["answer"]))
    blanks = F.transform(blanks, lambda b, i: F.struct(F.when(filled(b["key"]), b["key"]).otherwise(F.concat(F.lit("blank_"), (i + 1).cast("string"))).alias("key"), b["answer"].alias("answer"), b["alternatives"].alias("alternatives")))
    rubric = F.transform("q.rubric", lambda r: F.struct(strip(r["criterion"]).alias("criterion"), F.when(r["weight"] > 0, r["weight"]).otherwise(F.lit(1.0)).alias("weight"), r["mustMention"].alias("must_mention")))
    rubric = F.filter(F.coalesce(rubric, F.array().cast("array<struct<criterion: string, weight: double, must_mention: array<string>>>")), lambda r: filled(r["criterion"]))
    parts = {
        "prompt": strip(F.col("q.prompt")), "options": only("mcq", options), "correct": only("mcq", strip(F.coalesce("q.correctOptionKey", F.lit("")))),
        "markers": only("cloze", F.regexp_extract_all("q.codeWithGaps", F.lit(r"\{\{(blank_\d+)\}\}"), F.lit(1))), "blanks": only("cloze", blanks), "rubric": only("open", rubric),
    }
    # A generator keeps these from being written out, and so computed, at every use.
    q = q.select("*", F.inline(F.array(F.struct(F.struct(*(x.alias(k) for k, x in parts.items())).alias("x")))))
    prompt, options, correct, markers, blanks, rubric = (F.col(f"x.{k}") for k in parts)
    asked = F.array_contains("types", kind)
    number = F.row_number().over(Window.partitionBy("session_id", "topic_id", "q.type").orderBy("pos"))
    missing = F.array_except(markers, F.transform(blanks, lambda b: b["key"]))
    issue = (
        F.when(~asked | kind.isNull(), "not requested").when(~filled(prompt), "empty prompt")
        .when((kind == "mcq") & (F.size(options) < 2), "too few usable options").when((kind == "mcq") & ~F.exists(options, lambda o: o["key"] == correct), "correct key matches no option")
        .when((kind == "cloze") & (F.coalesce(F.size(markers), F.lit(0)) == 0), "no gap in the code").when((kind == "cloze") & (F.size(blanks) == 0), "no blanks")
        .when((kind == "cloze") & (F.size(missing) > 0), F.concat(F.lit("no answer for "), F.array_join(missing, ", "))).when((kind == "open") & (F.size(rubric) == 0), "no rubric")
    )
    questions = q.select(
        "session_id", "topic_id", F.concat_ws("-", "topic_id", kind, number.cast("string")).alias("question_id"), kind.alias("type"), prompt.alias("prompt"), strip(F.col("q.explanation")).alias("explanation"),
        cited(F.col("q.sourceTurns")).alias("source_turns"), options.alias("options"), correct.alias("correct_key"), only("cloze", F.col("q.codeWithGaps")).alias("code_with_gaps"),
        blanks.alias("blanks"), rubric.alias("rubric"), issue.alias("issue"),
    )
    return questions, cards


def generate(prompts: DataFrame, generator: Callable[[str], str]) -> DataFrame:
    """prompts (session_id, topic_id, prompt) with ``json``, the reply of an injected generator; none is built in, and
    an exception becomes a null reply with its text in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            replies = []
            for p in rows["prompt"]:
                try:
                    replies.append((generator(p), None))
                except Exception as e:  # the provider's failures are data here
                    replies.append((None, str(e)))
            yield rows[["session_id", "topic_id"]].assign(json=[r for r, _ in replies], error=[e for _, e in replies])

    return prompts.select("session_id", "topic_id", "prompt").mapInPandas(run, "session_id string, topic_id string, json string, error string")


def band(percentage: Column) -> Column:
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(percentage.cast("double"), F.lit(0.0))))
    out = F.when(pct < BANDS[0][0], BANDS[0][1])
    for limit, name in BANDS[1:]:
        out = out.when(pct < limit, name)
    return out.otherwise("strong")


def mcq_mark(correct: Column, given: Column) -> Column:
    """1 or 0; null without an expected key."""
    clean = lambda x: F.upper(strip(F.coalesce(x, F.lit(""))))
    return F.when(clean(correct) != "", (clean(given) == clean(correct)).cast("double"))


def cloze_mark(blanks: Column, given: Column) -> Column:
    """The share of blanks (key, answer, alternatives) whose given text (a map by key) is accepted; null without blanks."""
    def right(b):
        mine = answer_key(F.try_element_at(given, b["key"]))
        accepted = F.transform(F.concat(F.array(b["answer"]), F.coalesce(b["alternatives"], F.array().cast("array<string>"))), answer_key)
        return (mine != "") & F.array_contains(accepted, mine)

    return F.when(F.size(blanks) > 0, F.size(F.filter(blanks, right)).cast("double") / F.size(blanks))


def rubric_mark(weights: Column, awarded: Column) -> Column:
    """The weighted mean of marks by position, each held within 0 and 1; missing marks are 0, missing weights 1."""
    weight = lambda w: F.when(w > 0, w).otherwise(F.lit(1.0))
    marks = F.zip_with(weights, F.slice(awarded, 1, F.greatest(F.size(weights), F.lit(1))), lambda w, a: weight(w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a, F.lit(0.0)))))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(weights) > 0, add(marks) / add(F.transform(weights, weight))).otherwise(0.0)


def open_verdict(mark: Column) -> Column:
    return F.when(mark >= PASS_MARK, "correct").when(mark > 0, "partial").otherwise("incorrect")


def grade(questions: DataFrame, answers: DataFrame, graded_open: DataFrame | None = None) -> DataFrame:
    """A row per question of questions (attempt_id, question_id, type, correct_key, blanks, rubric), answered or not.

    answers: attempt_id, question_id, value (text), values (map for gaps). A plain value answers a single gap. Open
    questions take their marks from graded_open (attempt_id, question_id, awarded: array of marks by criterion); an
    empty answer is 0, one without a mark stays ungraded (null).
    """
    rows = questions.join(answers, ["attempt_id", "question_id"], "left")
    if graded_open is not None:
        rows = rows.join(graded_open.withColumnRenamed("awarded", "open_marks"), ["attempt_id", "question_id"], "left")
    else:
        rows = rows.withColumn("open_marks", F.lit(None).cast("array<double>"))
    given = F.coalesce("values", F.create_map(F.try_element_at("blanks", F.lit(1))["key"], F.col("value")))
    empty = strip(F.coalesce("value", F.lit(""))) == ""
    open_mark = F.when(empty, 0.0).when(F.col("open_marks").isNotNull(), rubric_mark(F.transform("rubric", lambda r: r["weight"]), F.col("open_marks")))
    mark = F.when(F.col("type") == "mcq", mcq_mark(F.col("correct_key"), F.col("value"))).when(F.col("type") == "cloze", cloze_mark(F.col("blanks"), given)).when(F.col("type") == "open", open_mark)
    rows = rows.withColumn("awarded", mark)
    correct = F.when(F.col("type") == "open", F.col("awarded") >= PASS_MARK).otherwise(F.col("awarded") == 1)
    attempted = F.when(F.col("type") == "cloze", F.col("values").isNotNull() | ~empty).otherwise(~empty)
    return rows.select("attempt_id", "question_id", "type", "awarded", correct.alias("correct"), attempted.alias("attempted"))


def attempts(graded: DataFrame) -> DataFrame:
    """Scores per attempt. answered counts questions with credit, as in the reference; attempted those with an answer.
    max_score counts graded questions only, total all."""
    out = graded.groupBy("attempt_id").agg(
        F.round(F.coalesce(F.sum("awarded"), F.lit(0.0)), 3).alias("score"), F.count("awarded").alias("max_score"), F.count_if((F.col("awarded") > 0) | F.col("correct")).alias("answered"),
        F.count_if("attempted").alias("attempted"), F.count("*").alias("total"),
    )
    pct = F.when(F.col("max_score") > 0, F.round(F.col("score") / F.col("max_score") * 100, 1)).otherwise(0.0)
    return out.withColumn("percentage", pct).withColumn("band", band(pct))


def button(state: Column, resumable: Column, answered: Column, new_messages: Column) -> Column:
    """STRUCT<action, label, reason> of a quiz button: a started quiz resumes before anything else."""
    text = F.concat(new_messages.cast("string"), F.when(new_messages == 1, " new message").otherwise(" new messages"), F.lit(" since this quiz was made."))
    why = (
        F.when(state == "extended", text).when(state == "diverged", "The part of this conversation this quiz used has changed.")
        .when(state == "settings_changed", "Your current settings differ from this quiz.").when(state == "generator_stale", "This quiz came from an older version of the generator.")
        .otherwise("A quiz is ready for this conversation.")
    )
    made = lambda action, label, reason: F.struct(F.lit(action).alias("action"), F.lit(label).alias("label"), reason.alias("reason"))
    resume = F.concat(F.lit("You are partway through this quiz, "), answered.cast("string"), F.lit(" answered."))
    return (
        F.when(state == "new", made("configure", "Generate quiz", F.lit("No quiz for this conversation yet."))).when(resumable, made("resume", "Resume quiz", resume))
        .otherwise(made("open", "Back to quiz", why))
    )


def steps(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """A quiz as a flat list, flashcards first; of steps with one id the first stays."""
    a = cards.select("session_id", F.lit(0).alias("k"), F.concat_ws("-", "topic_id", F.lit("card"), F.xxhash64("front").cast("string")).alias("step_id"), F.lit("flashcard").alias("type"), F.col("front").alias("prompt"))
    b = questions.where("issue is null").select("session_id", F.lit(1).alias("k"), F.col("question_id").alias("step_id"), "type", "prompt")
    rows = a.unionByName(b).withColumn("_r", F.row_number().over(Window.partitionBy("session_id", "step_id").orderBy("k", "prompt"))).where("_r = 1").drop("_r")
    return rows.withColumn("position", F.row_number().over(_session().orderBy("k", "step_id")) - 1).drop("k")


def phase_counts(found: DataFrame) -> DataFrame:
    """How many steps of each phase a quiz has."""
    card = F.col("type") == "flashcard"
    return found.groupBy("session_id").agg(F.count_if(card).alias("flashcards"), F.count_if(~card).alias("questions"))


def resumed(found: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses, places) of attempts (session_id, position, answers and results as JSON objects by step id) that can be resumed.

    responses: session_id, step_id, position (null for a step that the quiz no longer has), answer, result. A result of an
    unknown step is dropped, its answer kept. places: session_id, position, within the quiz's steps.
    """
    held = attempts.select("session_id", F.col("position").alias("at"), F.from_json("answers", "map<string, string>").alias("a"), F.from_json("results", "map<string, string>").alias("r"))
    held = held.where(F.coalesce(F.size("a"), F.lit(0)) > 0)
    answers = held.select("session_id", F.explode("a").alias("step_id", "answer"))
    results = held.select("session_id", F.explode("r").alias("step_id", "result"))
    known = found.select("session_id", "step_id", "position")
    results = results.join(known.select("session_id", "step_id"), ["session_id", "step_id"], "left_semi")
    responses = answers.join(results, ["session_id", "step_id"], "full_outer").join(known, ["session_id", "step_id"], "left")
    last = known.groupBy("session_id").agg(F.max("position").alias("last"))
    places = held.join(last, "session_id", "left").select("session_id", F.greatest(F.lit(0), F.least(F.coalesce("at", F.lit(0)), F.coalesce("last", F.lit(0)))).cast("int").alias("position"))
    return responses.select("session_id", "step_id", "position", "answer", "result"), places
