"""Exact draws, two-ended digests, resuming, summary lines."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import draws
from colloquy.functions.text import clip_middle
from colloquy.operators import normalize, quiz, render, reports
from colloquy.schema import MESSAGES


def generator(seed):
    """The 32-bit generator with plain integers."""
    a, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ a >> 15) * (1 | a)) & mask
        t = ((t + ((t ^ t >> 7) * (61 | t) & mask)) & mask) ^ t
        yield (t ^ t >> 14) / 2**32


def shuffled(items, seed):
    out, rand = list(items), generator(seed)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(rand) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


SEEDS = (0, 1, 2, 7, 42, 1234, 99_999, 2**31, 2**32 - 1, -5)


def test_draws_and_shuffles_of_ten_seeds(spark):
    rows = spark.createDataFrame([(s, list(range(n))) for s in SEEDS for n in (0, 1, 2, 14)], "seed long, items array<long>")
    for r in rows.select("*", draws.shuffled(F.col("items"), F.col("seed")).alias("got"), F.array(*(draws.draw(F.col("seed"), F.lit(k)) for k in range(1, 6))).alias("drawn")).collect():
        rand = generator(r.seed)
        assert r.got == shuffled(r["items"], r.seed) and r.drawn == [next(rand) for _ in range(5)]
    assert next(generator(0)) == 0.26642920868471265  # a known value


def test_exact_plans_draw_as_the_shuffle_does(spark):
    rows = [(f"s{s}", f"t{i}", "L", i * 10, i * 10 + 9, 2000, 2, True) for s in range(3) for i in range(9)]
    found = spark.createDataFrame(rows, "session_id string, topic_id string, label string, msg_from int, msg_to int, chars long, exchanges long, kept boolean")
    got = quiz.plan(found, 6, ("mcq", "open"), seed=42, exact=True).collect()
    want = sorted(shuffled([i * 10 for i in range(9)], 42)[:3])
    assert sorted((r.session_id, r.msg_from) for r in got) == [(f"s{s}", m) for s in range(3) for m in want]


@pytest.mark.parametrize("most", [100, 300, 2000, 100_000])
def test_ends_equal_the_middle_cut_of_whole_transcripts(spark, most):
    rng = random.Random(most)
    rows = []
    for s in range(12):
        for i in range(rng.randrange(1, 12)):
            text = rng.choice([" ", "\n", "\n\n"]).join(rng.choice(["one", "two two", "```\ncode\n```", "é" * 30]) for _ in range(rng.choice([1, 4, 30, 300])))
            rows.append((f"s{s}", i, rng.choice(["user", "assistant", "system"]), text, None, None, 0))
    turns = normalize.merged_turns(normalize.cleaned(spark.createDataFrame(rows, MESSAGES))).cache()
    whole = render.transcripts(turns).where("transcript <> ''").select("session_id", F.length("transcript").cast("long").alias("n"), clip_middle(F.col("transcript"), most).alias("x"))
    got = render.ends(turns, most).select("session_id", F.col("transcript_chars").alias("n"), F.col("conversation").alias("x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_resuming_keeps_answers_and_drops_unknown_results(spark):
    steps = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("r", "a", 0)], "session_id string, step_id string, position int")
    attempts = spark.createDataFrame([("q", 9, '{"a": "1", "gone": "2"}', '{"b": "{}", "gone": "{}"}'), ("r", 0, "{}", '{"a": "x"}')], "session_id string, position int, answers string, results string")
    responses, places = quiz.resumed(steps, attempts)
    assert sorted(map(tuple, responses.collect()), key=str) == [("q", "a", 0, "1", None), ("q", "b", 1, None, "{}"), ("q", "gone", None, "2", None)]
    assert [tuple(r) for r in places.collect()] == [("q", 1)]


def test_summary_lines(spark):
    report = spark.createDataFrame([("a", 2, 1, 0), ("b", 0, 0, 3)], "harness string, session_count long, quiz_ready long, skipped long")
    assert reports.catalog_line(report).first().line == "1 harness · 2 sessions · 1 quiz-ready · 3 files skipped"
    one = spark.createDataFrame([(1, 2, 1500, 86_400_000)], "messages long, tool_calls long, chars long, updated_ms long")
    assert one.select(reports.session_line(F.lit(3 * 86_400_000)).alias("x")).first().x == "1 turn · 2 tool calls · 1,500 characters · 2d"
    deck = spark.createDataFrame([("s", 5, 2, 1), ("s", 5, 2, 1)], "session_id string, question_count int, flashcards int, shortfall int")
    assert reports.plan_line(deck).first().line == "5 questions · 4 flashcards · 2 topics · 1 fewer than asked"
