import json
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import normalize, quiz, redact, render, reports, splitting, store, topics
from colloquy.schema import MESSAGES

from brute_topics import split_session


def frame(spark, turns, session="s"):
    """turns: (role, text[, ts_ms[, tools]])"""
    rows = [(session, i, t[0], t[1], t[2] if len(t) > 2 else None, t[3] if len(t) > 3 else None, 0) for i, t in enumerate(turns)]
    return spark.createDataFrame(rows, MESSAGES)


def merged(spark, turns, session="s"):
    return normalize.merged_turns(normalize.cleaned(frame(spark, turns, session)))


def test_merge_drops_empty_and_tool_turns_and_renumbers(spark):
    tool = [{"name": "Edit", "input": '{"file_path": "a.py"}'}]
    got = merged(spark, [("user", "one"), ("user", " two "), ("tool", "noise"), ("assistant", ""), ("assistant", "x", 5, tool), ("ai", "y"), ("model", "z")]).orderBy("msg_idx").collect()
    assert [(r.role, r.text, r.msg_idx) for r in got] == [("user", "one\n\ntwo", 0), ("assistant", "x", 1), ("assistant", "y\n\nz", 2)]
    assert got[1].tools[0].name == "Edit" and got[1].ts_ms == 5


def test_session_rollup(spark):
    s = normalize.sessions(merged(spark, [("user", "Fix it", 10), ("assistant", "a" * 400, 30), ("user", "thanks", 50)])).first()
    assert (s.messages, s.user_turns, s.chars, s.started_ms, s.updated_ms, s.title, s.quiz_ready) == (3, 2, 412, 10, 50, "Fix it", True)


def test_boundaries_by_files_pause_marker_and_short_turn(spark):
    edit = lambda p: [{"name": "write", "input": '{"path": "./%s"}' % p}]
    turns = [("user", "alpha beta gamma delta epsilon", 0), ("assistant", "ok", 1000, edit("a.py")), ("user", "now alpha beta gamma delta epsilon", 3 * 3600_000), ("assistant", "ok", 3 * 3600_000, edit("b.py")), ("user", "yes", 3 * 3600_000)]
    scores = [r.score for r in topics.boundaries(topics.exchanges(merged(spark, turns))).orderBy("exchange").collect()]
    assert scores[0] is None
    assert abs(scores[1] - (3.0 + 0.0 + 3.0 + 1.0)) < 1e-9  # other files, same words, a long pause, a marker
    assert abs(scores[2] - (2.0 - 2.0)) < 1e-9  # no files on one side, no common words, a short turn
    found = topics.topics(merged(spark, turns)).orderBy("msg_from").collect()
    assert [(t.msg_from, t.msg_to, t.topic_id) for t in found] == [(0, 1, "t1"), (2, 4, "t2")]


def _random_sessions(spark, n, long):
    rng = random.Random(3)
    rows = []
    for s in range(n):
        for i in range(rng.randrange(1, 30)):
            words = " ".join(rng.choice("abcdefgh") * 4 for _ in range(rng.randrange(1, long)))
            rows.append((f"s{s}", i, "user" if i % 2 == 0 else "assistant", words, None, None, 0))
    return normalize.merged_turns(normalize.cleaned(spark.createDataFrame(rows, MESSAGES)))


def test_split_topics_tile_the_session_within_the_cap(spark):
    turns = _random_sessions(spark, 6, 60).cache()
    found = splitting.derive_topics(turns, 1.0, max_topics=100, max_chars=600, min_chars=50).collect()
    texts = {(r.session_id, r.msg_idx): r.text for r in turns.collect()}
    for s in {t.session_id for t in found}:
        mine = sorted((t for t in found if t.session_id == s), key=lambda t: (t.msg_from, t.msg_to))
        assert mine[0].msg_from == 0 and max(t.msg_to for t in mine) == max(i for k, i in texts if k == s)
        assert all(b.msg_from in (a.msg_to, a.msg_to + 1) for a, b in zip(mine, mine[1:]))
        assert all(t.chars <= 600 for t in mine) and sum(t.chars for t in mine) == sum(len(x) for (k, _), x in texts.items() if k == s)


def test_slices_of_a_split_message_tile_it(spark):
    text = " ".join(f"w{i}." for i in range(3000))
    rows = [("s", 0, "user", "please explain all of it", None, None, 0), ("s", 1, "assistant", text, None, None, 0)]
    turns = normalize.merged_turns(normalize.cleaned(spark.createDataFrame(rows, MESSAGES)))
    found = splitting.derive_topics(turns, max_topics=40, max_chars=4000).cache()
    parts = sorted((t for t in found.collect() if t.msg_from == 1), key=lambda t: t.char_from)
    assert len(parts) > 3 and parts[0].char_from == 0 and parts[-1].char_to == len(text) and all(a.char_to == b.char_from for a, b in zip(parts, parts[1:]))
    got = {r.topic_id: r for r in render.topic_slices(turns, found, max_chars=9000).collect()}
    for t in parts:
        assert got[t.topic_id].text.endswith(text[t.char_from : t.char_to].strip()) and got[t.topic_id].truncated == 0
    assert parts[1].agent_label and parts[1].label != parts[2].label and parts[1].label.startswith("w")


def test_statements_of_pieces(spark):
    from colloquy.functions.text import statement_of

    texts = ["```x```\n\nOkay, the user wants me to rename all of the helper functions. Then more.", "short", "", "# A **heading** of some words!\n\nNext part", "no end " * 40]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(statement_of(F.col("t"), F.col("i") + 1).alias("s")).collect()]
    assert got == ["rename all of the helper functions.", "short", "continued (turn 3)", "A heading of some words!", ("no end " * 40)[:100].strip()]


@pytest.mark.parametrize("max_chars,min_chars,max_topics", [(300, 80, 100), (120, 60, 2), (1000, 400, 14)])
def test_split_topics_equal_brute_force(spark, max_chars, min_chars, max_topics):
    rng = random.Random(max_chars)
    rows = []
    for s in range(12):
        for i in range(rng.randrange(1, 30)):
            words = rng.choice([" ", ". ", "\n"]).join(rng.choice(["abcd", "efgh error", "``` x", "the ij"]) for _ in range(rng.choice([1, 3, 10, 40, 200])))
            tools = [{"name": "write", "input": '{"path": "f%d"}' % rng.randrange(3)}] if rng.random() < 0.2 else None
            rows.append((f"s{s}", i, "user" if rng.random() < 0.3 else "assistant", words, i * rng.choice([1000, 10**7]), tools, 0))
    turns = normalize.merged_turns(normalize.cleaned(spark.createDataFrame(rows, MESSAGES))).cache()
    exchanges = topics.boundaries(topics.exchanges(turns)).collect()
    texts = {}
    for r in topics.with_exchange(turns).orderBy("msg_idx").collect():
        texts.setdefault((r.session_id, r.exchange), []).append(r.text)
    want, plain = [], 0
    for s in sorted({r.session_id for r in exchanges}):
        mine = [r.asDict() | {"n_files": len(r.files), "texts": texts[s, r.exchange]} for r in sorted(exchanges, key=lambda r: r.exchange) if r.session_id == s]
        segment, sizes = 0, {}
        for r in mine:
            segment += r["score"] is not None and r["score"] >= 2.5
            sizes[segment] = sizes.get(segment, 0) + r["chars"]
        if max(sizes.values()) > max_chars:
            want += [(s, *t) for t in split_session(mine, 2.5, max_topics, max_chars, min_chars)]
        else:
            plain += len(sizes)
    found = splitting.derive_topics(turns, 2.5, max_topics, max_chars, min_chars).cache()
    names = "session_id msg_from msg_to exchanges chars char_from char_to sub_split agent_label n_files wrote substantive code_blocks errors".split()
    got = [tuple(r) for r in found.select(names).collect()]
    long = {w[0] for w in want}
    assert sorted(map(repr, (g for g in got if g[0] in long))) == sorted(map(repr, want)) and len(got) == len(want) + plain
    capped = splitting.derive_topics(turns, 2.5, max_topics, max_chars, 0, max_pieces=2)
    whole = {r.session_id: r.c for r in topics.exchanges(turns).groupBy("session_id").agg(F.sum("chars").alias("c")).collect()}
    assert {r.session_id: r.c for r in capped.groupBy("session_id").agg(F.sum(F.col("chars") + F.col("cut_chars")).alias("c")).collect()} == whole
    assert capped.agg(F.sum("cut_chars")).first()[0] > 0


def test_files_and_tools_of_topics(spark):
    tool = lambda *names: [{"name": n, "input": '{"path": "./%s.py"}' % n} for n in names]
    turns = merged(spark, [("user", "one"), ("assistant", "x", None, tool("read", "write", "read")), ("user", "separately another thing"), ("assistant", "y")])
    got = splitting.with_touched(turns, topics.topics(turns, -9)).orderBy("msg_from").collect()
    assert [(t.files, [tuple(x) for x in t.tools]) for t in got] == [(["read.py", "write.py"], [("read", 2), ("write", 1)]), ([], [])]


def test_plain_and_grouped_topics_agree_where_nothing_is_long(spark):
    turns = _random_sessions(spark, 8, 12).cache()
    a = topics.topics(turns, 1.97).select("session_id", "msg_from", "msg_to", "chars", F.round("interest", 9), "topic_id").collect()
    b = splitting.derive_topics(turns, 1.97, max_chars=10**6).select("session_id", "msg_from", "msg_to", "chars", F.round("interest", 9), "topic_id").collect()
    assert sorted(a) == sorted(b)


def test_topics_do_not_depend_on_partitions(spark):
    turns = _random_sessions(spark, 5, 20).cache()
    got = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, splitting.derive_topics(turns, 1.5, max_chars=500).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_transcript_payload_context_and_touched(spark):
    tools = [{"name": "Edit", "input": '{"file_path": "./app/db.py"}'}, {"name": "bash", "input": '{"command": "make\\nall"}'}, {"name": "Grep", "input": '{"pattern": "todo"}'}]
    turns = merged(spark, [("system", "sys"), ("user", "please fix"), ("assistant", "see src/a/b.py:3 and\n```py\nx = 1\n```", 3_600_000, tools), ("user", "next"), ("assistant", "done")])
    text = render.transcripts(turns).first().transcript
    assert "[turn 1] USER" in text and "[turn 2] ASSISTANT 01:00 | tools: Edit(./app/db.py), bash(make), Grep(todo)" in text and "sys" not in text
    found = {(r.kind, r.value): r.times for r in render.touched(turns).collect()}
    assert found == {("edited", "app/db.py"): 1, ("ran", "make"): 1, ("searched", "todo"): 1, ("mentioned", "src/a/b.py"): 1}
    assert render.relevant_paths(render.touched(turns)).first().relevant == ["app/db.py"]
    kept = render.payload(turns, max_chars=20).orderBy("msg_idx").collect()
    assert [r.msg_idx for r in kept] == [0, 1] and kept[0].message_count == 5
    two = topics.topics(turns, -9)  # cut everywhere
    contexts = {r.topic_id: r.context for r in render.preceding_context(turns, two).collect()}
    assert contexts["t1"] == "" and "[turn 1] USER (earlier)\nplease fix" in contexts["t2"] and "[turn 2] ASSISTANT (earlier)" in contexts["t2"]
    assert all(r.chars <= 400 + 80 for r in render.topic_slices(turns, two, 400).collect())


def test_digest_is_bounded(spark):
    turns = merged(spark, [("user", "q " * 3000), ("assistant", "a " * 9000)])
    d = render.digests(turns, normalize.sessions(turns), budget=3000, hard_max=2500).first()
    assert d.chars <= 2500 and d.text.startswith("# Session digest") and d.omitted > 0


def _key(*parts):
    return "".join(parts)  # assembled here, so that no scanner finds a whole one in this file


MUST = [
    ("jwt", "token " + _key("eyJ", "hbGciOiJIUzI1", ".eyJzdWIiOiIx", ".abcDEF_123")), ("github-token", _key("ghp", "_", "A1b2" * 9)), ("aws-access-key-id", _key("AKIA", "ABCDEFGHIJKLMNOP")),
    ("password", "postgres://me:" + _key("hunter", "2") + "@db.example/x"), ("labelled-secret", 'api_key = "' + _key("correct horse ", "battery") + '"'), ("env-secret", "DB_PASSWORD" + "=" + _key("ab!c1", ".x$y")),
    ("prose-secret", "the admin password is " + _key("Hunter", "2x9")), ("private-key", "-----BEGIN RSA " + "PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"), ("bearer-token", "Bearer " + _key("abcdef", "0123456789abcdef")),
    ("stripe-key", _key("sk_", "live_", "a1" * 12)), ("slack-webhook", _key("https://hooks.slack.com/", "services/", "T0/B0/" + "x" * 20)), ("sentry-dsn", "https://" + "0a" * 16 + "@o1.example.io/42"),
]
MUST_NOT = [
    "apiKey = getApiKey()", "token = config.secrets.openai", "API_KEY=your-key-here", "PASSWORD=${DB_PASS}", "a password is required", "the token is expired", "NOPASSWD: ALL", "client_secret: my-client-secret-value",
    "git commit 9fceb02d0ae598e95dc970b74767f19372d61af8", "sk-ssh-ed25519@openssh.com", "see https://example.com/a?b=c", "password: string",
]


def test_redaction_catches_and_spares(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in MUST] + MUST_NOT)], "id long, text string")
    got = {r.id: r for r in redact.redact_messages(rows).collect()}
    for i, (kind, before) in enumerate(MUST):
        assert f"[redacted:{kind}]" in got[i].text, (kind, before, got[i].text)
        assert kind in {f.kind for f in got[i].findings}
    for i, before in enumerate(MUST_NOT, len(MUST)):
        assert got[i].text == before and got[i].findings == []
    assert redact.redact_messages(spark.createDataFrame([(1, None)], "id long, text string")).first().text is None


def test_entropy_is_opt_in_and_patterns_can_be_added(spark):
    token = "q7Zp2Lx9Vb4Nc8Md1Kf6Jg3Hs5Tr0WyQaEuIoPl"
    rows = spark.createDataFrame([(1, f"see {token} now, ticket ACME-12345")], "id long, text string")
    assert redact.redact_messages(rows).first().findings == []
    found = redact.redact_messages(rows, redact.Redactor(entropy=True).with_pattern("ticket", r"ACME-\d+")).first()
    assert {f.kind for f in found.findings} == {"high-entropy", "ticket"}


def test_context_spares_tokens(spark):
    token = "q7Zp2Lx9Vb4Nc8Md1Kf6Jg3Hs5Tr0WyQaEuIoPl"
    spared = [f"see build/{token}", f"{token}.pdf", f"<a id={token}", f"https://x.example/?q={token}", f"[x](see {token}", f"SHA256: {token}", f"abc+ {token}"[:4] + token + "AAAA", f"data:font/woff;base64,x {token}"]
    for text in spared:
        at = text.index(token)
        assert not redact.is_random(text, at, at + len(token)), text
    assert redact.is_random(f"see {token} now", 4, 4 + len(token))


def test_only_marked_texts_are_claimed_in(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting(redact.Redactor):
        def findings(self, text, compiled, kinds=None):
            seen.add(1)
            return super().findings(text, compiled, kinds)

    rows = spark.createDataFrame([(1, "nothing to see here"), (2, "the admin password is " + _key("Hunter", "2x9")), (3, None)], "id long, text string")
    assert [r.text for r in sorted(redact.redact_messages(rows, Counting()).collect())] == ["nothing to see here", "the admin password is [redacted:prose-secret]", None]
    assert seen.value == 1


def test_marks_let_every_pattern_through():
    finder = redact.Marks(redact.MARKS)
    assert set(redact.MARKS) == {p[0] for p in redact.PATTERNS}
    for kind, text in MUST:
        assert any(kind in finder.kinds_in(t.encode()) for t in (text, text.upper())), kind


def test_batches_equal_claims_in_every_text():
    rng = random.Random(4)
    bits = [t for _, t in MUST] + ["é", "secret", "sk", "ＳＫ-", "pwd", "Token:", "= ", "\n", "plain words here ", "xo", "x", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 4))) for _ in range(600)] + [None, ""]
    array = pa.array(["skipped", *texts])[1:]  # a slice begins inside its buffers
    for redactor in (redact.Redactor(), redact.Redactor(entropy=True), redact.Redactor().with_pattern("x", "x+", marks=("X",)), redact.Redactor().with_pattern("x", "x+")):
        compiled = redactor.compiled()
        got = redactor.batch(array).to_pylist()
        want = [redactor.findings(t, compiled) if t is not None else [] for t in texts]
        assert [[(f["start"], f["end"], f["kind"]) for f in r["findings"]] for r in got] == want
        assert all(r["text"] == t for r, t, w in zip(got, texts, want, strict=True) if not w) and any(want)
    data, ends = np.frombuffer(b"abcsecretxy" * 600_000, np.uint8), np.arange(1, 600_001) * 11
    assert len(redact.Marks(redact.MARKS).suspects(data, ends)) == 600_000  # over the edges of parts
    assert redact.Redactor().batch(pa.array([], pa.string())).to_pylist() == []



def test_plan_deals_each_type_once_per_topic(spark):
    rows = [("s", f"t{i + 1}", f"label {i}", i * 2, i * 2 + 1, 1000, 1, True) for i in range(5)]
    found = spark.createDataFrame(rows, "session_id string, topic_id string, label string, msg_from int, msg_to int, chars long, exchanges long, kept boolean")
    deck = quiz.plan(found, 7, ("mcq", "cloze"), seed=1).orderBy("ordinal").collect()
    assert len(deck) == 4 and [list(d.types) for d in deck] == [["mcq", "cloze"], ["mcq", "cloze"], ["mcq", "cloze"], ["mcq"]] and deck[0].shortfall == 0
    assert quiz.plan(found, 20, seed=1).first().shortfall == 5
    assert [d.types for d in quiz.plan(found, 6, ()).collect()] == [[]]
    assert {d.msg_from for d in quiz.plan(found, 9, ("open",), from_message=6).collect()} == {6, 8}


def test_validation_keeps_good_questions_and_says_why_not(spark):
    import json

    qs = [
        {"type": "mcq", "prompt": " P ", "options": [{"key": "A", "text": "x"}, {"text": "y"}], "correctOptionKey": "B", "sourceTurns": [1, 99]},
        {"type": "mcq", "prompt": "p", "options": [{"key": "A", "text": "x"}], "correctOptionKey": "A"},
        {"type": "mcq", "prompt": "p", "options": [{"key": "A", "text": "x"}, {"key": "B", "text": "y"}], "correctOptionKey": "C"},
        {"type": "cloze", "prompt": "p", "codeWithGaps": "a {{blank_1}} {{blank_2}}", "blanks": [{"key": "blank_1", "answer": "x"}]},
        {"type": "cloze", "prompt": "p", "codeWithGaps": "a {{blank_1}}", "blanks": [{"key": "blank_1", "answer": "x"}]},
        {"type": "open", "prompt": "p", "rubric": []}, {"type": "essay", "prompt": "p"}, {"type": "open", "prompt": "", "rubric": [{"criterion": "c"}]},
    ]
    reply = json.dumps({"questions": qs, "flashcards": [{"front": "f", "back": "b", "sourceTurns": [0, 7]}, {"front": " ", "back": "b"}]})
    rows = spark.createDataFrame([("s", "t1", "L", 0, 3, ["mcq", "cloze", "open"], reply), ("s", "t2", "L", 0, 3, ["mcq"], "garbage")], "session_id string, topic_id string, label string, msg_from int, msg_to int, types array<string>, json string")
    questions, cards = quiz.validated(rows)
    got = {r.question_id or r.type: r for r in questions.collect()}
    assert got["t1-mcq-1"].issue is None and got["t1-mcq-1"].source_turns == [1] and got["t1-mcq-1"].options[1].key == "B"
    assert got["t1-mcq-2"].issue == "too few usable options" and got["t1-mcq-3"].issue == "correct key matches no option"
    assert got["t1-cloze-1"].issue == "no answer for blank_2" and got["t1-cloze-2"].issue is None and got["t1-open-1"].issue == "no rubric" and got["t1-open-2"].issue == "empty prompt"
    assert got["t1-essay-1"].issue == "not requested"
    assert [(c.front, c.source_turns) for c in cards.collect()] == [("f", [0])]


def test_grading_and_bands(spark):
    q = spark.createDataFrame(
        [("a", "q1", "mcq", "B", None, None), ("a", "q2", "cloze", None, [("blank_1", "rows.Close()", ["rows.close"]), ("blank_2", "x", None)], None), ("a", "q3", "open", None, None, [("c1", 3.0, []), ("c2", 1.0, [])]), ("a", "q4", "open", None, None, [("c", 1.0, [])])],
        "attempt_id string, question_id string, type string, correct_key string, blanks array<struct<key: string, answer: string, alternatives: array<string>>>, rubric array<struct<criterion: string, weight: double, must_mention: array<string>>>",
    )
    answers = spark.createDataFrame([("a", "q1", " b ", None), ("a", "q2", None, {"blank_1": '"ROWS.close"', "blank_2": "y"}), ("a", "q3", "text", None)], "attempt_id string, question_id string, value string, values map<string, string>")
    marks = spark.createDataFrame([("a", "q3", [1.0, 0.4])], "attempt_id string, question_id string, awarded array<double>")
    got = {r.question_id: r for r in quiz.grade(q, answers, marks).collect()}
    assert (got["q1"].awarded, got["q2"].awarded, got["q3"].awarded, got["q4"].awarded) == (1.0, 0.5, 0.85, 0.0) and got["q3"].correct and not got["q4"].attempted
    a = quiz.attempts(quiz.grade(q, answers, marks)).first()
    assert (a.score, a.max_score, a.answered, a.attempted, a.total, a.percentage, a.band) == (2.35, 4, 3, 3, 4, 58.8, "solid")
    bands = spark.createDataFrame([(-5.0,), (24.9,), (25.0,), (50.0,), (75.0,), (400.0,), (None,)], "p double").select(quiz.band(F.col("p"))).collect()
    assert [b[0] for b in bands] == ["unfamiliar", "unfamiliar", "partial", "solid", "strong", "strong", "unfamiliar"]


def test_store_round_trip(spark, tmp_path):
    from colloquy.schema import ATTEMPT, COVERAGE, QUIZ

    st = store.QuizStore(spark, str(tmp_path / "store"))
    turns = merged(spark, [("user", "one"), ("assistant", "two"), ("user", "three")])
    first = store.fingerprints(turns, F.lit(2)).first().fingerprint
    row = lambda model, made: spark.createDataFrame([("q1", "s", model, made, "same", "1", 2, first, "T", "[]", "[]", '[{"id": 1}]', None)], QUIZ)
    cover = spark.createDataFrame([("q1", "t1", "L", 0, 1)], COVERAGE)
    st.save(row("m1", 1), cover)
    st.save(row("m2", 2).withColumn("title", F.lit("changed")), cover)
    kept = st.table("quiz").collect()
    assert [(r.model, r.created_at, r.title) for r in kept] == [("m2", 2, "T")] and st.table("coverage").count() == 1
    assert store.covered_messages(st.table("coverage")).first().covered_messages == 2
    state = lambda key="same", version="1": store.staleness(turns, st.table("quiz"), key, version).first()
    assert (state().state, state().new_messages) == ("extended", 1) and state(version="2").state == "generator_stale"
    whole = turns.where("msg_idx < 2")
    assert store.staleness(whole, st.table("quiz"), "same").first().state == "fresh" and store.staleness(whole, st.table("quiz"), "other").first().state == "settings_changed"
    assert store.staleness(whole.withColumn("text", F.lit("new")), st.table("quiz"), "same").first().state == "diverged"

    attempt = lambda **k: spark.createDataFrame([tuple({"attempt_id": "a1", "quiz_id": "q1", "started_at": 5, "updated_at": 6, "completed_at": None, "position": 2, "answers": '{"q": "A"}', "results": None, "score": None, "max_score": None} .__or__(k)[n] for n in ATTEMPT.names)], ATTEMPT)
    st.save_progress(attempt())
    assert store.progress(st.table("attempt")).first().resumable
    st.finish(attempt(score=3.0, max_score=4.0, completed_at=9, updated_at=9))
    p = store.progress(st.table("attempt")).first()
    assert (p.resumable, p.completed, p.percentage, p.position) == (False, True, 75.0, 0)
    try:
        st.save_progress(attempt(quiz_id="nope"))
        raise AssertionError("an unknown quiz was accepted")
    except store.StoreError:
        pass
    try:
        st.save(row("m", 3).withColumn("questions", F.lit("[]")), cover)
        raise AssertionError("an empty quiz was saved")
    except store.StoreError:
        pass
    st.delete(st.table("quiz"))
    assert st.table("attempt").count() == 0 and st.table("quiz").count() == 0 and st.clear() == 0


def test_reports(spark):
    files = spark.createDataFrame([("a", "parsed", 10), ("a", "skipped", 5), ("b", "empty", 1)], "harness string, status string, length long")
    sessions = spark.createDataFrame([("s1", "a", True, 500, 3), ("s2", "a", False, 10, 9), ("s3", "c", True, 700, None)], "session_id string, harness string, quiz_ready boolean, chars long, updated_ms long")
    got = {r.harness: r for r in reports.harness_report(files, sessions).collect()}
    assert (got["a"].file_count, got["a"].skipped, got["a"].session_count, got["a"].total_chars) == (2, 1, 2, 510) and got["c"].file_count == 0 and got["b"].session_count == 0
    assert [r.session_id for r in reports.session_list(sessions).collect()] == ["s2", "s1", "s3"]
    named = sessions.withColumnsRenamed({"session_id": "title"})
    assert reports.search(named, " S1 ", ("title",)).count() == 1 and reports.search(named, "  ", ("title",)).count() == 3
    assert [(r.harness, r.size) for r in reports.grouped(sessions).collect()] == [("a", 2), ("c", 1)]


def _quiz(spark, *ids, title="T"):
    columns = {"session_id": F.lit("s"), "title": F.lit(title), "questions": F.lit('[{"q": 1}]'), "created_at": F.lit(1).cast("long")}
    rows = spark.createDataFrame([(i,) for i in ids], "quiz_id string")
    return rows.select([columns.get(f.name, F.col("quiz_id") if f.name == "quiz_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.QUIZ])


def test_concurrent_saves_lose_nothing(spark, tmp_path):
    none = spark.createDataFrame([], store.COVERAGE)
    both = threading.Barrier(2)
    conflicts = []

    class Slow(store.QuizStore):
        """Both writers have read the same version before either publishes."""

        first = True

        def _publish(self, version, manifest):
            if self.first:
                self.first = False
                both.wait(60)
            try:
                super()._publish(version, manifest)
            except store.Conflict:
                conflicts.append(version)
                raise

    stores = [Slow(spark, str(tmp_path / "store"), buckets=4) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: stores[k].save(_quiz(spark, f"q{k}", "shared", title=f"by {k}"), none), range(2)))
    st = stores[0]
    assert sorted(r.quiz_id for r in st.table("quiz").collect()) == ["q0", "q1", "shared"] and conflicts == [1] and st.version() == 2
    first = st.table("quiz", 1)
    assert first.count() == 2 and st.table("quiz").where("quiz_id = 'shared'").first().title == first.where("quiz_id = 'shared'").first().title


def test_failed_writes_leave_the_old_version_and_saves_write_changed_buckets_only(spark, tmp_path):
    none = spark.createDataFrame([], store.COVERAGE)
    st = store.QuizStore(spark, str(tmp_path / "store"), buckets=8)
    st.save(_quiz(spark, *(f"q{i}" for i in range(40))), none)
    before = st.manifest()
    with pytest.raises(Exception, match="broken"):
        st.commit(lambda table: {"quiz": (None, lambda old: old.withColumn("title", F.when(F.col("quiz_id") == "q7", F.raise_error(F.lit("broken"))).otherwise("new")))})
    assert st.manifest() == before and st.table("quiz").where("title <> 'T'").isEmpty()
    assert {f.name for f in (tmp_path / "store/data/quiz").iterdir()} == {f.split("/")[2] for f in before["tables"]["quiz"].values()}
    st.save(_quiz(spark, "q7", title="kept"), none, keep_progress=True)
    after = st.manifest()["tables"]["quiz"]
    assert sum(after[b] != f for b, f in before["tables"]["quiz"].items()) == 1 and st.table("quiz").count() == 40
    st.delete(_quiz(spark, *(f"q{i}" for i in range(39))))
    assert [r.quiz_id for r in st.table("quiz").collect()] == ["q39"] and st.table("quiz", 1).count() == 40
    assert st.vacuum(keep=1) > 0 and st.clear() == 1 and st.table("quiz").isEmpty() and st.version() == 4


def test_question_parts_are_trimmed_once(spark):
    """Lists of a question are worked out once, not at every use; keys are filled in for those that stay."""
    reply = {"questions": [
        {"type": "mcq", "prompt": " p ", "options": [{"key": "", "text": "\u00a0"}, {"key": " ", "text": " a "}, {"text": "b"}, {"key": " Z ", "text": "c\ufeff"}, None], "correctOptionKey": " B\n"},
        {"type": "cloze", "prompt": "p", "codeWithGaps": "{{blank_1}} {{blank_2}}", "blanks": [{"answer": " "}, {"key": "", "answer": " x "}, {"key": " blank_2 ", "answer": "y", "alternatives": [" z "]}]},
        {"type": "open", "prompt": "p", "rubric": [{"criterion": " "}, {"criterion": " c ", "weight": -1}], "options": [{"key": "A", "text": "no use"}]},
    ]}
    results = spark.createDataFrame([("s", "t", "L", 0, 9, ["mcq", "cloze", "open"], json.dumps(reply))], "session_id string, topic_id string, label string, msg_from int, msg_to int, types array<string>, json string")
    found = quiz.validated(results)[0]
    mcq, cloze, opened = sorted(found.collect(), key=lambda r: ["mcq", "cloze", "open"].index(r.type))
    assert (mcq.prompt, mcq.correct_key, [tuple(o) for o in mcq.options], mcq.issue) == ("p", "B", [("A", "a"), ("B", "b"), ("Z", "c")], None)
    assert ([tuple(b) for b in cloze.blanks], cloze.issue) == ([("blank_1", "x", None), ("blank_2", "y", [" z "])], None)
    assert ([tuple(r) for r in opened.rubric], opened.options, opened.issue) == ([("c", 1.0, None)], None, None)
    assert found.select("issue")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 7
