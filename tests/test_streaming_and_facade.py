import datetime as dt
import json
import time

from pyspark.sql import functions as F

from colloquy import udfs
from colloquy.engine import Conversations
from colloquy.streaming import pauses, staleness

COLUMNS = "session_id string, msg_idx long, role string, text string, covered_messages long, chain string"


def test_activity_of_a_batch(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([("s", at(m)) for m in (0, 10, 45, 46, 200)], "session_id string, ts timestamp")
    assert sorted((r.began.hour * 60 + r.began.minute, r.turns) for r in pauses.activity(rows).collect()) == [(0, 2), (45, 2), (200, 1)]


def test_staleness_on_a_stream(spark, tmp_path):
    chain = staleness.chain_of([("user", "a"), ("assistant", "b")])
    for k, rows in enumerate([[("s", 0, "user", "a", 2, chain), ("s", 1, "assistant", "b", 2, chain), ("n", 0, "user", "x", None, None)], [("s", 1, "assistant", "b", 2, chain), ("s", 2, "user", "c", 2, chain), ("d", 0, "user", "other", 1, chain)]]):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").json(str(tmp_path / f"in{k}"))
    got = {}
    (tmp_path / "in").mkdir()
    for k in range(2):
        source = spark.readStream.schema(COLUMNS).json(str(tmp_path / "in"))
        for f in (tmp_path / f"in{k}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        query = staleness.states(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        query.foreachBatch(lambda df, _: got.update({r.session_id: (r.state, r.new_messages) for r in df.collect()})).trigger(availableNow=True).start().awaitTermination(60)
        if k == 0:
            assert got == {"s": ("fresh", 0), "n": ("new", 0)}
    assert got == {"s": ("extended", 1), "n": ("new", 0), "d": ("diverged", 0)}


def test_sql_functions(spark):
    udfs.register_redaction("ticket", r"ACME-\d+")
    udfs.register_functions(spark)
    row = spark.sql("SELECT normalize_role('Human') AS a, to_epoch_ms('1700000000') AS b, jaccard(array('x'), array('x', 'y')) AS c, norm_answer(' \"Ab  c\"; ') AS d, redact('see ACME-77') AS e").first()
    assert tuple(row) == ("user", 1700000000000, 0.5, "ab c", "see [redacted:ticket]")


def test_titles_and_topics_in_sql(spark):
    from colloquy.functions.text import title_of
    from colloquy.operators import normalize, topics

    udfs.register_functions(spark)
    texts = ["# Heading of it\n\nmore", "```\ncode\n```\n  plain   line ", "", None, "w" * 100, "a b " * 40, "> - * quoted"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] == r[1] for r in rows.select(F.expr("derive_title(t)"), title_of(F.col("t"))).collect() if r[1] is not None or r[0] is not None].count(False) == 0
    turns = normalize.merged_turns(normalize.cleaned(normalize.from_conversations(spark.createDataFrame([(1, 0, "user", "one two three"), (1, 1, "assistant", "four"), (1, 2, "user", "separately another matter")], "conv_id long, turn long, role string, text string"))))
    udfs.register_views(spark, turns, threshold=1.0)
    got = spark.sql("SELECT s.session_id, s.messages, count(*) AS topics, min(t.label) AS first FROM sessions s JOIN topics t USING (session_id) GROUP BY ALL").first()
    assert tuple(got) == ("1", 3, topics.topics(turns, 1.0).count(), "one two three")


def test_progress_can_be_read_while_a_stream_runs(spark, tmp_path):
    from colloquy.streaming.progress import ProgressTable

    table = ProgressTable(spark, str(tmp_path / "progress"))
    listener = table.listener()
    spark.streams.addListener(listener)
    try:
        seen = []
        rate = spark.readStream.format("rate").option("rowsPerSecond", 200).load()
        query = rate.writeStream.queryName("ticks").foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        for _ in range(60):
            time.sleep(1)
            seen.append(table.read().where("source = 'stream' and event = 'progress'").agg(F.coalesce(F.max("rows_so_far"), F.lit(0))).first()[0])
            if query.isActive and len({s for s in seen if s}) >= 2:
                break
        assert query.isActive and seen == sorted(seen) and len({s for s in seen if s}) >= 2
        query.stop()
        for _ in range(30):
            if table.read().where("event = 'ended'").count():
                break
            time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    rows = table.read().where("source = 'stream'").orderBy("at_ms").collect()
    assert rows[0].event == "started" and rows[0].name == "ticks" and rows[-1].event == "ended" and {r.event for r in rows} == {"started", "progress", "ended"}
    batches = [r.batch for r in rows if r.event == "progress"]
    assert batches == sorted(batches)


def test_facade_generates_from_redacted_slices(spark):
    secret = "AKIA" + "ABCDEFGHIJKLMNOP"
    turns = [(1, 0, "user", f"please explain the parser design {secret} " + "detail " * 60), (1, 1, "assistant", "because " * 120), (2, 0, "user", "hi"), (2, 1, "assistant", "hello")]
    chats = Conversations.of_table(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    chats.turns = chats.turns.cache()
    assert [r.session_id for r in chats.list().collect()] == ["1", "2"] and chats.search("parser").count() == 1
    assert {r.session_id: (r.ready, r.level) for r in chats.readiness(1).collect()} == {"1": (True, "ready"), "2": (False, "thin")}

    def model(prompt):
        assert "AKIA" not in prompt and "parser design" in prompt
        return json.dumps({"questions": [{"type": "open", "prompt": "why", "rubric": [{"criterion": "c"}], "sourceTurns": [0, 5]}], "flashcards": []})

    questions, cards = chats.generate(model, 1, ("open",))
    assert [(r.question_id, r.issue, r.source_turns) for r in questions.collect()] == [("t1-open-1", None, [0])] and cards.count() == 0
    assert chats.payloads().where(F.size("findings") > 0).count() == 1 and chats.digests(hard_max=500).where("chars > 500").count() == 0
