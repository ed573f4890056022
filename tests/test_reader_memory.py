"""What readers hand to Python workers, and how much at once."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from colloquy.plans import readers
from colloquy.sources import exports, json_docs, sqlite_source
from colloquy.sources.content import parts_of


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("source", ["json", "lines", "sqlite"])
def test_content_is_walked_once(spark, source):
    docs = spark.createDataFrame([("a", 0, "x", '{"messages": [], "chat_messages": []}')], "path string, pos long, harness string, j string").withColumn("v", F.try_parse_json("j"))
    store = spark.createDataFrame([("a", "messages", "table", "1", 1, "user", "hi", "1")], sqlite_source.SCHEMA)
    said = json_docs.read_json(docs)[0] if source == "json" else exports.line_messages(docs) if source == "lines" else sqlite_source.messages(store)
    assert _plan(said).count("ArrowEvalPython") == 1


def test_plain_contents_stay_in_the_jvm(spark):
    """Python gets a null for a plain string; its text comes out all the same, as do those of blocks, over more than one slice."""
    rows = spark.range(1201).select("id", F.when(F.col("id") % 2 == 0, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" t"), "id").alias("text"))))).otherwise(F.concat(F.lit('" s'), "id", F.lit(' "'))).alias("j"))
    out = rows.coalesce(1).select("id", parts_of(F.parse_json("j")).alias("p"))
    assert "_walked(CASE WHEN" in _plan(out)
    assert [r.p.text for r in out.orderBy("id").collect()] == [f"{'st'[k % 2 == 0]}{k}" for k in range(1201)]


@pytest.mark.parametrize("key_value", [False, True])
def test_databases_grow_in_number(spark, monkeypatch, key_value):
    monkeypatch.setattr(readers, "TURNS_PER_FILE", 100)
    rows = spark.range(2000).select((F.col("id") % 7).alias("n"), F.floor(F.col("id") / 7).alias("order"), F.concat_ws(":", F.lit("bubbleId"), F.floor(F.col("id") / 7), F.col("id") % 7).alias("key"), F.lit("v").alias("value"))
    rows = rows.select("*", F.col("order").cast("string").alias("session_id"), F.lit("user").alias("role"), F.col("n").cast("string").alias("content"), F.lit(1).cast("long").alias("created_at"))
    paths = readers._databases(spark, rows, key_value)
    assert len(paths) == 20
    found = []
    for path in paths:
        db = sqlite3.connect(path)
        mine = db.execute("SELECT key FROM cursorDiskKV ORDER BY rowid" if key_value else "SELECT 'x:' || session_id || ':' || content FROM messages ORDER BY rowid").fetchall()
        db.close()
        found.append([tuple(map(int, k.split(":")[1:])) for (k,) in mine])
        assert found[-1] == sorted(found[-1])
    assert sorted(sum(found, [])) == [(k // 7, k % 7) for k in range(2000)]


def test_json_array_keeps_plain_texts_from_python(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", " yes ")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = readers.reader_json_array(spark, str(tmp_path))
    assert _plan(out).count("ArrowEvalPython") == 1 and "_walked(CASE WHEN" in _plan(out)
    assert sorted((r.path, r.src_pos, r.role, r.text) for r in out.collect()) == [("/logs/1.json", 0, "user", "hi"), ("/logs/1.json", 1, "assistant", "yes")]
