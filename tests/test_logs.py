"""Growing logs against one full scan of them."""

import json
import random

from pyspark.sql import functions as F

from colloquy.operators import normalize
from colloquy.sources import jsonl, oplog
from colloquy.streaming import logs


def log_of(rng, n):
    out = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "assistant"])
        content = [{"type": "text", "text": f"said {i} é" + "\n" * rng.randrange(2)}] + ([{"type": "tool_use", "name": "read", "input": {"path": f"f{i}"}}] if role == "assistant" and rng.random() < 0.3 else [])
        out.append(json.dumps({"type": role, "uuid": f"u{i}", "sessionId": "s", "timestamp": 1_700_000_000 + i, "message": {"role": role, "content": content}}, ensure_ascii=False))
        if rng.random() < 0.1:
            out.append(rng.choice(["{broken", "", "plain"]))
    return ("\n".join(out) + "\n").encode()


def run(spark, stream, at, k):
    query = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").foreachBatch(lambda df, _: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{at}/out"))
    query.trigger(availableNow=True).start().awaitTermination(120)


def test_three_appends_equal_one_scan(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "logs" / "deep"
    folder.mkdir(parents=True)
    whole = {f"{folder}/{n}.jsonl": log_of(rng, size) for n, size in (("a", 60), ("b", 12), ("c", 1))}
    for k in range(3):
        for path, data in whole.items():
            end = len(data) if k == 2 else len(data) * (k + 1) // 3 + 1  # within lines and characters
            with open(path, "ab") as f:
                f.write(data[f.tell() : end])
        run(spark, logs.turns(spark, str(tmp_path / "logs"), "claude", range="300"), tmp_path, k)
    got = logs.upserted(spark.read.parquet(str(tmp_path / "out")))
    files = spark.createDataFrame([(p, d.decode()) for p, d in whole.items()], "path string, content string")
    said = normalize.cleaned(jsonl.read_jsonl(files)[0].withColumn("session_id", F.col("path")))
    want = normalize.merged_turns(said)
    columns = ["session_id", "msg_idx", "src_pos", "role", "text", "ts_ms", "merged"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    tools = {(r.session_id, r.msg_idx): [(t.name, t.input) for t in r.tools] for r in want.collect()}
    assert {(r.session_id, r.msg_idx): [(t["name"], t["input"]) for t in json.loads(r.tools)] for r in got.collect()} == tools
    with open(f"{folder}/b.jsonl", "wb") as f:  # rewritten, shorter
        f.write(whole[f"{folder}/c.jsonl"])
    run(spark, logs.turns(spark, str(tmp_path / "logs"), "claude", range="300"), tmp_path, 3)
    after = logs.upserted(spark.read.parquet(str(tmp_path / "out")))
    assert [r.text for r in after.where("session_id like '%/b.jsonl'").collect()] == [r.text for r in after.where("session_id like '%/c.jsonl'").collect()]
    assert after.where("session_id like '%/a.jsonl'").count() == got.where("session_id like '%/a.jsonl'").count()


def test_mutation_logs_fold_on(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    operations = [{"kind": 0, "v": {"requests": []}}, {"kind": 2, "k": ["requests"], "v": [{"m": 1}]}, {"kind": 1, "k": ["title"], "v": "é"}, {"kind": 2, "k": ["requests"], "v": [2, 3], "i": 1}, {"kind": 3, "k": ["title"]}]
    data = "".join(json.dumps(o) + "\n" for o in operations).encode()
    for k, end in enumerate((len(data) // 3, len(data) * 2 // 3, len(data))):
        with open(tmp_path / "logs/x.jsonl", "ab") as f:
            f.write(data[f.tell() : end])
        run(spark, logs.documents(spark, str(tmp_path / "logs")), tmp_path, k)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).first()
    assert json.loads(last.document) == oplog.fold(operations) == {"requests": [{"m": 1}, 2, 3]}


class Held:
    """A state of one value, or of a map."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None or bool(self.map)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.map.clear()

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def iterator(self):
        return list(self.map.items())


def test_ranges_in_any_order_give_each_line_once():
    from pyspark.sql import Row

    data = "".join(f"line {i} é\n" for i in range(40)).encode() + b"unfinished"
    rng = random.Random(1)
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, len(data)), 6))
        ranges = [Row(generation=0, start=a, data=data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        ranges += rng.sample(ranges, 2)  # some come twice
        rng.shuffle(ranges)
        processor = logs.Lines()
        processor.at, processor.early = Held(), Held()
        got = [r for k in range(0, len(ranges), 3) for r in processor.handleInputRows(("p",), iter(ranges[k : k + 3]), None)]
        assert [(r.pos, r.line) for r in got] == [(i, f"line {i} é") for i in range(40)] and not processor.early.map
