import json
import sqlite3

import pytest

from colloquy.operators import normalize
from colloquy.sources import discovery, exports, oplog, registry, scan, sqlite_source


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n"


PARTS = [{"type": "text", "text": "I will edit"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py"}}, {"type": "thinking", "thinking": "hmm"}, {"type": "tool_result", "content": "noise"}]
#: name -> (content, expected [(role, text)])
LOGS = {
    "pi.jsonl": (lines({"type": "session", "id": "p1", "cwd": "/w/pi", "version": 1, "timestamp": "2024-01-01T00:00:00Z"}, {"type": "message", "message": {"role": "user", "content": "hi"}, "timestamp": 1700000000}, {"type": "message", "message": {"role": "assistant", "content": PARTS}}), [("user", "hi"), ("assistant", "I will edit")]),
    "claude.jsonl": (lines({"type": "summary", "summary": "x"}, {"type": "user", "uuid": "u", "parentUuid": None, "sessionId": "c1", "cwd": "/w/cl", "message": {"role": "user", "content": "q"}}, "{broken", {"type": "assistant", "uuid": "v", "sessionId": "c1", "message": {"role": "assistant", "content": PARTS}}, {"type": "user", "uuid": "m", "sessionId": "c1", "isMeta": True, "message": {"role": "user", "content": "meta"}}), [("user", "q"), ("assistant", "I will edit")]),
    "rollout-1.jsonl": (lines({"type": "session_meta", "payload": {"id": "x1", "cwd": "/w/one"}}, {"type": "turn_context", "payload": {"cwd": "/w/two"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "went"}}), [("user", "go"), ("assistant", "went")]),
    "history.jsonl": (lines({"session_id": "h", "ts": 1700000000, "text": "only user"}), [("user", "only user")]),
    "transcript.jsonl": (lines({"step_index": 0, "source": "USER_EXPLICIT", "created_at": "2024-01-01T00:00:00Z", "content": '<USER_REQUEST>look<ADDITIONAL_METADATA>{"cwd":"/w/ag"}</ADDITIONAL_METADATA></USER_REQUEST>'}, {"step_index": 1, "source": "MODEL", "created_at": "2024-01-01T00:01:00Z", "content": "seen"}), [("user", "look"), ("assistant", "seen")]),
    "events.jsonl": (lines({"type": "session.start", "data": {"sessionId": "e1"}}, {"type": "session.title", "data": {"title": "Named"}}, {"type": "user.message", "data": {"content": "a"}}, {"type": "assistant.message", "data": {"content": "b"}}), [("user", "a"), ("assistant", "b")]),
    "session.jsonl": (lines({"type": "user/message", "data": {"content": "a"}}, {"type": "assistant/message", "data": {"content": "b"}}), [("user", "a"), ("assistant", "b")]),
    "updates.jsonl": (lines({"info": {"cwd": "/w/g", "id": "g1"}}, *({"timestamp": 1700000000, "params": {"update": {"sessionUpdate": k, "content": {"type": "text", "text": t}}}} for k, t in (("user_message_chunk", "the "), ("user_message_chunk", "stream"), ("agent_message_chunk", "is "), ("agent_message_chunk", "readable")))), [("user", "the stream"), ("assistant", "is readable")]),
    "wire.jsonl": (lines({"type": "context.append_message", "time": 1700000000, "message": {"role": "user", "content": "k"}}, {"type": "context.append_loop_event", "event": {"part": {"type": "think", "think": "x"}}}, {"type": "context.append_loop_event", "event": {"part": {"type": "text", "text": "one"}}}, {"type": "context.append_loop_event", "event": {"part": {"type": "text", "text": "two"}}}, {"type": "context.append_message", "message": {"role": "user", "content": "again"}}), [("user", "k"), ("assistant", "one\ntwo"), ("user", "again")]),
    "generic.jsonl": (lines({"role": "human", "content": "g"}, {"type": "token_count", "role": "assistant", "content": "no"}, {"payload": {"role": "ai", "content": [{"text": "nested"}]}}), [("user", "g"), ("assistant", "nested")]),
    "vscode.jsonl": (lines({"kind": 0, "v": {"sessionId": "v1", "customTitle": "T", "requests": []}}, {"kind": 2, "k": ["requests"], "v": [{"message": {"text": "ask"}, "response": [{"value": "par"}]}]}, {"kind": 2, "k": ["requests", 0, "response"], "v": [{"value": "answer"}, "more"], "i": 0}, {"kind": 1, "k": ["x", "y"], "v": 1}, {"kind": 9}), [("user", "ask"), ("assistant", "answer\n\nmore")]),
    "continue.json": (json.dumps({"history": [{"message": {"role": "user", "content": "c"}}, {"message": {"role": "assistant", "content": "d"}}], "workspaceDirectory": "/w/c", "sessionId": "k", "title": "CT"}), [("user", "c"), ("assistant", "d")]),
    "thread.json": (json.dumps({"id": "T", "messages": [{"role": "user", "content": [{"type": "text", "text": "t"}]}, {"role": "assistant", "content": "u"}]}), [("user", "t"), ("assistant", "u")]),
    "api_conversation_history.json": (json.dumps([{"role": "user", "content": "m"}, {"role": "assistant", "content": PARTS}, {"x": 1}]), [("user", "m"), ("assistant", "I will edit")]),
    "chat.md": ("# aider chat started at 2024-01-01 10:00:00\n\npreamble\n#### first line\n#### second line\n\nanswer\n```\n#### verbatim\n```\n> Tokens: 5\nafter tool\n#### next\n", [("user", "first line\nsecond line"), ("assistant", "answer\n```\n#### verbatim\n```"), ("assistant", "after tool"), ("user", "next")]),
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stores")
    stores = []
    for name, (content, _) in LOGS.items():
        (root / name).write_text(content)
        stores.append(("h-" + name.split(".")[0], "markdown" if name.endswith("md") else "jsonl", str(root / name)))
    import zstandard

    (root / "packed.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(lines({"role": "user", "content": "packed"}, {"role": "assistant", "content": "yes"}).encode()))
    (root / "sessions.json").write_text("[]")
    (root / "blob.bin").write_text("x")
    (root / "empty.jsonl").write_text("nothing here")
    stores += [("h-zst", "jsonl", str(root / "packed.jsonl.zst")), ("h-index", "json", str(root / "sessions.json")), ("h-blob", "detect-only", str(root / "blob.bin")), ("h-empty", "jsonl", str(root / "empty.jsonl"))]

    db = sqlite3.connect(root / "chat.db")
    db.executescript("CREATE TABLE other(a); CREATE TABLE messages(session_id, role, content, created_at); INSERT INTO messages VALUES('s1','user','hello',1700000000),('s1','assistant','[{\"type\":\"text\",\"text\":\"there\"}]',1700000001),('s2','user','second',NULL);")
    db.close()
    db = sqlite3.connect(root / "state.vscdb")
    db.execute("CREATE TABLE cursorDiskKV(key TEXT, value BLOB)")
    for k, v in (("bubbleId:b1:1", {"type": 1, "text": "kv ask"}), ("bubbleId:b1:2", {"type": 2, "text": "kv answer"}), ("other", {"text": "no"})):
        db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (k, json.dumps(v).encode()))
    db.commit()
    db.close()
    (root / "dump.sql").write_text("CREATE TABLE message(conversation_id, sender, body); INSERT INTO message VALUES('c','human','from sql');")
    stores += [("h-db", "sqlite", str(root / "chat.db")), ("h-kv", "sqlite-kv", str(root / "state.vscdb")), ("h-sql", "sqlite", str(root / "dump.sql"))]

    tree = [{"conversation_id": "w1", "title": "Web", "current_node": "c", "mapping": {"r": {"parent": None, "children": ["a"], "message": None}, "a": {"parent": "r", "children": ["b", "c"], "message": {"author": {"role": "user"}, "content": {"parts": ["ask"]}, "create_time": 1700000000.5}}, "b": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["old branch"]}}}, "c": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["shown branch"]}}}}}]
    (root / "conversations.json").write_text(json.dumps(tree))
    (root / "conversations.jsonl").write_text(lines({"uuid": "l1", "name": "Line", "chat_messages": [{"sender": "human", "text": "one", "created_at": "2024-01-01T00:00:00Z"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "two"}]}]}))
    stores += [("h-tree", "chatgpt-export", str(root / "conversations.json")), ("h-lines", "claude-web-export", str(root / "conversations.jsonl"))]
    messages, files = scan.scan(spark, stores)
    return messages.cache(), files.cache()


def told(messages, harness):
    rows = normalize.cleaned(messages.where(messages.harness == harness)).orderBy("session_id", "src_pos").collect()
    return [(r.role, r.text) for r in rows]


@pytest.mark.parametrize("name", LOGS)
def test_dialects(scanned, name):
    assert told(scanned[0], "h-" + name.split(".")[0]) == LOGS[name][1]


def test_other_stores(scanned):
    messages, _ = scanned
    assert told(messages, "h-zst") == [("user", "packed"), ("assistant", "yes")]
    assert told(messages, "h-db") == [("user", "hello"), ("assistant", "there"), ("user", "second")]
    assert told(messages, "h-kv") == [("user", "kv ask"), ("assistant", "kv answer")]
    assert told(messages, "h-sql") == [("user", "from sql")]
    assert told(messages, "h-tree") == [("user", "ask"), ("assistant", "shown branch")]
    assert told(messages, "h-lines") == [("user", "one"), ("assistant", "two")]


def test_context_tools_and_outcomes(scanned):
    messages, files = scanned
    by = {r.harness: r for r in messages.collect() if r.role == "user"}
    assert by["h-pi"].cwd == "/w/pi" and by["h-pi"].native_id == "p1" and by["h-rollout-1"].cwd == "/w/two" and by["h-transcript"].cwd == "/w/ag"
    assert by["h-events"].title == "Named" and by["h-continue"].title == "CT" and by["h-vscode"].native_id == "v1" and by["h-tree"].ts_ms == 1700000000500
    edit = next(r for r in messages.collect() if r.harness == "h-claude" and r.role == "assistant")
    assert edit.tools[0].name == "Edit" and json.loads(edit.tools[0].input) == {"file_path": "a.py"} and edit.thinking_chars == 3
    status = {r.harness: (r.status, r.reason) for r in files.collect()}
    assert status["h-index"] == ("skipped", "index file") and status["h-blob"][0] == "detected_only" and status["h-empty"][0] == "empty" and status["h-pi"][0] == "parsed"


def test_oplog_fold():
    ops = [{"kind": 1, "k": ["a"], "v": 1}, {"kind": 0, "v": {"l": [1, 2, 3]}}, {"kind": 2, "k": ["l"], "v": [9], "i": 1}, {"kind": 1, "k": ["m", 0, "x"], "v": "y"}, {"kind": 3, "k": ["l", 0]}, {"kind": 2, "k": ["new"], "v": [1]}, {"nonsense": 1}]
    assert oplog.fold(ops) == {"l": [None, 9], "m": [{"x": "y"}], "new": [1]}
    assert oplog.fold([{"kind": 1, "k": ["a"], "v": 1}]) is None


def test_export_paths_survive_loops():
    m = {"a": {"parent": "b", "children": ["b"]}, "b": {"parent": "a", "children": ["a"]}}
    assert set(exports.path_through(m, "a")) == {"a", "b"} and exports.path_through({}, None) == []
    assert exports.path_through({"r": {"children": ["x", "y"]}, "x": {"parent": "r"}, "y": {"parent": "r"}}, None) == ["r", "y"]


def test_templates():
    p = discovery.Platform("linux", "/home/u", {"A": "/alpha"}, "/proj")
    assert discovery.expand("${A:-~/x}/*.json", p) == ["/alpha/*.json"] and discovery.expand("${B:-~/x}/*.json", p) == ["/home/u/x/*.json"]
    assert discovery.expand("${B:-${A:-~/x}}/y", p) == ["/alpha/y"] and discovery.expand("${B}/**/c.json", p) == [] and discovery.expand("%APPDATA%/x", p) == []
    assert discovery.expand("<project>/.c/d.db", p) == ["/proj/.c/d.db"] and len(discovery.expand("<vscode-User>/x", p)) == 7
    windows = discovery.Platform("windows", "C:/Users/u", {"APPDATA": "C:\\Users\\u\\AppData\\Roaming"})
    assert discovery.expand("%APPDATA%/Code/x", windows) == ["C:/Users/u/AppData/Roaming/Code/x"] and discovery.expand("/**", p) == []
    assert discovery.matches("/a/b/c/d.json", "/a/**/d.json") and discovery.matches("/a/d.json", "/a/**/d.json") and not discovery.matches("/a/b/d.jsonl", "/a/*/d.json")


def test_walk_finds_dot_files_once(tmp_path):
    (tmp_path / ".p/sessions/x").mkdir(parents=True)
    (tmp_path / ".p/sessions/x/1.jsonl").write_text("")
    found = discovery.store_files([("pi", "pi", "jsonl", ["~/.p/sessions/**/*.jsonl", "~/.p/sessions/*/*.jsonl"])], discovery.Platform(home=str(tmp_path)))
    assert found == [("pi", "jsonl", str(tmp_path / ".p/sessions/x/1.jsonl"))]


def test_registry(spark):
    base = registry.registry(spark)
    assert base.count() == len(registry.rows()) == 36
    more = spark.createDataFrame([("pi", ["/more"])], "id string, store_paths array<string>")
    extra = spark.createDataFrame([("pi", "dup", "x", ["/no"]), ("new", "New", "jsonl", ["/n"])], base.schema)
    got = {r.id: r for r in registry.merged(base, more, extra).collect()}
    assert len(got) == 37 and got["pi"].store_paths[-1] == "/more" and got["pi"].display_name == "pi" and got["new"].store_paths == ["/n"]


def test_broken_database_gives_no_rows(spark, tmp_path):
    (tmp_path / "bad.db").write_text("not a database, " * 100)
    assert sqlite_source.read_sqlite(spark, [str(tmp_path / "bad.db"), str(tmp_path / "gone.db")]).count() == 0
    assert sqlite_source.read_sqlite(spark, []).count() == 0


def test_key_prefix_is_pushed(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.vscdb")
    db.execute("CREATE TABLE ItemTable(key TEXT, value BLOB)")
    db.executemany("INSERT INTO ItemTable VALUES (?, ?)", [(f"bubbleId:{s}:1", '{"type": 1, "text": "t"}') for s in ("aa", "ab", "b")])
    db.commit()
    db.close()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = sqlite_source.read_sqlite(spark, [str(tmp_path / "s.vscdb")])
    assert sorted(r.session for r in rows.where("session like 'a%'").collect()) == ["aa", "ab"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_sqlite_is_read_in_ranges_and_only_where_asked(spark, tmp_path):
    path = str(tmp_path / "big.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE messages(session_id TEXT, role TEXT, content TEXT, body TEXT, created_at INTEGER)")
    db.executemany("INSERT INTO messages VALUES (?, 'user', ?, 'b', 1)", [(f"s{i % 7}", f"text {i}" if i % 3 else "") for i in range(1000)])
    db.execute("DELETE FROM messages WHERE rowid % 10 = 0")
    db.execute("CREATE VIEW talk AS SELECT 1 AS x")
    db.commit()
    whole = sqlite_source.read_sqlite(spark, [path])
    split = sqlite_source.read_sqlite(spark, [path], range="64")
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and whole.count() == 900
    reader = sqlite_source.SqliteReader({"paths": path, "range": "64"}, ["pos", "payload"])
    read = [len(list(reader.read(p))) for p in reader.partitions()]
    assert sum(read) == 900 and max(read) <= 64
    narrow = sqlite_source.read_sqlite(spark, [path], columns="session,pos")
    assert narrow.columns == ["session", "pos"] and sorted(map(tuple, narrow.collect())) == sorted((r.session, r.pos) for r in whole.collect())
    asked = []
    db.set_trace_callback(asked.append)
    list(sqlite_source.table_rows(db, path, "messages", sqlite_source.tables(db)["messages"], 0, 10, ["session", "pos"]))
    assert "content" not in asked[-1] and "session_id" in asked[-1]
    db.set_trace_callback(None)
    db.executescript("DROP TABLE messages; CREATE TABLE keys(id TEXT PRIMARY KEY, role TEXT, text TEXT) WITHOUT ROWID; INSERT INTO keys VALUES ('a', 'user', 'no row ids')")
    db.close()
    assert [(r.pos, r.payload) for r in sqlite_source.read_sqlite(spark, [path], range="1").collect()] == [(0, "no row ids")]


def test_sqlite_stream_goes_on_behind_the_last_row(spark, tmp_path):
    path, out = str(tmp_path / "grow.db"), str(tmp_path / "out")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE messages(session_id TEXT, role TEXT, content TEXT)")
    for k, n in enumerate((5, 0, 12)):
        db.executemany("INSERT INTO messages VALUES ('s', 'user', ?)", [(f"{k}.{i}",) for i in range(n)])
        db.commit()
        stream = sqlite_source.stream_sqlite(spark, [path], range="4").writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").trigger(availableNow=True)
        stream.start(out).awaitTermination(60)
    db.close()
    got = spark.read.parquet(out).orderBy("pos").collect()
    assert [(r.pos, r.payload) for r in got] == list(enumerate([f"0.{i}" for i in range(5)] + [f"2.{i}" for i in range(12)], 1))


def test_discovery_by_frontier_equals_the_walk(spark, tmp_path):
    from colloquy.sources import listing

    for name in ("a/x.jsonl", "a/b/c/y.jsonl", "a/b/z.txt", "q/h1.json", "q/deep/h2.json", "other/x.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    platform = discovery.Platform("linux", str(tmp_path), {}, "")
    harnesses = [("h1", "H1", "jsonl", ["~/a/**/*.jsonl"]), ("h2", "H2", "json", ["~/q/h[0-9].json", "~/q/*/h?.json"]), ("h3", "H3", "jsonl", ["~/gone/*.jsonl"])]
    found, cuts = listing.discovered(spark, harnesses, platform)
    assert sorted((r.harness, r.kind, r.path) for r in found.collect()) == sorted(discovery.store_files(harnesses, platform)) and cuts.count() == 0
    few, over = listing.discovered(spark, harnesses, platform, only=("h1",), most=1)
    assert few.count() == 1 and [r.reason for r in over.collect()] == ["more files of h1"]
    files, cut = listing.listed(spark, [str(tmp_path)], max_depth=2)
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in cut.collect()) == ["/a/b", "/q/deep"] and {r.reason for r in cut.collect()} == {"depth"}
    assert {r.reason for r in listing.listed(spark, [str(tmp_path)], max_entries=2)[1].collect()} == {"entries"}


def test_workspaces_beside_chats_give_their_folders(spark, tmp_path):
    chat = tmp_path / "ws1" / "chatSessions" / "c.json"
    chat.parent.mkdir(parents=True)
    chat.write_text(json.dumps({"requests": [{"message": {"text": "ask"}, "response": [{"value": "answer"}]}], "sessionId": "k"}))
    (tmp_path / "ws1" / "workspace.json").write_text(json.dumps({"folder": "file:///w/proj"}))
    said, _ = scan.scan(spark, [("vscode", "json", str(chat))])
    assert {(r.cwd, r.project) for r in said.collect()} == {("/w/proj", "w/proj")}
