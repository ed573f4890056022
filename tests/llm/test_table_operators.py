"""WARC, URL filters, top-k, tool calls, mixing and the pipeline."""

import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing, queries, tool_chat, topk, url_filter, warc


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\n", "same é"), (2, None, "same é"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 2_000_000), (6, "u", "same é"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_warc(pages.repartition(2), f"file://{tmp_path}/w")
    got = {int(r.row_id): r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert {i: (r.record_type, r.refers_to_row) for i, r in got.items()} == {1: ("revisit", "6"), 2: ("revisit", "6"), 3: ("revisit", "4"), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[i].digests_ok
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == body
    assert got[1].refers_to_id == got[6].record_id
    assert warc.round_trip(pages.limit(0)).count() == 0
    some = warc.round_trip(pages, least_revisit_bytes=3, most_broadcast=0)
    assert {int(r.row_id): r.record_type for r in some.collect()} == {i: "revisit" if i in (1, 2) else "response" for i in range(1, 8)}


def test_warc_of_repeated_rows_null_ids_and_foreign_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "a"), (None, "u", None), (2, "u", "b")], "page_id long, url string, html string")
    read = warc.round_trip(pages).collect()
    assert sorted((r.row_id or "", r.record_type, r.refers_to_row or "", r.payload_bytes) for r in read) == [
        ("", "response", "", 0), ("", "revisit", "2", 1), ("1", "revisit", "2", 1), ("1", "revisit", "2", 1), ("2", "response", "", 1), ("2", "response", "", 1),
    ]
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    (tmp_path / "crawl.warc.gz").write_bytes(warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc._base32(block)), ("WARC-Payload-Digest", "sha1:" + warc._base32(b"body"))], block))
    (got,) = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert (got.row_id, bytes(got.payload), got.digests_ok) == (None, b"body", True)


def test_warc_framing_and_digests():
    good = warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc._base32(b"a\r\n\r\nbody"))], b"a\r\n\r\nbody")
    assert good[-1:] == b"\0"
    two = list(warc.records(good + good, chunk=7))
    assert [b for _, b in two] == [b"a\r\n\r\nbody"] * 2 and two[0][0]["content-length"] == "9"
    big = warc.member([("WARC-Type", "response")], b"z" * (17 << 20))
    assert big[-1:] == b"\0" and [len(b) for _, b in warc.records(big + good)] == [17 << 20, 9]
    with pytest.raises(ValueError):
        list(warc.records(good[:-9]))
    import gzip

    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")))


URLS = ["http://example.com/en/a", "https://www.example.com/en/", "http://x.WWW.example.com/en/q?z#t", "http://example.com/de/", "http://a.net/es/x", "http://net/fr/", "http://net.org/fr/", "http://badnet/fr/", "http://example.com", "http://example.com?x=/en/", "no scheme", "", None, "://", "http://é.net/es/", "ftp://host:80/p"]


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: min(ends, default=len(rest))])
    path = rest[min(ends, default=len(rest)) :]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules_equal_brute_force(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = url_filter.judge_urls(frame, url_filter.rules_frame(spark)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted(((i, *brute_rule(u, url_filter.RULES)) for i, u in enumerate(URLS * 2)))
    assert url_filter.judge_urls(frame.limit(0), url_filter.rules_frame(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(frame, url_filter.rules_frame(spark).limit(0)).collect()} == {"allow"}


def test_a_list_beyond_the_bits_of_a_plan_is_judged_in_shards(spark):
    rules = [("block" if i % 3 else "allow", f"s{i % 41}.com", f"/{i:03}") for i in range(400)] + [("allow", "com", "/"), *url_filter.RULES[1:]]
    urls = [f"http://a.s{i % 50}.com/{i % 500:03}/x?q" for i in range(1500)] + URLS
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(4)
    total = url_filter.cascade_bits(len(rules), 4000)
    made, build = [], url_filter.build_cascade
    try:
        url_filter.build_cascade = lambda *a, **k: made.append(build(*a, **k)) or made[-1]
        got = url_filter.judge_urls(frame, url_filter.rules_frame(spark, rules), most_bits=total // 3)
    finally:
        url_filter.build_cascade = build
    assert len(made) >= 6 and all(sum(x.bits for c in pair for x in c.levels) < total for pair in zip(made[::2], made[1::2], strict=True))
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == sorted((i, *brute_rule(u, rules)) for i, u in enumerate(urls))


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key rlike '[05]$' and length(key) < 5")
    cascade = url_filter.build_cascade(listed, keys.unionAll(keys))
    assert len(cascade.levels) >= 2
    got = {r.key for r in keys.where(cascade.holds(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}
    assert keys.where(url_filter.build_cascade(listed.limit(0), keys).holds(F.col("key"))).count() == 0


def brute_top(rows, asked, k):
    import math

    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q in asked:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,dims", [(1000, 8), (3, 3)])
def test_top_k_equals_brute_force(spark, block, dims):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(20)]) for i in range(300)] + [(300 + i, [0.5] * 20) for i in range(9)]
    rows += [(400, None), (401, [float("nan")] * 20), (402, [None] + [0.1] * 19), (403, [float("inf")] * 20), (404, []), (405, [0.9])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = topk.exact_top_k(frame, frame.where("vec_id % 50 = 0 or vec_id > 298"), 5, query_block=block, dim_block=dims)
    asked = {i for i, _ in rows if i % 50 == 0 or i > 298}
    assert sorted(map(tuple, got.collect())) == brute_top(rows, asked, 5)


def test_top_k_holds_one_block_of_queries_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    live, most = set(), []
    make, destroy = SparkContext.broadcast, Broadcast.destroy

    def made(self, value):
        out = make(self, value)
        live.add(id(out))
        most.append(len(live))
        return out

    def gone(self, blocking=False):
        live.discard(id(self))
        destroy(self, blocking)

    monkeypatch.setattr(SparkContext, "broadcast", made)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.exact_top_k(frame, frame.where("vec_id % 4 = 0"), 3, query_block=10)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, {i for i, _ in rows if i % 4 == 0}, 3)
    assert len(most) == 5 and max(most) == 1 and not live


def test_top_k_of_few_and_large(spark):
    frame = spark.createDataFrame([(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, 0.0])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(frame, frame.where("vec_id = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute_top([(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, 0.0])], {0}, 5)
    assert topk.exact_top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "f", '{"b": 1, "a": {"z": [1], "y": "é"}}', None), (1, "b", 2, "f", '{"b": "x"}', "a"), (1, "c", 4, "g", "{}", "b"), (1, "d", 6, "f", "nonsense", "gone"), (2, "x", 0, "f", '{"b": 2.5}', "y"), (2, "y", 1, "f", None, "x"), (1, "a", 9, "f", "{}", None), (None, "n", 1, "f", "{}", None)],
        "conv_id long, call_id string, turn long, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, "a", 1, 'said "so"\n'), (1, "a", 0, "earlier"), (1, "b", 3, None), (1, "zz", 3, "orphan")], "conv_id long, call_id string, turn long, content string")
    schemas = tool_chat.schemas_frame(spark, (("f", (("b", "integer", True), ("a", "object", False))),))
    got = {r.call_id: r for r in tool_chat.link_tool_calls(calls, results, schemas).collect()}
    assert {k: (r.status, r.level) for k, r in got.items()} == {"a": ("linked", 0), "b": ("linked", 1), "c": ("unanswered", 2), "d": ("unanswered", 0), "x": ("circular", None), "y": ("circular", None)}
    assert got["a"].json == '{"arguments":{"a":{"y":"é","z":[1]},"b":1},"id":"a","name":"f","result":"earlier"}'
    assert json.loads(got["b"].json)["result"] is None and json.loads(got["d"].json)["arguments"] == "nonsense"
    assert {k: r.errors for k, r in got.items()} == {"a": [], "b": ["mistyped b"], "c": ["no such tool"], "d": ["not an object"], "x": ["mistyped b"], "y": ["not an object"]}
    assert tool_chat.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_calls_hold_whole_texts(spark):
    said = {(1, 0): ("system", "Be brief,\nalways."), (1, 1): ("assistant", "ok"), (1, 2): ("user", 'What is "é" ?'), (1, 3): ("assistant", "a letter"), (2, 0): ("user", None), (2, 2): ("user", "")}
    turns = spark.createDataFrame([(*k, *v) for k, v in said.items()], "conv_id long, turn long, role string, text string")
    calls, results = tool_chat.from_conversations(turns)
    got = {(r.conv_id, r.turn): r for r in tool_chat.link_tool_calls(calls, results, tool_chat.schemas_frame(spark)).collect()}
    assert {k: json.loads(r.json)["arguments"].get("text") for k, r in got.items()} == {k: t for k, (role, t) in said.items() if role != "assistant"}
    assert {k: r.errors for k, r in got.items()} == {(1, 0): [], (1, 2): [], (2, 0): ["missing first", "missing text"], (2, 2): []}


def brute_targets(sizes):
    total = 1.5 * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(full.values())
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 2 * sizes[s]]
        if not over:
            return target | full
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix_targets_and_copies(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "c", "é", None] + ["hot"] * 5)) for i in range(800)] + [(5000, None, "empty"), (5001, "", "empty")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, rate string")
    plan = {r.doc_id: r for r in mixing.plan_mix(frame).collect()}
    sizes: dict = {}
    for i, t, s in rows:
        assert plan[i].size == len((t or "").split())
        sizes[s] = sizes.get(s, 0) + plan[i].size
    want = brute_targets(sizes)
    for s, t in want.items():
        mine = [plan[i] for i, _, x in rows if x == s]
        assert all(abs(r.target - t) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= 0.03 * max(t, 1) + 20
    assert {i: r.taken for i, r in plan.items()} == {r.doc_id: r.taken for r in mixing.plan_mix(frame.repartition(5)).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == ["doc_id", "text", "source", "rate", "copy"] and mixed.where("rate <> 'clash'").count() == 0
    assert mixed.count() == sum(r.copies for r in plan.values())
    assert mixing.plan_mix(frame.limit(0)).count() == 0 and mixing.mix(frame.where("source = 'empty'")).count() == 0


def test_pipeline_takes_effect(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(10)
    vocab = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "nicht", "über"]}
    word = lambda lang: rng.choice(vocab[lang]) + str(rng.randrange(50))
    item = " ".join(word("en") for _ in range(30))
    base = [" ".join(word(rng.choice(["en", "de"])) for _ in range(60)) for _ in range(60)]
    texts = base + [base[0], base[1] + " tail", "$$ 12 ..", None, item + " and more", base[5] + " token = " + "ab12" * 10]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mix":
            assert docs.columns == names
        kept[name] = sorted({r.doc_id for r in docs.collect()})
    every = set(range(len(texts)))
    assert set(kept["language_id"]) == every - {62, 63}
    assert set(kept["near_duplicates"]) == every - {60, 61, 62, 63, 65}
    assert set(kept["decontaminate"]) == set(kept["near_duplicates"]) - {64} == set(kept["secrets"])
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [*names, "copy"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    word = lambda k: ["the", "and", "with", "thing"][k % 4] + str(k % 50)
    text = lambda k: " ".join(word(k * 7 + i * i) for i in range(60))
    rows = [(i, text(i), "en", f"s{i % 2}", 9, f"key {i}", i) for i in range(30)]
    rows += [(3, text(3), "en", "s1", 9, "key 3", 3)] * 2 + [(None, text(77), "en", None, 9, None, None)] * 2 + [(None, text(4), "en", None, 9, None, None), (40, None, None, None, None, None, None), (41, "", "en", "s0", 0, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, SIZE long")
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, docs in (("odd", frame), ("empty", frame.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == [*frame.columns, "copy"]
    got = out.collect()
    # One row of each repeated one, the copy with an id before that without, none of the wordless; all else as it was.
    assert {(r.doc_id, r.text, r._key, r["SIZE"]) for r in got} <= {(*r[:2], *r[5:]) for r in rows[:30] + rows[32:33]} and len({(r.doc_id, r.text, r.copy) for r in got}) == len(got)
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == frame.columns
    assert sorted(((r.doc_id, r._key) for r in docs.collect()), key=str) == sorted([(i, f"key {i}") for i in range(30)] + [(None, None)], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def brute_mix(rows):
    """(row, copies) of rows (id, text, lang, source)."""
    import math

    size = lambda t: len(t.split())
    total: dict = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    target = brute_targets(total)
    draw = lambda i, seed: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    out = []
    for s, n in total.items():
        mine, rate = [r for r in rows if r[3] == s], target[s] / n
        extra = lambda r, seed: int(draw(r[0], seed) < rate - math.floor(rate))  # noqa: B023, E731
        best = min(range(16), key=lambda k: (abs(sum(size(r[1]) * extra(r, k) for r in mine) - (target[s] - math.floor(rate) * n)), k))  # noqa: B023
        out += [(r, math.floor(rate) + extra(r, best)) for r in mine]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_operators import brute_components, brute_hits

    from colloquy.llm import language, secrets

    rng = random.Random(12)
    vocab = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "nicht", "über"]}
    word = lambda lang: rng.choice(vocab[lang]) + str(rng.randrange(50))
    item = " ".join(word("en") for _ in range(30))
    texts = [" ".join(word(rng.choice(["en", "de"])) for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", "$$ 12 ..", None, item + " and more", texts[5][:60] + " x9 token = " + "ab12" * 10, item.upper() + texts[7] * 9]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = {r.doc_id for r in language.identify(docs, language.fit(docs)).collect() if r.lang_pred != "und" and r.score >= 0.3}
    left = [r for r in rows if r[0] in told]
    first = {i for i, _, c in brute_components([r[:2] for r in left], 5, 80) if i == c}
    left = [r for r in left if r[0] in first]
    left = [r for r, (n, hit, _) in ((r, brute_hits(r[1], [(1, item)])) for r in left) if not hit or 20 * hit < n]

    def hidden(text):
        found = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in r.compiled().finditer(text) if len(m[r.group]) >= r.least)
        out, at = "", 0
        for a, k, b in found:
            out += text[at:a] + f"[secret:{secrets.RULES[k].kind}]" if a >= at else ""
            at = max(at, b)
        return out + text[at:]

    left = [(i, hidden(t), lang, s) for i, t, lang, s, _ in left]
    want = sorted((i, t, lang, s, len(t), c) for (i, t, lang, s), n in brute_mix(left) for c in range(1, n + 1))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and any("[secret:" in r[1] for r in got) and any(r[5] == 2 for r in got)


def test_registered_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(queries.oracle_sql()) <= set(names)
