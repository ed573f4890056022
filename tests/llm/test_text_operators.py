"""Operators that are held against brute force: decontamination, secrets, Jaccard, language, toxicity."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, jaccard, language, queries, secrets, toxicity

LONG = "lorem ipsum dolor " * 30_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (5, LONG)]


def docs(spark, rows, extra="size long, spans string, score string"):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], f"doc_id long, text string, {extra}")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, size=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 20, 6000, 200])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(1)
    vocab = ["Alpha", "bêta", "c3", "δ", "e"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 13, 14, 30, 0])] + [(10, None), (2, "alpha, alpha; ALPHA")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 80)))) for i in range(20)]
    rows += [(50, f"x {items[4][1]} y"), (51, (items[3][1] + " ") * 2), *((i + 60, t) for i, t in ODD)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_benchmark(docs(spark, rows), bench, block_bytes=block_bytes)
    out = sorted((r.doc_id, r.n_words, r.n_hit, r.i) for r in got.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.concat_ws(",", "items").alias("i")).collect())
    assert out == sorted((i, *brute_hits(t, items)) for i, t in rows)


def test_window_index_tells_windows_of_one_hash_apart(monkeypatch):
    rng, rolled = random.Random(3), decontaminate._rolled
    monkeypatch.setattr(decontaminate, "_rolled", lambda windows, size: rolled(windows, size) % np.uint64(3))
    for slice_rows in (1, 2, 5, 1 << 16):
        monkeypatch.setattr(decontaminate, "SLICE", slice_rows)
        for _ in range(15):
            text = lambda most: " ".join(rng.choice("abcd") for _ in range(rng.randrange(most)))
            items = [(str(i % 4), text(25)) for i in range(rng.randrange(7))]
            index, own = decontaminate.WindowIndex([(i, t.encode()) for i, t in items], 3), text(40)
            n, spans, found = index.scan(own.encode())
            assert (n, sum(b - a for a, b in spans), ",".join(sorted(found))) == brute_hits(own, items, 3)


def test_one_benchmark_block_is_out_at_a_time(spark, monkeypatch):
    """An index holds no more than the bound for its words, and a broadcast is gone before the next one is made."""
    live, made, broadcast = set(), [], spark.sparkContext.broadcast

    def send(value):
        assert not live
        assert sum(x.nbytes for t in value.tables.values() for x in t) + value.words.nbytes <= decontaminate.HELD_A_WORD * len(value.words)
        shared = broadcast(value)
        destroy = shared.destroy
        live.add(id(shared))
        made.append(shared)
        monkeypatch.setattr(shared, "destroy", lambda: (live.discard(id(shared)), destroy()))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: send(value))
    items = [(i, f"item {i} " + " ".join(f"w{i * k}" for k in range(1, 30))) for i in range(40)]
    rows = [(i, f"before {t} after " * (1 + i % 2)) for i, t in items] + [(100, "clean words"), (101, None)]
    got = decontaminate.find_benchmark(docs(spark, rows), spark.createDataFrame([*items, *items], "item_id long, text string"), block_bytes=60_000)
    assert len(made) > 3 and len(live) == 1
    monkeypatch.undo()
    assert sorted((r.doc_id, r.n, r.hit, ",".join(r["items"])) for r in got.select("doc_id", F.col("n_words").alias("n"), decontaminate.n_hit().alias("hit"), "items").collect()) == sorted((i, *brute_hits(t, items)) for i, t in rows)


def test_decontamination_keeps_clean_documents_whole(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item), (2, "clean " * 50), (3, item + " z" * 500), (4, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    frame = docs(spark, rows)
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect())) == [(*r, 9, "x", "y") for r in rows[1:]]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(frame, bench).collect()}
    assert cut[1] == "" and cut[2] == rows[1][1] and "w5" not in cut[3] and cut[3].endswith("z z") and cut[4] is None
    assert decontaminate.find_benchmark(frame, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.find_benchmark(frame.limit(0), bench).count() == 0


def brute_secrets(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        out += [(m.start(), k, m.end()) for m in r.compiled().finditer(text or "") if len(m[r.group]) >= r.least]
    return ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", "=", ":", " ", '"', "abcd1234", "short", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "ſecret", "gh" + "p_" + "a" * 36, "xox" + "b-" + "1" * 12, "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(i + 900, t) for i, t in ODD]
    got = secrets.find_secrets(docs(spark, rows)).select("doc_id", "text", secrets.spans_text().alias("s")).collect()
    assert sorted((r.doc_id, r.s) for r in got) == sorted((i, brute_secrets(t)) for i, t in rows)
    assert sum(bool(r.s) for r in got) > 50
    assert secrets.find_secrets(docs(spark, rows).limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == frozenset({"aki", "kia"})
    assert secrets.trigram_query(r"[0-9a-f]+") is True and secrets.trigram_query("ab") is True
    assert secrets.trigram_query("(abc|def)x?") == ("or", (frozenset({"abc"}), frozenset({"abc", "bcx"}), frozenset({"def"}), frozenset({"def", "efx"})))
    assert secrets.trigram_query("(abc|.)") is True and secrets.trigram_query("(abcd)*") is True


def test_redaction_masks_and_keeps(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    got = {r.doc_id: r.text for r in secrets.redact(docs(spark, [(1, f"a {key} b token={key}"), (2, "clean"), (3, None)])).collect()}
    assert got == {1: "a [secret:access] b [secret:assign]", 2: "clean", 3: None}


def brute_components(rows, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets.items())


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, size, percent):
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 8, 20, 60, 150, 400]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows) * 3, " ".join(own)))
    rows += [(10_000 + i, t) for i, t in [(1, None), (2, ""), (3, " \t"), (5, LONG), (6, LONG + "x"), (7, "w1  W2 w3"), (8, "W1 w2 W3")]]
    got = jaccard.jaccard_components(docs(spark, rows), size=size, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, size, percent)


def test_jaccard_links_are_all_pairs(spark):
    w = [f"w{i}" for i in range(100)]
    cut = lambda a, b: " ".join(w[a:b])
    rows = [(1, cut(0, 100)), (2, cut(1, 100)), (3, cut(0, 99)), (4, cut(2, 98)), (5, cut(1, 100).upper()), (6, cut(6, 100)), (7, cut(12, 100)), (8, "alone"), (9, None)]
    grams = {i: {tuple(t.lower().split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} for i, t in rows if t}
    want = sorted((1, a, b) for a in grams for b in grams if a < b and 5 not in (a, b) and 100 * len(grams[a] & grams[b]) >= 90 * len(grams[a] | grams[b]))
    got = sorted(map(tuple, jaccard.jaccard_links(docs(spark, rows)).collect()))
    assert got == want and (1, 2, 3) in got and (1, 1, 7) not in got and (1, 6, 7) in got


def test_jaccard_of_nothing_and_repeated_rows(spark):
    assert jaccard.jaccard_components(docs(spark, []).limit(0)).count() == 0
    assert sorted(map(tuple, jaccard.jaccard_components(docs(spark, [(4, "a b"), (4, "a b"), (2, "A  b")])).collect())) == [(2, 1, 2), (4, 1, 2), (4, 1, 2)]


@pytest.mark.parametrize("most,ansi", [(0, "true"), (0, "false"), (1, "true"), (1, "false")])
def test_jaccard_of_sets_without_folded_counts(spark, monkeypatch, most, ansi):
    rng = random.Random(11)
    rows = []
    for n in (20, 60, 150, 400):
        base = [f"u{n}x{i}" for i in range(n)]
        for _ in range(8):  # without a common star key some meet in the matrix only
            own = list(base)
            for _ in range(n * 4 // 100):
                own[rng.randrange(n)] = f"v{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    monkeypatch.setattr(jaccard, "MOST_FOLDED", most)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = jaccard.jaccard_components(docs(spark, rows), size=5, percent=60)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    want = brute_components(rows, 5, 60)
    assert sorted(map(tuple, got.collect())) == want and len({c for *_, c in want}) < len(rows)


def test_word_hashes_over_block_edges():
    text = ("alpha  Beta\tgamma " * 20_000 + "x" * 300_000 + " tail").encode()
    got = jaccard.word_hashes(text)
    assert len(got) == 60_002 and len(set(got.tolist())) == 5
    assert got[-1] == jaccard.word_hashes(b"tail")[0] and got[1] == jaccard.word_hashes(b"bETA")[0]


def test_keep_one_of_each_group(spark):
    same = " ".join(f"w{i}" for i in range(100))
    got = jaccard.keep_one(docs(spark, [(3, same), (5, same + " more"), (8, "other text"), (9, None), (10, "")]))
    assert sorted(r.doc_id for r in got.collect()) == [3, 8, 9, 10]


def test_keep_one_tells_rows_apart(spark):
    text = lambda c, more="": " ".join(f"{c}{i}" for i in range(60)) + more
    rows = [(1, text("a")), (5, text("a", " x")), (5, text("b")), (None, text("c")), (None, text("a")), (None, text("d")), (7, text("d")), (8, text("e")), (8, text("e")), (None, text("f")), (None, text("f"))]
    empty = [(None, None), (9, ""), (9, ""), (5, None)]
    got = jaccard.keep_one(docs(spark, rows + empty).repartition(3))
    want = [(1, text("a")), (5, text("b")), (None, text("c")), (7, text("d")), (8, text("e")), (None, text("f")), *empty]
    assert got.columns == docs(spark, rows).columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    # Two similar texts of one id: one of them stays.
    assert [(r.doc_id, r.text) for r in jaccard.keep_one(docs(spark, [(4, text("g")), (4, text("g", " y"))])).collect()] in ([(4, text("g"))], [(4, text("g", " y"))])


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_keep_one_leaves_texts_where_they_are(spark, monkeypatch, most):
    """The list of keys is broadcast, whatever Spark's own threshold; beyond the bound the join is a shuffled one, with the same rows."""
    monkeypatch.setattr(jaccard, "MOST_BROADCAST_ROWS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(30)]
        got = jaccard.keep_one(docs(spark, rows + [(100 + i, rows[i % 3][1]) for i in range(5)]))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in got.collect()) == list(range(30))
        assert ("Exchange hashpartitioning" in plan) == (most == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_join_the_edges_once_a_round(spark, monkeypatch):
    plans, store = [], jaccard.Scratch.stored

    def stored(self, df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return store(self, df, name)

    monkeypatch.setattr(jaccard.Scratch, "stored", stored)
    chain = [(i, i + 1) for i in range(0, 40) if i != 20] + [(7, 7), (3, 2)]
    got = jaccard.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {i: 0 if i <= 20 else 21 for i in range(41)}
    rounds = plans[2:]  # the edges and the first labels come before
    assert [p.count("Relation [a#") for name, p in rounds] == [1, 0] * (len(rounds) // 2) and len(rounds) > 2


def test_connected_adds_edges_to_known_components(spark):
    rng = random.Random(5)
    first = [(i, i + 1) for i in range(60) if i not in (20, 40)] + [(7, 7), (3, 2)]
    then = [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)] + [(20, 21), (5, 5), (90, 40)]
    root = {i: i for edge in first + then for i in edge if edge[0] != edge[1]}
    for _ in root:
        for a, b in first + then:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = jaccard.connected(edges(first))
    for got in (jaccard.connected(edges(then), known), jaccard.connected(edges(first + then))):
        assert sorted(map(tuple, got.collect())) == sorted(root.items())
    assert sorted(map(tuple, jaccard.connected(edges([(4, 4)]), known).collect())) == sorted(map(tuple, known.collect()))
    assert jaccard.connected(edges([(4, 4)])).count() == 0


def test_near_copies_are_joined_about_once_each(spark, monkeypatch):
    rng, rows, joined = random.Random(3), [], {"verified": 0, "components": 0}
    for i in range(240):
        words = [f"w{j}" for j in range(150)]
        for j in rng.sample(range(150), rng.randint(1, 3)):
            words[j] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))

    def counted(name):
        real = getattr(jaccard, name)

        def run(pairs, *rest):
            joined[name] += pairs.count()
            return real(pairs, *rest)

        monkeypatch.setattr(jaccard, name, run)

    counted("verified"), counted("components")
    got = jaccard.jaccard_components(docs(spark, rows), size=5, percent=80, group_size=4)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 5, 80)
    assert joined["verified"] < 8 * len(rows) and joined["components"] < len(rows), joined


def test_keep_one_leaves_clashing_columns_alone(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, same, "mine", "A"), (2, same, "yours", "B"), (3, "x", None, None), (3, "x", None, None)], "doc_id long, text string, _key string, `Key` string")
    got = jaccard.keep_one(rows)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(1, same, "mine", "A"), (3, "x", None, None)], key=str)


STEMS = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "schön", "nicht", "über"], "cc": ["que", "las", "niño", "más", "pero"]}


def _texts(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang]) for _ in range(n))


def test_language_on_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, _texts(rng, lang, rng.randrange(3, 200)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = language.fit(frame.where("doc_id % 4 <> 2"))
    again = language.fit(frame.where("doc_id % 4 <> 2"))
    assert (net.filters == again.filters).all()
    held = language.identify(frame.where("doc_id % 4 = 2"), net).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in held)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 $$"), (4, LONG), (5, "Ω")], "doc_id long, text string"), net).collect()}
    assert [odd[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and odd[4][0] != "und" and odd[5][0] != "und"
    empty = language.fit(frame.limit(0))
    assert {r.lang_pred for r in language.identify(frame, empty).collect()} == {"und"}
    assert {r.doc_id for r in language.keep_identified(frame, net).collect()} == {r[0] for r in rows}


def test_folds(spark):
    import zlib

    got = spark.range(50).select("id", language.fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        bad = i % 6 == 0
        text = _texts(rng, rng.choice(list(STEMS)), rng.randrange(20, 120))
        if bad:
            text += " " + rng.choice(["idiot", "trash", "zornwuk" + rng.choice("abcdef") * 3]) + " " + _texts(rng, "aa", 5)
        rows.append((i, text, int(bad)))
    frame = spark.createDataFrame(rows, "id long, text string, toxic int")
    model = toxicity.fit(frame.where("id % 5 <> 0"))
    held = toxicity.score(frame.where("id % 5 = 0").withColumn("score", F.lit("clash")), model).collect()
    bad, good = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.95
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, LONG)], "id long, text string"), model).collect()
    assert len(odd) == 3 and all(0 <= r.score < 0.5 for r in odd)
    for few in (frame.limit(0), frame.where("toxic = 0"), frame.where("toxic = 1")):
        assert toxicity.score(frame.limit(3), toxicity.fit(few)).count() == 3
    # Labels other than 0 and 1 are left out, and the sample is bounded by rows even where ids repeat.
    other = toxicity.fit(frame.where("id % 5 <> 0").unionAll(frame.select("id", "text", (F.col("toxic") + 2).alias("toxic"))).unionAll(frame.select("id", "text", F.lit(-1).alias("toxic"))))
    assert (other.weights == model.weights).all() and other.bias == model.bias
    assert toxicity._sample(frame, 50).count() == 50
    many = frame.limit(3).unionAll(spark.createDataFrame([(1000, f"again {i}", 0) for i in range(200)], "id long, text string, toxic int"))
    assert sorted(r.id == 1000 for r in toxicity._sample(many, 100).collect()) == [False] * 3


def test_label_model_ranks_voters():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    votes = np.stack([np.where(rng.random(2000) < acc, np.where(y, 1, 2), np.where(y, 2, 1)) for acc in (0.9, 0.85, 0.8, 0.55)], 1).astype(np.int8)
    votes = np.concatenate([votes, votes[:, 3:], votes[:, 3:]], 1)  # the weak voter three times: correlated
    posterior, _, weights = toxicity.label_model(votes, 0.3)
    assert ((posterior > 0.5) == y).mean() > 0.88 and weights[3:].max() < weights[:3].min()


def test_digest_columns(spark, tmp_path):
    for name, schema, rows in (("documents", "doc_id long, text string, lang string, source string, n_chars long", [(1, "a b", "en", "s", 3), (2, None, None, None, None)]), ("benchmark", "item_id long, text string", [(1, "a b")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.doc_id: r for r in queries.op7_decontaminate(spark, str(tmp_path)).collect()}
    assert got[1].contaminated and got[1].items_sha256 == hashlib.sha256(b"1").hexdigest() and got[2].n_words == 0 and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: r.base_sha256 for r in queries.op10_secrets(spark, str(tmp_path)).collect()}[2] == hashlib.sha256(b"").hexdigest()
