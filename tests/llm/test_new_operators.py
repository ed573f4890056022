"""Spelling variants, personal data and periodic runs, held against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import periodic, pii, queries, spelling

LONG = "lorem ipsum dolor " * 30_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (None, "null null"), (5, LONG)]


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators add or use."""
    return spark.createDataFrame([(*r, 9, "x", "y", "z") for r in rows], "doc_id long, text string, runs long, Collapsed string, pii_spans string, word string")


# ---- spelling


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_forms(words):
    form, out = {}, []
    for w, n in words.items():
        held = sorted((-m, v) for v, m in words.items() if v != w and near(v, w))
        form[w] = held[0][1] if held and -held[0][0] >= 2 * n else None
        out.append((w, n, len(held), form[w], words[form[w]] if form[w] else None))

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((*r, root(r[0])) for r in out)


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefghij"])
def test_spelling_forms_equal_brute_force(spark, letters, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS", 50)  # several acceptors per task
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))): rng.choice([3, 3, 4, 8, 16, 40]) for _ in range(150)}
    table = spark.createDataFrame([(w, n, "k") for w, n in words.items()], "word string, n long, key string")
    got = spelling.spelling_forms(table).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute_forms(words)


def test_spelling_of_nothing_and_odd_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_forms(empty).count() == 0
    odd = spark.createDataFrame([("", 5), ("a", 3), ("b", 9), ("w" * 3000, 1), ("w" * 3001, 2)], "word string, n long")
    assert {r.word: r.form for r in spelling.spelling_forms(odd).collect()} == {"": None, "a": "b", "b": None, "w" * 3000: "w" * 3001, "w" * 3001: None}


def test_acceptor_is_minimal():
    words = ["ab", "abc", "b", "xb", "xbc"]
    rows = np.array([[1, *(ord(c) for c in w), *[0] * (4 - len(w))] for w in words])
    machine = spelling.Acceptor(rows)
    assert len(machine.final) == 5  # start, behind the first symbol, behind a or x, before c, the end
    assert machine.words[machine.start] == 5 and machine.final.sum() == 2


def test_vocabulary_counts_every_row(spark):
    rows = [(7, "Words words WORDS été-étés naïve"), (7, "Words words WORDS été-étés naïve"), *ODD[:-1]]
    got = {r.word: r.n for r in spelling.vocabulary(docs(spark, rows), least_length=4, least_count=2).collect()}
    assert got == {"words": 6, "étés": 2, "naïve": 2, "word": 2, "null": 2}
    want = Counter()
    for i, text in [(i, f"alpha{i} beta gamma delta" * 2) for i in range(300)]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    slips = spelling.vocabulary(docs(spark, [(i, f"alpha{i} beta gamma delta" * 2) for i in range(300)]), least_length=1, least_count=1, slips=True)
    assert {r.word: r.n for r in slips.collect()} == dict(want) and "delt" in want or len(want) > 5


def test_canonical_words_of_documents(spark):
    forms = spelling.spelling_forms(spark.createDataFrame([("haus", 9), ("hauz", 3)], "word string, n long"))
    got = spelling.canonical(docs(spark, [(1, "Haus HAUZ x"), (2, None)]), forms)
    assert sorted((r.doc_id, r.word, r._word, r._root) for r in got.collect()) == [(1, "z", "haus", "haus"), (1, "z", "hauz", "haus"), (1, "z", "x", "x")]


# ---- personal data


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or pii.luhn(digits.encode())):
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@pytest.fixture(scope="module")
def trained(spark):
    return pii.fit(pii.labelled_table(spark, 4))


def test_base_spans_equal_brute_force(spark, trained):
    rng = random.Random(3)
    bits = ["a", "B.", "@", "@x.y", "é", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 (269) 555-3296", "x_%", "\n", "ü@", "1.2.3.4", "000001.2.3.4"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))) for i in range(2000)] + ODD
    found = pii.find_pii(docs(spark, rows), trained)
    assert found.columns == ["doc_id", "text", "runs", "Collapsed", "word", "pii_spans"]
    got = sorted((r.doc_id or 0, r.text or "", r.s) for r in found.select("doc_id", "text", pii.spans_text(base_only=True).alias("s")).collect())
    assert got == sorted((i or 0, t or "", brute_spans(t or "")) for i, t in rows)
    assert sum(bool(s) for *_, s in got) > 100
    assert pii.find_pii(docs(spark, rows).limit(0), trained).count() == 0


def test_field_finds_what_patterns_miss(trained):
    texts = [b"please call Mr. Keller at (269) 555-3296 now", b"Is The And. Of Er. That was all.", "IBAN DE89 3704 0044 0532 0130 00 é".encode()]
    found = [[(k, t.decode()[a:b]) for a, b, k, added in own if added] for t, own in zip(texts, pii.spans_of(texts, trained), strict=True)]
    assert ("phone", "(269) 555-3296") in found[0] and ("person", "Keller") in found[0] and not found[1] and ("iban", "DE89 3704 0044 0532 0130 00") in found[2]


def test_field_on_held_out_rows(trained):
    right = wrong = 0
    for text, spans in pii.labelled_rows(2, seed=77):
        got = {(a, b) for a, b, _, _ in pii.spans_of([text.encode()], trained)[0]}
        want = {(a, b) for a, b, _ in spans}
        right += len(got & want)
        wrong += len(got ^ want)
    assert right > 100 and wrong < 0.15 * right


def test_viterbi_and_likelihood():
    rng = np.random.default_rng(0)
    scores, moves, lengths = rng.normal(size=(5, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 3, 1, 2, 4])
    flat = np.concatenate([scores[i, :n] for i, n in enumerate(lengths)])
    got = np.split(pii.viterbi(flat, moves, lengths), np.cumsum(lengths)[:-1])

    def value(i, y):
        return sum(scores[i, t, k] for t, k in enumerate(y)) + moves[0, y[0]] + sum(moves[a, b] for a, b in itertools.pairwise(y)) + moves[y[-1], 0]

    for i, n in enumerate(lengths):
        assert tuple(got[i]) == max(itertools.product(range(3), repeat=int(n)), key=lambda y: value(i, y))
    labels = rng.integers(0, 3, (5, 4))
    total, by_score, by_move = pii.likelihood(scores, moves, labels, lengths)
    want = sum(value(i, labels[i, :n]) - np.log(sum(np.exp(value(i, y)) for y in itertools.product(range(3), repeat=int(n)))) for i, n in enumerate(lengths))
    assert abs(total - want) < 1e-9
    for at in itertools.product(range(5), range(4), range(3)):  # gradients against finite differences
        moved = scores.copy()
        moved[at] += 1e-6
        assert abs((pii.likelihood(moved, moves, labels, lengths)[0] - total) / 1e-6 - by_score[at]) < 1e-4
    for at in itertools.product(range(3), range(3)):
        moved = moves.copy()
        moved[at] += 1e-6
        assert abs((pii.likelihood(scores, moved, labels, lengths)[0] - total) / 1e-6 - by_move[at]) < 1e-4


def test_pruned_words_change_no_label(trained):
    rng = random.Random(9)
    for text, _ in pii.labelled_rows(2, seed=5):
        data = np.frombuffer((text + rng.choice([" ", ". "]) + text).encode(), np.uint8)
        words = pii.words_of(data)
        one = np.zeros(len(words.start), np.int64)
        numbers = trained.numbers(words)
        assert (pii.decode(trained, numbers, one) == pii.viterbi(pii.scores_of(trained, numbers, one), trained.moves, np.array([len(one)]))).all()


def test_redaction_and_empty_training(spark, trained):
    rows = [(1, "mail a@b.org, é +1 (269) 555-3296 x"), (2, "clean"), (3, None), (2, "clean")]
    got = pii.redact_pii(docs(spark, rows), trained)
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, "mail [email], é [phone] x"), (2, "clean"), (2, "clean"), (3, "")]
    nothing = pii.fit(pii.labelled_table(spark, 1).limit(0))
    assert pii.spans_of([b"call (269) 555-3296 or a@b.org"], nothing) == [[(23, 30, "email", 0)]]


# ---- periodic runs


def brute_runs(w, least=12):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        t = 0
        while t + q < len(w):
            a = t
            while t + q < len(w) and w[t] == w[t + q]:
                t += 1
            if t - a >= q and t - a + q >= least:
                seen.setdefault((a, t - a + q), q)
            t += 1
    return sorted((a, n, q) for (a, n), q in seen.items())


def periodic_words(rng):
    letters, n = rng.choice([1, 2, 2, 3, 8]), rng.randrange(0, 150)
    w = [rng.choice("abcdefgh"[:letters]) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 2 + 1))
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = "z"
    return w


def test_runs_equal_brute_force_in_any_appends():
    rng = random.Random(4)
    for _ in range(150):
        sequences = [[c.encode() for c in periodic_words(rng)] for _ in range(rng.randrange(1, 6))]
        want = [brute_runs(s) for s in sequences]
        assert [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(sequences)] == want
        catchers, codes, i = periodic.Catchers(), np.array([w[0] for w in sequences[0]], np.int64), 0
        while i < len(codes):
            j = i + rng.randrange(1, 20)
            catchers.append(codes[i:j])
            i = j
        assert [tuple(r) for r in catchers.runs().tolist()] == want[0]


def test_runs_of_one_word_and_of_nested_powers():
    assert periodic.runs_of([[b"a"] * 300_000])[0].tolist() == [[0, 300_000, 1]]
    nested = (([b"a"] * 20 + [b"b"]) * 15 + [b"c"]) * 12
    got = [tuple(r) for r in periodic.runs_of([nested])[0].tolist()]
    assert got == brute_runs(nested) and (0, len(nested), 316) in got


def test_hash_sums_of_one_value_leave_runs_exact(monkeypatch):
    monkeypatch.setattr(periodic, "_mix", lambda a, b: np.zeros(len(a), np.uint64))  # every block is a false alarm
    rng = random.Random(6)
    for _ in range(20):
        w = [c.encode() for c in periodic_words(rng)][:60]
        got = {tuple(r) for r in periodic.runs_of([w])[0].tolist()}
        assert got <= set(brute_runs(w)) or all(w[a : a + n - q] == w[a + q : a + n] for a, n, q in got)


def test_runs_of_documents(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(periodic_words(rng))) for i in range(60)] + ODD
    got = periodic.find_runs(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "pii_spans", "word", "runs", "collapsed"]
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = [tuple(x) for x in r.runs]
        if len(w) < 1000:
            assert runs == brute_runs(w)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert got.where("length(text) > 100000").first().collapsed == "lorem ipsum dolor"
    assert periodic.find_runs(docs(spark, rows).limit(0)).count() == 0
    best = got.where("size(runs) > 0").withColumn("best", periodic.longest_run()).collect()
    assert best and all(tuple(r.best) == min((tuple(x) for x in r.runs), key=lambda x: (-x[1], x[0], x[2])) for r in best)


def test_new_queries_equal_their_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["thesis", "thesiss", "tesis", "other", "éther", "ethers", "Others", "x"]) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(900, None), (901, ""), (902, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op11_spelling", "op13_periodic"):
        got = queries.queries()[name](spark, str(tmp_path))
        cur = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(got.columns) == sorted(names)
        assert Counter(map(tuple, got.select(names).collect())) == Counter(cur.fetchall())


def test_personal_data_query(spark, tmp_path):
    rows = [(1, "a@b.org é 10.0.0.1"), (2, None), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in queries.op12_pii(spark, str(tmp_path)).withColumn("want", F.sha2(F.lit("email:0:7,ip:10:18"), 256)).collect()}
    assert got[1]["n_email"] == got[1]["n_ip"] == 1 and got[1]["base_sha256"] == got[1]["want"] and got[1]["spans"] == "email:0:7,ip:10:18"
    assert [got[i]["spans"] for i in (2, 3)] == ["", ""] and sum(got[i][f"n_{k}"] for i in (2, 3) for k in pii.BASE_KINDS) == 0
