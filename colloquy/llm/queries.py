"""The queries op1 to op13 over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, mixing, periodic, pii, secrets, spelling, tool_chat, topk, toxicity, url_filter, warc
from .shared import load


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(load(spark, sf_dir, "pages"))
    return read.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").cast("long").alias("refers_to"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.fold_of(F.col("doc_id"), 4) == 2)
    net = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents"), size=3, percent=90)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_chat.from_conversations(load(spark, sf_dir, "conversations"))
    linked = tool_chat.link_tool_calls(calls, results, tool_chat.schemas_frame(spark))
    return linked.withColumn("errors", F.array_join("errors", ","))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language.fold_of(F.col("doc_id"), 5) == 0)
    labels = load(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.where(~F.col("held_out")).join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic")
    scored = toxicity.score(docs, toxicity.fit(train))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(secrets.spans_text(tuple(base)), 256).alias("base_sha256"), secrets.spans_text().alias("spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(load(spark, sf_dir, "documents"), slips=True)
    return spelling.spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(load(spark, sf_dir, "documents").select("doc_id", "text"), pii.fit(pii.labelled_table(spark)))
    return found.select("doc_id", *map(pii.n_base, pii.BASE_KINDS), F.sha2(pii.spans_text(base_only=True), 256).alias("base_sha256"), pii.spans_text().alias("spans"))


def looped(doc_id, text):
    """The text of one document in ten with its last words repeated with a period; others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    held = F.get(F.transform(F.array(words), again), F.lit(0))  # the words of a text are found once, not once per word
    return F.when(text.isNotNull() & (h % 10 == 0), held).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find_runs(docs).withColumn("best", periodic.longest_run())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic.runs_text(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    own = (op1_warc, op2_language, op3_jaccard, op4_url_filter, op5_topk, op6_tool_chat, op7_decontaminate, op8_mix, op9_toxicity, op10_secrets, op11_spelling, op12_pii, op13_periodic)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1, "op3_jaccard": OP3, "op4_url_filter": OP4, "op5_topk": OP5, "op6_tool_chat": OP6, "op7_decontaminate": OP7, "op8_mix": OP8,
        "op11_spelling": OP11, "op13_periodic": OP13,
    }


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS last_id,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM d
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(ws), 0) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
rare AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM u)),
pre AS (SELECT doc_id, n, g FROM rare WHERE 100 * (r - 1) <= 10 * n),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n),
links AS (
  SELECT c.a, c.b FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 190 * len(list_intersect(x.sh, y.sh)) >= 90 * (len(x.sh) + len(y.sh))),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(root, node) AS (SELECT a, a FROM e UNION SELECT r.root, e.b FROM reach r JOIN e ON e.a = r.node),
comp AS (SELECT root, min(node) AS c FROM reach GROUP BY root)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id FROM s LEFT JOIN comp ON root = s.doc_id
"""

OP4 = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
f AS (
  SELECT k.*, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS r
  FROM k LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE r = 1
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text FROM conversations WHERE role IN ('user', 'system')),
l(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0::BIGINT FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
SELECT c.conv_id, c.call_id, level, c.turn, c.name, a.turn AS result_turn, CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, '' AS errors,
  '{"arguments":{"chars":' || length(c.text) || ',"first":' || to_json(split_part(c.text, ' ', 1)) || ',"text":' || to_json(c.text) || ',"turn":' || c.turn || ',"words":'
  || len(list_filter(string_split(c.text, ' '), lambda w: w <> '')) || '},"id":' || to_json(c.call_id) || ',"name":' || to_json(c.name)
  || ',"result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS json
FROM c JOIN l USING (conv_id, turn) LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, lens WHERE len(ws) >= n),
hits AS (SELECT doc_id, item_id, a.n, i FROM (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM spots) a JOIN win ON win.n = a.n AND win.g = a.g),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: The last part of a mix over the rows d (id, source, size); corpus_pipeline.py uses it as well.
MIX = r"""
src AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
fill AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2.0::DOUBLE) / sum(weight) OVER after AS level
  FROM src WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
top AS (SELECT level AS best FROM fill WHERE level <= source_size * 2.0::DOUBLE / weight ORDER BY source_size * 2.0::DOUBLE / weight LIMIT 1),
target AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce((SELECT best FROM top), 'inf'::DOUBLE) * weight) AS target,
    CASE WHEN source_size > 0 THEN least(source_size * 2.0::DOUBLE, coalesce((SELECT best FROM top), 'inf'::DOUBLE) * weight) / source_size ELSE 0 END AS rate FROM fill),
drawn AS (
  SELECT d.id, d.size, t.*, seed, (('0x' || substr(md5(seed || ':' || coalesce(d.id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::BIGINT AS extra
  FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range(16)) AS seed)),
chosen AS (
  SELECT source, seed AS own_seed FROM (
    SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * extra) - (any_value(target) - floor(any_value(rate)) * any_value(source_size))), seed) AS r
    FROM drawn GROUP BY source, seed) WHERE r = 1),
mixed AS (
  SELECT id, size, source_size, target, CASE WHEN size > 0 THEN floor(rate)::BIGINT + extra ELSE 0 END AS copies
  FROM drawn JOIN chosen ON drawn.source IS NOT DISTINCT FROM chosen.source AND seed = own_seed)
"""

OP8 = (
    r"""WITH d AS (SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),"""
    + MIX
    + "SELECT id AS doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"
)


def _crc32(text: str) -> str:
    """SQL for the crc32 of an expression's UTF-8 bytes, for code points below 2048: each byte, then eight shifts."""
    points = f"list_transform(string_split({text}, ''), lambda c: ord(c))"
    data = f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    steps = f"flatten(list_transform({data}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform({steps}, lambda e: e::BIGINT)), lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)"
    return f"xor({fold}, 4294967295::BIGINT)"


OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, r, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
h AS (SELECT r, k, {_crc32("doc_id || ':' || r")} AS h FROM runs),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, arg_max(other, r) AS other, max(m) AS m FROM (SELECT *, -row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near) GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, held, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN f ON f.word = c.held AND f.form IS NOT NULL),
last AS (SELECT word, arg_max(held, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""

OP13 = rf"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM t),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM g),
six AS (SELECT doc_id, i, hash(array_to_string(ws[i : i + 5], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 12)),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i AS i FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
island AS (SELECT doc_id, q, min(i) - 1 AS start, count(*) + 5 AS equal FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS j FROM same) GROUP BY doc_id, q, j),
run AS (SELECT doc_id, start, equal + q AS length, min(q) AS period FROM island WHERE equal >= q AND equal + q >= 12 GROUP BY doc_id, start, equal + q),
per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
    list({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period)[1] AS best, list({{'a': start + period, 'b': start + length}}) AS gone FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(g.a, g.b)) AS i FROM (SELECT doc_id, unnest(gone) AS g FROM per)),
gone_of AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, array_to_string(CASE WHEN gone IS NULL THEN ws ELSE (SELECT list(w ORDER BY i) FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i) WHERE NOT list_contains(gone, i)) END, ' ') AS text
  FROM d LEFT JOIN gone_of USING (doc_id))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
