"""DuckDB SQL with the rows of the registered queries. RE2 has no lookaround, so what needs it has no SQL."""

from __future__ import annotations

from ..functions.text import STOPWORDS, middle_cut
from ..operators.redact import SECRET_WORDS
from ..operators.topics import ERRORS, TRANSITION

#: White space that trimming takes off, as RE2 spells it.
_WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _strip_end(x: str) -> str:
    return rf"regexp_replace({x}, '{_WS}+$', '')"


def _quote(x: str) -> str:
    return x.replace("'", "''")


_TURNS = f"""
t AS (
  SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_idx, role, {_strip('text')} AS text
  FROM conversations WHERE {_strip('text')} <> ''),
"""
_EXCHANGES = (
    _TURNS
    + f"""
x AS (SELECT * FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY msg_idx) - 1 AS exchange FROM t) WHERE exchange >= 0),
e AS (
  SELECT session_id, exchange::BIGINT AS exchange, min(msg_idx) AS "start", max(msg_idx) AS "end", arg_min(text, msg_idx) AS user_text, sum(length(text))::BIGINT AS chars,
    sum((length(text) > 80)::INT)::BIGINT AS substantive, sum(len(regexp_extract_all(text, '```')) / 2.0::DOUBLE) AS code_blocks, sum(len(regexp_extract_all(text, '{_quote(ERRORS)}')))::BIGINT AS errors
  FROM x GROUP BY session_id, exchange),
k AS (
  SELECT *, list_distinct(list_filter(list_transform(string_split_regex(lower(user_text), '[^a-z0-9_.\\-]+'), lambda w: regexp_replace(w, '^[._\\-]+|[._\\-]+$', '', 'g')),
    lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(f"'{w}'" for w in STOPWORDS)}], w))) AS tokens FROM e),
j AS (
  SELECT *, CASE WHEN len(list_distinct(list_concat(before, tokens))) = 0 THEN 1.0 ELSE len(list_intersect(before, tokens))::DOUBLE / len(list_distinct(list_concat(before, tokens))) END AS jac
  FROM (SELECT *, lag(tokens) OVER (PARTITION BY session_id ORDER BY exchange) AS before FROM k)),
b AS (
  SELECT *, CASE WHEN before IS NOT NULL THEN (1 - jac) * 2 + CASE WHEN regexp_matches(substr(user_text, 1, 120), '{_quote(TRANSITION)}') THEN 1.0 ELSE 0.0 END
    - CASE WHEN length(user_text) < 24 THEN 2.0 ELSE 0.0 END END AS score FROM j),
g AS (SELECT *, sum(coalesce((score >= 1.97)::INT, 0)) OVER (PARTITION BY session_id ORDER BY exchange) AS segment FROM b),
"""
)
_LABEL = f"trim(regexp_replace(regexp_replace(opening, '(?s)```.*?```', ' ', 'g'), '{_WS}+', ' ', 'g'))"
_TOPICS_ALL = (
    _EXCHANGES
    + f"""
s AS (
  SELECT session_id, segment, min("start") AS msg_from, max("end") AS msg_to, count(*) AS exchanges, sum(chars)::BIGINT AS chars, arg_min(user_text, exchange) AS opening,
    sum(substantive) AS substantive, sum(code_blocks) AS code_blocks, sum(errors) AS errors FROM g GROUP BY session_id, segment),
si AS (
  SELECT *, log2(1 + exchanges::DOUBLE) * 1.2 + least(6, substantive) * 0.5 + least(5.0, code_blocks) * 1.1 + least(8, errors) * 0.45 + log2(1 + chars::DOUBLE / 1000.0) * 0.8 AS interest, {_LABEL} AS clean FROM s),
sr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY interest DESC, msg_from) AS rank FROM si),
"""
)
#: Topics of sessions with over-long segments, by choices made one after another; {max}, {min}: characters of a topic at most and at least.
_SPLIT = """
lg AS (SELECT DISTINCT session_id FROM (SELECT session_id, segment, sum(chars) AS c FROM g GROUP BY ALL) WHERE c > {max}),
p AS (
  SELECT g.*, sum(chars) OVER seg - chars AS pos, sum(chars) OVER (PARTITION BY session_id, segment) AS total, row_number() OVER seg AS place
  FROM g JOIN lg USING (session_id) WINDOW seg AS (PARTITION BY session_id, segment ORDER BY exchange)),
cutat AS (
  SELECT a.session_id, a.exchange FROM p a WHERE place > 1
    AND coalesce((SELECT min(r.pos) FROM p r WHERE r.session_id = a.session_id AND r.segment = a.segment AND r.place > 1 AND r.exchange > a.exchange AND r.score > a.score), a.total)
      - coalesce((SELECT max(l.pos) FROM p l WHERE l.session_id = a.session_id AND l.segment = a.segment AND l.place > 1 AND l.exchange < a.exchange AND l.score >= a.score), 0) > {max}),
pt AS (SELECT p.*, sum((place = 1 OR c.exchange IS NOT NULL)::INT) OVER (PARTITION BY p.session_id ORDER BY p.exchange) AS part FROM p LEFT JOIN cutat c ON c.session_id = p.session_id AND c.exchange = p.exchange),
w AS (
  SELECT session_id, part, min("start") AS msg_from, max("end") AS msg_to, count(*) AS n, sum(chars)::BIGINT AS chars, arg_min(user_text, exchange) AS opening, sum(substantive) AS substantive, sum(code_blocks) AS code_blocks,
    sum(errors) AS errors FROM pt GROUP BY session_id, part),
m AS (
  SELECT w.session_id, part, t.msg_idx, t.role, t.text, length(t.text) AS size, w.chars AS whole, w.errors AS all_errors, row_number() OVER (PARTITION BY w.session_id, part ORDER BY t.msg_idx) AS rn
  FROM w JOIN t ON t.session_id = w.session_id AND t.msg_idx BETWEEN w.msg_from AND w.msg_to WHERE chars > {max}),
pk(session_id, part, rn, grp, held) AS (
  SELECT session_id, part, rn, 1, CASE WHEN size <= {max} THEN size END FROM m WHERE rn = 1
  UNION ALL SELECT m.session_id, m.part, m.rn, grp + (m.size > {max} OR held IS NULL OR held + m.size > {max})::INT, CASE WHEN m.size > {max} THEN NULL WHEN held IS NULL OR held + m.size > {max} THEN m.size ELSE held + m.size END
  FROM pk JOIN m ON m.session_id = pk.session_id AND m.part = pk.part AND m.rn = pk.rn + 1),
cm(session_id, part, msg_idx, role, text, whole, all_errors, a, b) AS (
  SELECT session_id, part, msg_idx, role, text, whole, all_errors, 0::BIGINT, 0::BIGINT FROM m WHERE size > {max}
  UNION ALL SELECT session_id, part, msg_idx, role, text, whole, all_errors, b, CASE WHEN b + {max} >= length(text) THEN length(text) WHEN stop > {max} * 0.5 THEN b + stop ELSE b + {max} END FROM (
    SELECT *, greatest(CASE WHEN strpos(v, chr(10)) > 0 THEN {max} - strpos(v, chr(10)) + 1 ELSE 0 END, CASE WHEN strpos(v, ' .') > 0 THEN {max} - strpos(v, ' .') + 1 ELSE 0 END) AS stop
    FROM (SELECT *, reverse(substr(text, b + 1, {max})) AS v FROM cm WHERE b < length(text)))),
bits AS (
  SELECT m.session_id, m.part, min(msg_idx) AS msg_from, max(msg_idx) AS msg_to, NULL::BIGINT AS char_from, NULL::BIGINT AS char_to, sum(size)::BIGINT AS own, sum((length({strip}) > 80)::INT) AS substantive, sum(len(regexp_extract_all(text, '```'))) AS fences,
    any_value(whole) AS whole, any_value(all_errors) AS all_errors, arg_min(role, msg_idx) AS role, arg_min(text, msg_idx) AS first_text FROM m JOIN pk USING (session_id, part, rn) WHERE size <= {max} GROUP BY m.session_id, m.part, grp
  UNION ALL SELECT session_id, part, msg_idx, msg_idx, a, b, b - a, (length({strip}) > 80)::INT, len(regexp_extract_all(text, '```')), whole, all_errors, role, text
  FROM (SELECT session_id, part, msg_idx, a, b, substr(text, a + 1, b - a) AS text, whole, all_errors, role FROM cm WHERE b > 0)),
pc AS (
  SELECT session_id, msg_from, msg_to, char_from, char_to, msg_to - msg_from + 1 AS n, own AS chars, substantive, fences / 2.0::DOUBLE AS code_blocks, round_even(all_errors * (own::DOUBLE / whole), 0)::BIGINT AS errors, true AS sub_split FROM bits
  UNION ALL SELECT session_id, msg_from, msg_to, NULL, NULL, n, chars, substantive, code_blocks, errors, false FROM w WHERE chars <= {max}),
po AS (
  SELECT pc.*, row_number() OVER (PARTITION BY pc.session_id ORDER BY pc.msg_from, pc.char_from NULLS FIRST) AS place, pc.chars < {min} AND coalesce(pt.score, 0) < 1.97 AS small
  FROM pc LEFT JOIN pt ON pt.session_id = pc.session_id AND pt."start" = pc.msg_from),
fo(session_id, place, grp, held) AS (
  SELECT session_id, place, 1, chars FROM po WHERE place = 1
  UNION ALL SELECT po.session_id, po.place, grp + (NOT small OR held + po.chars > {max})::INT, CASE WHEN NOT small OR held + po.chars > {max} THEN po.chars ELSE held + po.chars END FROM fo JOIN po ON po.session_id = fo.session_id AND po.place = fo.place + 1),
ft AS (
  SELECT po.session_id, min(msg_from) AS msg_from, arg_max(msg_to, place) AS msg_to, arg_min({{'c': char_from}}, place).c AS char_from, sum(n) AS exchanges, sum(chars)::BIGINT AS chars, sum(substantive) AS substantive, sum(code_blocks) AS code_blocks,
    sum(errors) AS errors, arg_min(sub_split, place) AS sub_split FROM po JOIN fo USING (session_id, place) GROUP BY po.session_id, grp),
al AS (
  SELECT * FROM ft UNION ALL SELECT session_id, msg_from, msg_to, NULL, exchanges, chars, substantive, code_blocks, errors, false FROM s WHERE session_id NOT IN (SELECT session_id FROM lg)),
ai AS (
  SELECT *, log2(1 + exchanges::DOUBLE) * 1.2 + least(6, substantive) * 0.5 + least(5.0, code_blocks) * 1.1 + least(8, errors) * 0.45 + log2(1 + chars::DOUBLE / 1000.0) * 0.8 AS interest FROM al),
ar AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY interest DESC, msg_from, char_from NULLS FIRST) <= 14 AS kept FROM ai),
st AS (SELECT *, CASE WHEN kept THEN 't' || row_number() OVER (PARTITION BY session_id, kept ORDER BY msg_from, char_from NULLS FIRST) END AS topic_id FROM ar)
"""
_PLACED = """
sk AS (SELECT *, rank <= {n} AS kept FROM sr),
topics AS (SELECT *, CASE WHEN kept THEN 't' || row_number() OVER (PARTITION BY session_id, kept ORDER BY msg_from) END AS topic_id FROM sk)
"""
_TOPICS = _TOPICS_ALL + _PLACED.format(n=2)
_TOPICS14 = _TOPICS_ALL + _PLACED.format(n=14)


def _title(x: str) -> str:
    line = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '' AND NOT starts_with(l, '```'))[1]"
    return rf"trim(regexp_replace(regexp_replace({line}, '^[#>\-*\s]+', ''), '{_WS}+', ' ', 'g'))"


_ROLE = """CASE WHEN lower(role) IN ('human', 'user', 'input') THEN 'user' WHEN lower(role) IN ('assistant', 'ai', 'model', 'output', 'bot') THEN 'assistant'
  WHEN lower(role) IN ('system', 'developer') THEN 'system' WHEN lower(role) IN ('tool', 'toolresult', 'tool_result', 'tool-call', 'function') THEN 'tool' ELSE 'assistant' END"""

#: The quizzes that queries._quizzes makes.
_QUIZZES = (
    _TURNS
    + """
n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, session_id::BIGINT AS k FROM t),
c AS (SELECT *, CASE WHEN k % 5 = 1 THEN greatest(n - 1, 1) ELSE n END AS covered FROM n),
f AS (
  SELECT session_id, any_value(k) AS k, any_value(n) AS n, any_value(covered) AS covered,
    sha256(coalesce(string_agg(role || chr(0) || text || chr(1), '' ORDER BY msg_idx) FILTER (msg_idx < covered), '')) AS now_fp,
    sha256(coalesce(string_agg(role || chr(0) || text || CASE WHEN k % 7 = 3 AND msg_idx = 0 THEN '!' ELSE '' END || chr(1), '' ORDER BY msg_idx) FILTER (msg_idx < covered), '')) AS then_fp
  FROM c GROUP BY session_id),
st AS (
  SELECT session_id, k, n, covered, CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 13 = 5 THEN 'generator_stale' WHEN now_fp <> then_fp THEN 'diverged' WHEN n > covered THEN 'extended'
    WHEN k % 11 = 4 THEN 'settings_changed' ELSE 'fresh' END AS state FROM f),
sn AS (SELECT *, CASE WHEN state = 'extended' THEN n - covered ELSE 0 END AS new_messages FROM st)
"""
)


def _clip(x: str, n: int, counted: bool = False) -> str:
    tail = f"chr(10) || '… (' || (length({x}) - {n}) || ' more chars)'" if counted else "'…'"
    return f"CASE WHEN length({x}) > {n} THEN {_strip_end(f'substr({x}, 1, {n})')} || {tail} ELSE {x} END"


def _indent(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN l = '' THEN l ELSE '  ' || l END), chr(10))"


def _lines(scope: str) -> str:
    """turns q with their transcript lines; scope partitions the last assistant turn."""
    return f"""
ql AS (SELECT *, max(CASE WHEN role = 'assistant' THEN msg_idx END) OVER (PARTITION BY {scope}) AS last_a FROM q),
qt AS (
  SELECT *, CASE role WHEN 'user' THEN '[turn ' || msg_idx || '] USER ' || chr(10) || {_indent(_clip('text', 4000, True))} || chr(10)
    WHEN 'assistant' THEN '[turn ' || msg_idx || '] ASSISTANT ' || chr(10) || {_indent(f"CASE WHEN msg_idx = last_a THEN {_clip('text', 3000, True)} ELSE {_clip('text', 700, True)} END")} || chr(10) END AS line FROM ql),
"""


_TRANSCRIPT = _TURNS + "q AS (SELECT * FROM t)," + _lines("session_id") + f"tr AS (SELECT session_id, {_strip('''coalesce(string_agg(line, chr(10) ORDER BY msg_idx), '')''')} AS transcript FROM qt GROUP BY session_id)"


def _context(budget: int) -> str:
    """cx: session_id, topic_id, context of kept topics."""
    head = "'--- PRECEDING CONTEXT (background from earlier in the same session; not part of this topic) ---' || chr(10)"
    part = lambda who, i, x, n: f"chr(10) || '[turn ' || {i} || '] {who} (earlier)' || chr(10) || {_clip(x, n)} || chr(10)"
    return f"""
pu AS (
  SELECT p.session_id, p.topic_id, max(CASE WHEN role = 'user' THEN msg_idx END) AS u, max(CASE WHEN role = 'assistant' THEN msg_idx END) AS a
  FROM topics p LEFT JOIN t ON t.session_id = p.session_id AND t.msg_idx < p.msg_from WHERE kept GROUP BY 1, 2),
pc AS (
  SELECT pu.*, CASE WHEN u IS NULL THEN '' ELSE {head} || {part('USER', 'u', 'ut.text', int(budget * 0.35))} || CASE WHEN a > u THEN {part('ASSISTANT', 'a', 'at_.text', int(budget * 0.5))} ELSE '' END END AS whole
  FROM pu LEFT JOIN t ut ON ut.session_id = pu.session_id AND ut.msg_idx = u LEFT JOIN t at_ ON at_.session_id = pu.session_id AND at_.msg_idx = a),
cx AS (SELECT session_id, topic_id, CASE WHEN u IS NULL THEN '' WHEN length(whole) > {budget} THEN substr(whole, 1, {budget}) || chr(10) || '… (earlier context truncated)' || chr(10) || chr(10) || chr(10) ELSE whole || chr(10) END AS context FROM pc)
"""


def oracle_sql() -> dict[str, str]:
    out = {}
    out["session_catalog"] = f"""WITH {_TURNS} s AS (
  SELECT session_id, count(*) AS messages, count_if(role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars, 0::BIGINT AS tool_calls, arg_min(text, msg_idx) FILTER (role = 'user') AS u FROM t GROUP BY session_id)
SELECT session_id, messages, user_turns, chars, tool_calls, coalesce(CASE WHEN length({_title('u')}) > 72 THEN {_strip_end(f"substr({_title('u')}, 1, 71)")} || '…' ELSE {_title('u')} END, 'Untitled') AS title
FROM s WHERE user_turns >= 2 AND chars >= 400"""
    out["harness_report"] = """SELECT source AS harness, count(*) AS file_count, 0::BIGINT AS detected_only, count_if(length(text) < 100) AS empty, count_if(text IS NULL) AS skipped, coalesce(sum(length(text)), 0)::BIGINT AS total_bytes,
  count_if(length(text) >= 100) AS session_count, count_if(length(text) >= 400) AS quiz_ready, coalesce(sum(length(text)) FILTER (length(text) >= 100), 0)::BIGINT AS total_chars FROM documents GROUP BY source"""
    out["role_normalized"] = f"SELECT role, {_ROLE} AS normal, count(*) AS n FROM (SELECT role FROM conversations UNION ALL SELECT event_type FROM events) GROUP BY role, normal"
    out["epoch_ms_tolerant"] = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts::TIMESTAMP) // 1000000 * 1000 WHEN 1 THEN epoch_us(ts::TIMESTAMP) // 1000 WHEN 2 THEN epoch_ms(date_trunc('second', ts::TIMESTAMP)) END AS ts_ms FROM events"""
    t = _title("text")
    out["title_derivation"] = f"""SELECT key, CASE WHEN length({t}) > 72 THEN {_strip_end(f'substr({t}, 1, 71)')} || '…' ELSE {t} END AS title
FROM (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations)"""
    out["merged_turns"] = """WITH a AS (SELECT user_id::VARCHAR AS session_id, event_type AS role, 'e' || event_id AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
b AS (SELECT *, coalesce((role <> lag(role) OVER (PARTITION BY session_id ORDER BY pos))::INT, 1) AS new FROM a), c AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY pos) - 1 AS msg_idx FROM b)
SELECT session_id, msg_idx::INTEGER AS msg_idx, any_value(role) AS role, string_agg(x, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS merged FROM c GROUP BY session_id, msg_idx"""
    out["dedupe_first"] = "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1"
    out["cap_per_group"] = "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5"
    out["search_substring"] = "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'apache license')"
    out["exchanges"] = f"""WITH {_EXCHANGES[:-2]} SELECT session_id, exchange, "start"::INTEGER AS "start", "end"::INTEGER AS "end", chars, substantive, len(tokens)::INTEGER AS n_tokens FROM g"""
    out["token_jaccard"] = f"WITH {_EXCHANGES[:-2]} SELECT session_id, exchange, round(jac, 9) AS jaccard FROM g WHERE before IS NOT NULL"
    out["boundary_scores"] = f"WITH {_EXCHANGES[:-2]} SELECT session_id, exchange, round(score, 9) AS score FROM g WHERE score IS NOT NULL"
    out["segments"] = f"""WITH {_EXCHANGES[:-2]} SELECT session_id, segment::BIGINT AS segment, min("start")::INTEGER AS msg_from, max("end")::INTEGER AS msg_to, count(*) AS exchanges FROM g GROUP BY session_id, segment"""
    out["topics_ranked"] = f"WITH {_TOPICS} SELECT session_id, msg_from::INTEGER AS msg_from, msg_to::INTEGER AS msg_to, exchanges, chars, round(interest, 6) AS interest, rank::INTEGER AS rank, kept, topic_id FROM topics"
    cut = "substr(clean, 1, 90)"
    at = f"(90 - strpos(reverse({cut}), ' '))"
    out["topic_labels"] = f"""WITH {_TOPICS} SELECT session_id, msg_from::INTEGER AS msg_from, CASE WHEN clean = '' THEN 'untitled topic' WHEN length(clean) > 90
  THEN {_strip_end(f"CASE WHEN strpos({cut}, ' ') > 0 AND {at} > 45 THEN substr({cut}, 1, {at}) ELSE {cut} END")} || '…' ELSE clean END AS label FROM topics"""
    out["topic_stats"] = f"""WITH {_TOPICS}, z AS (SELECT session_id, count(*) AS candidates, count_if(kept) AS kept, sum(chars) AS all_chars, list_sort(list(chars) FILTER (kept)) AS sizes FROM topics GROUP BY session_id)
SELECT session_id, candidates, kept, sizes[-1] AS largest, sizes[len(sizes) // 2 + 1] AS median, sizes[1] AS smallest, candidates - kept AS dropped, (all_chars - list_sum(sizes))::BIGINT AS dropped_chars,
  round(CASE WHEN all_chars > 0 THEN list_sum(sizes)::DOUBLE / all_chars::DOUBLE ELSE 0 END, 9) AS coverage FROM z"""
    out["pause_gaps"] = """WITH a AS (SELECT user_id, (epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
SELECT user_id, sum(CASE WHEN gap > 7200 THEN 3.0::DOUBLE WHEN gap > 1800 THEN 1.5::DOUBLE ELSE 0 END) AS pause_score, count_if(gap > 1800) AS pauses, count(*) AS events FROM a GROUP BY user_id"""
    out["payload_prefix"] = f"""WITH {_TURNS} n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS message_count FROM t),
k AS (SELECT session_id, msg_idx, role, message_count, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS text FROM n WHERE message_count <= 6 OR msg_idx < 2 OR msg_idx >= message_count - 4),
u AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY msg_idx) AS used, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) AS p FROM k)
SELECT session_id, msg_idx::INTEGER AS msg_idx, role, text, used::BIGINT AS used, message_count FROM u WHERE used <= 1800 OR p = 1"""
    out["preceding_context"] = f"WITH {_TOPICS}, {_context(600)} SELECT session_id, topic_id, context FROM cx"
    out["rendered_transcript"] = f"WITH {_TRANSCRIPT} SELECT * FROM tr"
    out["topic_slices"] = f"""WITH {_TOPICS}, {_context(450)}, q AS (SELECT p.session_id, topic_id, msg_idx, role, text FROM topics p JOIN t ON t.session_id = p.session_id AND msg_idx BETWEEN msg_from AND msg_to WHERE kept), {_lines('session_id, topic_id')}
sb AS (SELECT session_id, topic_id, {_strip("coalesce(string_agg(line, chr(10) ORDER BY msg_idx), '')")} AS body FROM qt GROUP BY session_id, topic_id),
sl AS (SELECT p.*, CASE WHEN clean = '' THEN 'untitled topic' WHEN length(clean) > 90
  THEN {_strip_end(f"CASE WHEN strpos({cut}, ' ') > 0 AND {at} > 45 THEN substr({cut}, 1, {at}) ELSE {cut} END")} || '…' ELSE clean END AS label FROM topics p WHERE kept),
sh AS (SELECT sl.session_id, sl.topic_id, label, context, body, '--- TOPIC: ' || label || ' (turns ' || msg_from || '-' || msg_to || ') ---' || chr(10) || chr(10) AS header FROM sl JOIN sb USING (session_id, topic_id) JOIN cx USING (session_id, topic_id)),
so AS (SELECT *, greatest(120, 1500 - length(header) - length(context) - 80) AS room FROM sh),
sx AS (SELECT *, greatest(length(body) - room, 0) AS truncated, context || header || CASE WHEN length(body) > room THEN substr(body, 1, room) || chr(10) || '… (' || (length(body) - room) || ' chars of this topic omitted)' ELSE body END AS text FROM so)
SELECT session_id, topic_id, label, text, length(text)::INTEGER AS chars, length(context)::INTEGER AS context_chars, truncated::INTEGER AS truncated FROM sx"""
    out["fingerprints"] = f"WITH {_TURNS[:-2]} SELECT session_id, sha256(string_agg(role || chr(0) || text || chr(1), '' ORDER BY msg_idx)) AS fingerprint, count(*) AS messages FROM t GROUP BY session_id"
    out["turn_parts"] = f"WITH {_TURNS[:-2]} SELECT session_id, msg_idx::INTEGER AS msg_idx, sha256(role || chr(0) || text || chr(1)) AS turn_sha FROM t"
    out["staleness"] = f"WITH {_QUIZZES} SELECT session_id, state, new_messages FROM sn"
    out["quiz_button"] = f"""WITH {_QUIZZES} SELECT session_id, CASE WHEN state = 'new' THEN 'configure' WHEN k % 4 = 0 THEN 'resume' ELSE 'open' END AS action,
  CASE WHEN state = 'new' THEN 'Generate quiz' WHEN k % 4 = 0 THEN 'Resume quiz' ELSE 'Back to quiz' END AS label,
  CASE WHEN state = 'new' THEN 'No quiz for this conversation yet.' WHEN k % 4 = 0 THEN 'You are partway through this quiz, 2 answered.'
    WHEN state = 'extended' THEN new_messages || CASE WHEN new_messages = 1 THEN ' new message' ELSE ' new messages' END || ' since this quiz was made.' WHEN state = 'diverged' THEN 'The part of this conversation this quiz used has changed.'
    WHEN state = 'settings_changed' THEN 'Your current settings differ from this quiz.' WHEN state = 'generator_stale' THEN 'This quiz came from an older version of the generator.' ELSE 'A quiz is ready for this conversation.' END AS reason FROM sn"""
    out["readiness"] = f"""WITH {_TOPICS14}, h AS (SELECT session_id, count(*) AS topics, count_if(chars >= 750 AND exchanges >= 1) AS usable FROM topics WHERE kept GROUP BY session_id),
r AS (SELECT session_id, count_if(role = 'user') AS u, sum(length(text)) AS c FROM t GROUP BY session_id), a AS (SELECT r.*, coalesce(topics, 0) AS topics, coalesce(usable, 0) AS usable FROM r LEFT JOIN h USING (session_id))
SELECT session_id, usable > 0 AND u >= 1 AND c >= 400 AS ready, CASE WHEN u = 0 OR c = 0 THEN 'empty' WHEN usable = 0 THEN 'thin' WHEN topics > usable THEN 'partial' ELSE 'ready' END AS level,
  concat_ws('; ', CASE WHEN u < 1 THEN 'only ' || u || ' user turns, need 1' END, CASE WHEN c < 400 THEN 'only ' || c || ' characters, need 400' END,
    CASE WHEN topics = 0 THEN 'no topic could be derived' WHEN usable = 0 THEN 'all ' || topics || ' topic(s) are below 750 characters' END) AS reasons, topics, usable AS usable_topics FROM a"""
    deck = lambda asked, n, seed: f"""fit AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sha256('{seed}:' || session_id || ':' || msg_from), msg_from) AS d FROM topics WHERE kept AND chars >= {max(700, 250 * n)}),
drawn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_from) - 1 AS ordinal, count(*) OVER (PARTITION BY session_id) AS size FROM fit WHERE d <= {-(-asked // n)}),
deck AS (SELECT *, least({asked}, size * {n}) AS question_count FROM drawn)"""  # noqa: E731
    out["quiz_plan"] = f"""WITH {_TOPICS14}, {deck(4, 2, 7)} SELECT session_id, topic_id, msg_from::INTEGER AS msg_from, ordinal::INTEGER AS ordinal,
  array_to_string(list_transform(list_filter(range(4), lambda i: i < question_count AND i % size = ordinal), lambda i: ['mcq', 'cloze'][i // size % 2 + 1]), ',') AS types, question_count::INTEGER AS question_count, (4 - question_count)::INTEGER AS shortfall FROM deck"""
    out["deck_assignment"] = f"""WITH {_TOPICS14}, {deck(6, 3, 3)}, o AS (SELECT unnest(list_transform(list_filter(range(6), lambda i: i < question_count AND i % size = ordinal), lambda i: ['mcq', 'cloze', 'open'][i // size % 3 + 1])) AS type FROM deck) SELECT type, count(*) AS slots FROM o GROUP BY type"""
    out["mcq_grading"] = "SELECT doc_id, (quality = 1)::INT::DOUBLE AS awarded FROM labels"
    key = lambda x: rf"""regexp_replace(regexp_replace(lower({x}), '^({_WS}|[`"'';,])+|({_WS}|[`"'';,])+$', '', 'g'), '{_WS}+', ' ', 'g')"""
    right = f"CASE WHEN i % 2 = 1 THEN CASE item_id % 3 WHEN 0 THEN {key("replace(w, 'ß', 'ss')")} = {key('w')} AND {key('w')} <> '' WHEN 1 THEN true ELSE {key('w')} = 'wrong' END ELSE item_id % 3 <> 1 AND {key('w')} <> '' END"
    # Upper case of ß is SS, so an answer in capitals isn't that word any more.
    out["cloze_grading"] = f"""WITH b AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM benchmark)
SELECT item_id, round(avg(({right})::INT), 6) AS awarded FROM b GROUP BY item_id"""
    out["tolerant_answers"] = f"SELECT item_id, {key('text')} AS answer FROM benchmark"
    out["weighted_rubric"] = """WITH m AS (SELECT l_orderkey, floor(sum(l_quantity::DOUBLE * greatest(0, least(1, l_discount::DOUBLE * 12))) / sum(l_quantity::DOUBLE) * 1e6 + 0.3) / 1e6 AS mark FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, mark, CASE WHEN mark >= 0.85 THEN 'correct' WHEN mark > 0 THEN 'partial' ELSE 'incorrect' END AS verdict FROM m"""
    out["score_bands"] = """WITH p AS (SELECT greatest(0, least(100, round(sum(l_discount * 1000)::DOUBLE / count(*) * 1.4 - 10, 4))) AS pct FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN pct < 25 THEN 'unfamiliar' WHEN pct < 50 THEN 'partial' WHEN pct < 75 THEN 'solid' ELSE 'strong' END AS band, count(*) AS n FROM p GROUP BY band"""
    out["attempt_scores"] = """WITH g AS (SELECT o_custkey AS attempt_id, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 3) / 2.0::DOUBLE END AS awarded, o_orderkey % 3 = 2 AS correct, o_orderkey % 7 > 0 AS attempted FROM orders),
a AS (SELECT attempt_id, round(coalesce(sum(awarded), 0), 3) AS score, count(awarded) AS max_score, count(*) FILTER (awarded > 0 OR correct) AS answered, count_if(attempted) AS attempted, count(*) AS total FROM g GROUP BY attempt_id),
p AS (SELECT *, CASE WHEN max_score > 0 THEN round(score / max_score * 100, 1) ELSE 0 END AS percentage FROM a)
SELECT *, CASE WHEN percentage < 25 THEN 'unfamiliar' WHEN percentage < 50 THEN 'partial' WHEN percentage < 75 THEN 'solid' ELSE 'strong' END AS band FROM p"""
    out["latest_attempt"] = """SELECT o_custkey AS quiz_id, o_orderkey AS attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate::DATE + CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 0 END DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
    out["upsert_quiz"] = """WITH n AS (SELECT c_custkey * 2 AS quiz_id, 'new ' || c_name AS title, 'NEXT' AS model FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(c_custkey, quiz_id) AS quiz_id, coalesce(c_name, title) AS title, CASE WHEN quiz_id IS NOT NULL THEN model ELSE c_mktsegment END AS model FROM customer FULL JOIN n ON quiz_id = c_custkey"""
    out["anti_absent"] = "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
    out["store_stats"] = """SELECT count(*) AS quizzes, count(DISTINCT o_custkey) AS conversations, (min(o_orderdate::DATE) - DATE '1970-01-01')::INTEGER AS oldest, (max(o_orderdate::DATE) - DATE '1970-01-01')::INTEGER AS newest, count_if(o_orderkey % 2 = 0)::INTEGER AS attempts FROM orders"""
    out["json_props"] = "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events"
    out["json_shape_counts"] = """SELECT event_type, CASE WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'number' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY ALL"""
    out["fence_and_error_features"] = f"""SELECT doc_id, len(regexp_extract_all(text, '```')) / 2.0::DOUBLE AS code_blocks, len(regexp_extract_all(text, '{_quote(ERRORS)}'))::BIGINT AS errors, length({_strip('text')}) > 80 AS substantive,
  len(regexp_extract_all(text, chr(10)))::BIGINT AS breaks FROM documents"""
    out["clipped_texts"] = f"SELECT doc_id, {_clip('text', 200)} AS head, {_clip('text', 500, True)} AS counted FROM documents"
    out["grouped_sessions"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents)
SELECT source AS harness, count(*) AS size, string_agg(doc_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS newest FROM r GROUP BY source"""
    split = _SPLIT.format(max=1500, min=200, strip=_strip("text"))
    out["topics_split_by_size"] = f"""WITH RECURSIVE {_TOPICS_ALL.rstrip().rstrip(',')}, {split}
SELECT session_id, msg_from::INTEGER AS msg_from, msg_to::INTEGER AS msg_to, chars, sub_split, kept, topic_id FROM st"""
    session = f"""s AS (SELECT session_id, count(*) AS messages, count_if(role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars, arg_min(text, msg_idx) FILTER (role = 'user') AS u FROM t GROUP BY session_id)"""
    title = f"""coalesce(CASE WHEN length({_title('u')}) > 72 THEN {_strip_end(f"substr({_title('u')}, 1, 71)")} || '…' ELSE {_title('u')} END, 'Untitled')"""
    n_head, n_tail = middle_cut(1100)
    middle = f"""CASE WHEN length(transcript) > 1100 THEN {_strip_end(f'substr(transcript, 1, {n_head})')} || chr(10) || chr(10) || '… (' || (length(transcript) - {n_head + n_tail}) || ' chars omitted from the middle) …' || chr(10) || chr(10)
  || regexp_replace(right(transcript, {n_tail}), '^{_WS}+', '') ELSE transcript END"""
    out["digest"] = f"""WITH {_TRANSCRIPT}, {session},
h AS (SELECT s.*, transcript, '# Session digest' || chr(10) || chr(10) || 'title:      ' || {title} || chr(10) || 'started:    unknown' || chr(10) || 'duration:   unknown' || chr(10) || 'turns:      ' || messages || ' messages (' || user_turns || ' user, '
  || (messages - user_turns) || ' assistant)' || chr(10) || 'tool calls: 0' || chr(10) || 'omitted:    0 chars of model reasoning, and all tool output bodies' AS header FROM s JOIN tr USING (session_id)),
d AS (SELECT session_id, transcript, {_clip('header', 900, True)} AS header, {middle} AS conversation FROM h),
x AS (SELECT *, header || chr(10) || chr(10) || '## Conversation' || chr(10) || chr(10) || conversation AS whole FROM d)
SELECT session_id, CASE WHEN length(whole) > 2400 THEN substr(whole, 1, 2320) || chr(10) || chr(10) || '… (hard limit reached: ' || (length(whole) - 2400) || ' chars omitted)' ELSE whole END AS text,
  CASE WHEN length(whole) > 2400 THEN 2320 + 2 + length('… (hard limit reached: ' || (length(whole) - 2400) || ' chars omitted)') ELSE length(whole) END::INTEGER AS chars, greatest(length(transcript) - length(conversation), 0)::INTEGER AS omitted FROM x"""
    out["slice_statistics"] = f"""SELECT session_id, count(*) AS prompt_count, sum(chars)::BIGINT AS slice_chars, max(chars) AS largest_slice, count_if(truncated > 0) AS cut_slices, 1500 AS max_chars_per_prompt FROM ({out["topic_slices"]}) GROUP BY session_id"""
    times = lambda a, b: f"((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"
    drawn = lambda seed, k: (
        f"""(SELECT xor(u, u >> 14) / 4294967296.0::DOUBLE FROM (SELECT xor((t + {times('xor(t, t >> 7)', 't | 61')}) % 4294967296, t) AS u FROM (SELECT {times('xor(a, a >> 15)', 'a | 1')} AS t FROM (SELECT (({seed})::BIGINT % 4294967296 + ({k}) * 1831565813::BIGINT) % 4294967296 AS a))))"""
    )
    out["seeded_draws"] = f"SELECT event_id, {', '.join(f'{drawn(chr(40) + "event_id::BIGINT * 2654435761" + chr(41), k)} AS draw_{k}' for k in (1, 2, 3))} FROM events"
    out["seeded_shuffle"] = f"""WITH RECURSIVE o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey),
r(o_custkey, x, i) AS (
  SELECT o_custkey, x, len(x) - 1 FROM o
  UNION ALL SELECT o_custkey, list_transform(range(len(x)), lambda p: CASE WHEN p = i THEN x[j + 1] WHEN p = j THEN x[i + 1] ELSE x[p + 1] END), i - 1
  FROM (SELECT *, floor({drawn('o_custkey', 'len(x) - i')} * (i + 1))::BIGINT AS j FROM r WHERE i > 0))
SELECT o_custkey, array_to_string(x, ',') AS shuffled FROM r WHERE i <= 0"""
    out["resumed_steps"] = """WITH a AS (SELECT DISTINCT l_orderkey AS session_id, unnest([l_linenumber, l_linenumber + 5]) AS m FROM lineitem WHERE l_linenumber % 2 = 0),
f AS (SELECT l_orderkey AS session_id, l_linenumber AS m FROM lineitem)
SELECT a.session_id, 's' || a.m AS step_id, f.m - 1 AS position, 'a' || a.m AS answer, CASE WHEN f.m IS NOT NULL THEN 'r' || a.m END AS result FROM a LEFT JOIN f ON f.session_id = a.session_id AND f.m = a.m"""
    out["phase_counts"] = "SELECT l_orderkey AS session_id, count_if(l_linenumber <= 2) AS flashcards, count_if(l_linenumber > 2) AS questions FROM lineitem GROUP BY l_orderkey"
    counted = lambda n, one: f"format('{{:,}}', {n}) || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {one}s' END"
    out["session_lines"] = f"WITH {_TURNS} {session} SELECT session_id, {counted('messages', 'turn')} || ' · ' || {counted('chars', 'character')} || ' · ' AS line FROM s"
    out["payload_lines"] = f"""SELECT session_id, format('{{:,}}', n) || ' of ' || {counted('m', 'message')} || ' · ' || {counted('c', 'character')} || CASE WHEN n < m THEN ' · shortened' ELSE '' END AS line
FROM (SELECT session_id, count(*) AS n, max(used)::BIGINT AS c, any_value(message_count) AS m FROM ({out["payload_prefix"]}) GROUP BY session_id)"""
    out["anti_absent"] = "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)"
    # The given texts have secrets of one kind: quoted values behind a name of a secret.
    named = rf"""(^|[^A-Za-z])((?i:{SECRET_WORDS})\s*[:=]\s*")[^"\n\r]{{6,512}}(")"""
    found = f"len(regexp_extract_all(text, '{_quote(named)}'))"
    out["redacted_text"] = f"""SELECT doc_id, {found}::BIGINT AS findings, regexp_replace(text, '{_quote(named)}', '\\1\\2[redacted:labelled-secret]\\3', 'g') AS text FROM documents WHERE {found} > 0"""
    out["redaction_report"] = f"""SELECT source, 'labelled-secret' AS kind, sum({found})::BIGINT AS findings FROM documents GROUP BY source HAVING sum({found}) > 0"""
    from . import parts, readers  # which take helpers from here

    return out | readers.oracle_sql() | parts.oracle_sql()
