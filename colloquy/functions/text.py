"""Text functions as Spark expressions. Lengths are code points (the reference counts UTF-16 units; see utf16_length)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without topic signal.
STOPWORDS = (
    "the and for you can not but this that with have from what when how why does did was were are is its it a an in on of to be do so if my "
    "me we us i please thanks thank also just now then there here get got let make made need want like would should could will about into out "
    "up down all some any one two more most very really still"
).split()
ELLIPSIS = "…"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\U00010000-\U0010ffff]", ""))


def strip(text: Column) -> Column:
    """Trims all Unicode white space on both ends, and the byte order mark."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def collapse(text: Column) -> Column:
    """White space runs become one space; the ends are trimmed."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def title_of(text: Column, most: int = 72) -> Column:
    """The first line that is neither blank nor a fence, without leading markup, at most so many characters; else null."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.startswith("```"))
    line = collapse(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^[#>\-*\s]+", ""))
    return F.when(F.length(line) > most, F.concat(strip_end(F.substring(line, 1, most - 1)), F.lit(ELLIPSIS))).otherwise(line)


def label_of(text: Column, most: int = 90) -> Column:
    """A topic's label: fenced code out, spaces collapsed, cut at the last space if that is past the middle."""
    clean = collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " "))
    cut = F.substring(clean, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # as an offset; the length where there is none
    at_space = (F.instr(cut, " ") > 0) & (space > most * 0.5)
    short = F.concat(strip_end(F.when(at_space, F.substr(cut, F.lit(1), space)).otherwise(cut)), F.lit(ELLIPSIS))
    return F.when(clean == "", F.lit("untitled topic")).when(F.length(clean) > most, short).otherwise(clean)


#: Openings that tell nothing about a subject.
NARRATION = (
    r"^(?:ok(?:ay)?[,.]?\s*)?(?:the user|they|the assistant)\s+(?:wants?|asked?|is|has|says?|would like|needs?)\s+(?:me\s+)?(?:to\s+)?",
    r"^(?:now|next|then|so|alright|right)[,:]?\s+",
)
#: A paragraph worth telling, a sentence worth telling, and the most of either.
LEAST_TOLD, MOST_SENTENCE, MOST_TOLD = 20, 110, 100


def statement_of(text: Column, turn: Column) -> Column:
    """What a text without a user's words is about: a sentence, or the start, of its first paragraph worth telling."""
    told_in = F.try_element_at(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(strip(p)) > LEAST_TOLD), F.lit(1))
    plain = collapse(F.regexp_replace(F.regexp_replace(F.coalesce(told_in, text), r"(?s)```.*?```", " "), r"[#*_`>]", ""))
    bare = plain
    for opening in NARRATION:
        bare = F.regexp_replace(bare, f"(?i){opening}", "")
    told = F.when(F.length(strip(bare)) > LEAST_TOLD, strip(bare)).otherwise(plain)
    sentence = F.nullif(F.regexp_extract(told, rf"^(.{{{LEAST_TOLD},{MOST_SENTENCE}}}?[.!?])(?=\s|$)", 1), F.lit(""))
    out = strip(F.substring(F.coalesce(sentence, told), 1, MOST_TOLD))
    return F.coalesce(F.nullif(out, F.lit("")), F.concat(F.lit("continued (turn "), turn.cast("string"), F.lit(")")))


def clip(text: Column, most, counted: bool = False) -> Column:
    """At most so many characters; counted adds how many went."""
    most = most if isinstance(most, Column) else F.lit(most)
    tail = F.concat(F.lit("\n… ("), (F.length(text) - most).cast("string"), F.lit(" more chars)")) if counted else F.lit(ELLIPSIS)
    return F.when(F.length(text) > most, F.concat(strip_end(F.substr(text, F.lit(1), most)), tail)).otherwise(text)


def middle_cut(most: int, head_share: float = 0.62) -> tuple[int, int]:
    """How much of a long text's head and tail stay; 64 characters are kept for a marker."""
    room = max(0, most - 64)
    head = int(room * head_share)
    return head, room - head


def middle_out(head_text: Column, tail_text: Column, length: Column, head: int, tail: int) -> Column:
    """A text of this length without its middle, of what it begins and ends with."""
    marker = F.concat(F.lit("\n\n… ("), (length - head - tail).cast("string"), F.lit(" chars omitted from the middle) …\n\n"))
    return F.concat(strip_end(F.substring(head_text, 1, head)), marker, F.regexp_replace(F.substr(tail_text, F.length(tail_text) - tail + 1, F.lit(tail)), r"(?U)^\s+", ""))


def clip_middle(text: Column, most: int, head_share: float = 0.62) -> Column:
    """Head and tail of a long text with a marker of what went between."""
    head, tail = middle_cut(most, head_share)
    return F.when(F.length(text) > most, middle_out(text, text, F.length(text), head, tail)).otherwise(text)


def indent(text: Column, pad: int = 2) -> Column:
    """Pads lines that aren't empty."""
    return F.regexp_replace(text, r"(?m)^(?=.)", " " * pad)


def duration(ms: Column) -> Column:
    """unknown, Nm, Nh or Nh Nm."""
    minutes = F.round(ms / 60000).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60)
    long = F.when(rest == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m")))
    return F.when(ms.isNull() | (ms <= 0), "unknown").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(long)


def time_ago(now_ms: Column, ms: Column) -> Column:
    """today, yesterday, Nd, Nmo or Ny before now_ms, which is given so that results repeat."""
    days = F.floor((now_ms - ms) / 86_400_000)
    count = lambda n, unit: F.concat(F.floor(days / n).cast("string"), F.lit(unit))
    return F.when(ms.isNull(), "").when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, count(1, "d")).when(days < 365, count(30, "mo")).otherwise(count(365, "y"))


def tokens(text: Column) -> Column:
    """Distinct topic words in order: lower case, split at other than [a-z0-9_.-], edges trimmed, 3 characters or more,
    no stop words. Letters outside a-z split words, as in the reference."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_.\-]+"), lambda w: F.regexp_replace(w, r"^[._\-]+|[._\-]+\z", ""))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection by union of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def code_blocks(text: Column, most: int = 900) -> Column:
    """Trimmed bodies of fenced code that aren't empty or longer than most."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1)), strip)
    return F.filter(bodies, lambda b: (b != "") & (F.length(b) <= most))


def answer_key(text: Column) -> Column:
    """An answer for comparison: lower case, quotes, punctuation and spaces off its edges, spaces collapsed."""
    edges = r"""(?U)^[\s`"';,]+|[\s`"';,]+\z"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), edges, ""), r"(?U)\s+", " ")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / total
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def gap_parts(text: Column) -> tuple[Column, Column]:
    """Keys of {{blank_N}} markers in order, and the texts between them."""
    marker = r"\{\{(blank_\d+)\}\}"
    return F.regexp_extract_all(text, F.lit(marker), F.lit(1)), F.split(text, r"\{\{blank_\d+\}\}")


def json_of(text: Column) -> Column:
    """A variant from a reply: the text itself, what a fence holds, or from its first brace to its last; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    as_variant = lambda t: F.try_parse_json(F.when(t != "", t))
    return F.coalesce(as_variant(strip(text)), as_variant(strip(fenced)), as_variant(braces))


def env_map(text: Column) -> Column:
    """KEY=value lines as a map: comments and malformed lines out, ``export`` and quotes stripped, the last of a key wins."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*[ \t]*=[^\n]*)$"), F.lit(1))
    key = lambda x: F.regexp_extract(x, r"^(\w+)", 1)
    value = lambda x: F.regexp_replace(strip(F.regexp_extract(x, r"(?s)^\w+[ \t]*=(.*)", 1)), r"""^(["'])(.*)\1\z""", "$2")
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)
