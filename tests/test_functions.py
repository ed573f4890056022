from pyspark.sql import functions as F

from colloquy.functions import paths, roles, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return frame.select(column).first()[0]


def test_titles_skip_fences_and_markup(spark):
    assert one(spark, text.title_of(F.col("t")), t="  \n# Fix  the   bug\nmore") == "Fix the bug"
    long = one(spark, text.title_of(F.col("t")), t="word " * 40)
    assert len(long) <= 72 and long.endswith("…")
    assert one(spark, text.title_of(F.col("t")), t=" \n ") is None


def test_labels_cut_at_words(spark):
    assert one(spark, text.label_of(F.col("t")), t="```x```") == "untitled topic"
    label = one(spark, text.label_of(F.col("t")), t="alpha beta " * 20)
    assert len(label) <= 91 and label.endswith("…") and not label[:-1].endswith(" ")
    assert one(spark, text.label_of(F.col("t"), 10), t="a" * 30) == "a" * 10 + "…"


def test_tokens_and_jaccard(spark):
    assert one(spark, text.tokens(F.col("t")), t="The parser, the PARSER and app/db.py -- ok_") == ["parser", "app", "db.py"]
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 1 / 3


def test_clips(spark):
    assert one(spark, text.clip(F.col("t"), 5), t="abcdefgh") == "abcde…"
    assert one(spark, text.clip(F.col("t"), 5, True), t="abcd efgh") == "abcd\n… (4 more chars)"
    middle = one(spark, text.clip_middle(F.col("t"), 200), t="h" * 500 + "t" * 500)
    assert len(middle) <= 200 and middle.startswith("h") and middle.endswith("t") and "chars omitted" in middle


def test_answers_entropy_env_json(spark):
    assert one(spark, text.answer_key(F.col("t")), t=" \"`Rows.Close()'; ") == "rows.close()"
    assert one(spark, text.answer_key(F.col("t")), t=None) == ""
    assert one(spark, text.entropy(F.col("t")), t="abab") == 1.0
    env = one(spark, text.env_map(F.col("t")), t="# c\nexport A='1'\nB = two \nA=3\nbad line\n")
    assert env == {"A": "3", "B": "two"}
    assert one(spark, F.to_json(text.json_of(F.col("t"))), t='so: ```json\n{"b":1,"a":2}\n``` there') == '{"a":2,"b":1}'
    assert one(spark, text.utf16_length(F.col("t")), t="a😀") == 3


def test_roles_and_times(spark):
    assert [one(spark, roles.normal_role(F.col("t")), t=r) for r in ("Human", "ai", "developer", "toolResult", "whoever", None)] == ["user", "assistant", "system", "tool", "assistant", "assistant"]
    ms = lambda x: one(spark, roles.epoch_ms(F.col("t")), t=x)
    assert ms("1700000000") == ms("1700000000000") == 1700000000000
    assert ms("2023-11-14T22:13:20.000Z") == 1700000000000 == ms("2023-11-14 22:13:20")
    assert ms("0") is None and ms("") is None and ms("soon") is None and ms(None) is None


def test_paths(spark):
    rel = lambda p, r, **k: one(spark, paths.relative_to_root(F.col("p"), F.col("r"), **k), p=p, r=r)
    assert rel("/w/app/db.py", "/w") == "app/db.py" and rel("./a/b.py", None) == "a/b.py"
    assert rel("/other/x", "/w") is None and rel("../x", "/w") is None and rel("\\\\host\\x", "/w") is None
    assert rel("C:\\W\\App\\x.py", "c:/w", any_case=True) == "App/x.py"
    assert one(spark, paths.project_of_encoded(F.col("p")), p="--home-me-tools-app--") == "me/tools/app"
    assert one(spark, paths.project_of_path(F.col("p")), p="/home/me/work/app") == "me/app"
