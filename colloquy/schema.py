"""Canonical schemas. Absent optional values are null, never missing keys."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, VariantType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


TOOL = _struct(name=StringType(), input=StringType())
#: One row per turn. ``input`` of a tool is JSON text; src_pos is the place in the source, msg_idx that among kept turns.
MESSAGES = _struct(
    session_id=StringType(), src_pos=LongType(), role=StringType(), text=StringType(), ts_ms=LongType(), tools=ArrayType(TOOL), thinking_chars=LongType(),
)
QUESTION = _struct(
    question_id=StringType(), topic_id=StringType(), type=StringType(), prompt=StringType(), explanation=StringType(), source_turns=ArrayType(IntegerType()),
    options=ArrayType(_struct(key=StringType(), text=StringType())), correct_key=StringType(),
    blanks=ArrayType(_struct(key=StringType(), answer=StringType(), alternatives=ArrayType(StringType()))),
    rubric=ArrayType(_struct(criterion=StringType(), weight=DoubleType(), must_mention=ArrayType(StringType()))),
)
FLASHCARD = _struct(front=StringType(), back=StringType(), source_turns=ArrayType(IntegerType()), topic_id=StringType(), topic_label=StringType())
QUIZ = _struct(
    quiz_id=StringType(), session_id=StringType(), model=StringType(), created_at=LongType(), settings_key=StringType(), generator_version=StringType(),
    covered_messages=IntegerType(), fingerprint=StringType(), title=StringType(), topics=StringType(), flashcards=StringType(), questions=StringType(), redaction_report=StringType(),
)
ATTEMPT = _struct(
    attempt_id=StringType(), quiz_id=StringType(), started_at=LongType(), updated_at=LongType(), completed_at=LongType(), position=IntegerType(),
    answers=StringType(), results=StringType(), score=DoubleType(), max_score=DoubleType(),
)
COVERAGE = _struct(quiz_id=StringType(), topic_id=StringType(), label=StringType(), range_from=IntegerType(), range_to=IntegerType())
VARIANT, BOOLEAN = VariantType(), BooleanType()
