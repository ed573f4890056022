"""The façade: scan, list, search, digest, quiz, grade, keep. A thin layer over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import normalize, quiz, redact, render, reports, splitting, store, topics
from .sources import discovery, listing, registry, scan
from .tables import Steps


class Conversations:
    """Sessions of a set of stores; frames are lazy and may be cached by the caller."""

    def __init__(self, spark: SparkSession, messages: DataFrame, files: DataFrame | None = None):
        self.spark, self.files = spark, files
        known = [F.first(c, ignorenulls=True).alias(c) for c in ("harness", "project", "title", "cwd") if c in messages.columns]
        ids = messages.groupBy("session_id")
        self.context = ids.agg(*known) if known else messages.select("session_id").distinct()
        self.turns = normalize.merged_turns(normalize.cleaned(messages.select("session_id", "src_pos", "role", "text", "ts_ms", "tools", "thinking_chars")))

    @classmethod
    def of_stores(cls, spark: SparkSession, platform: discovery.Platform, only: tuple[str, ...] = ()) -> Conversations:
        messages, files = scan.scan(spark, listing.discovered(spark, registry.rows(), platform, only)[0])
        return cls(spark, messages, files)

    @classmethod
    def of_table(cls, spark: SparkSession, conversations: DataFrame) -> Conversations:
        return cls(spark, normalize.from_conversations(conversations))

    def sessions(self) -> DataFrame:
        found = normalize.sessions(self.turns)
        if "title" not in self.context.columns:
            return found
        return found.withColumnRenamed("title", "_own").join(self.context, "session_id", "left").withColumn("title", F.coalesce("title", "_own")).drop("_own")

    def list(self, harness: str | None = None, ready_only: bool = False) -> DataFrame:
        return reports.session_list(self.sessions(), harness, ready_only)

    def search(self, query: str) -> DataFrame:
        found = self.sessions()
        return reports.search(found, query, tuple(c for c in ("title", "project", "harness") if c in found.columns))

    def topics(self, **options) -> DataFrame:
        return splitting.derive_topics(self.turns, **options)

    def digests(self, **options) -> DataFrame:
        return render.digests(self.turns, self.sessions(), **options)

    def payloads(self, **options) -> DataFrame:
        """Redacted quiz payloads, a row per turn."""
        return redact.redact_messages(render.payload(self.turns, **options))

    def touched(self) -> DataFrame:
        return render.touched(self.turns)

    def readiness(self, n_types: int = 0) -> DataFrame:
        return quiz.readiness(self.sessions(), self.topics(), n_types)

    def generate(self, generator: Callable[[str], str], questions: int = quiz.QUESTIONS, types: tuple[str, ...] = quiz.TYPES, seed: int = 0, focus: str = "") -> tuple[DataFrame, DataFrame]:
        """(questions, flashcards) by an injected generator from redacted slices of the planned topics."""
        found = Steps(self.spark, "topics").stored(self.topics())  # planned from and sliced by
        deck = quiz.plan(found, questions, types, seed)
        slices = render.topic_slices(self.turns, found).join(deck.select("session_id", "topic_id", "types"), ["session_id", "topic_id"])
        safe = redact.redact_messages(slices)
        prompt = F.concat(F.lit("Ask about this topic. Question types: "), F.array_join("types", ", "), F.lit(f". {focus}\n\n" if focus else ".\n\n"), "text")
        replies = quiz.generate(safe.withColumn("prompt", prompt), generator)
        return quiz.validated(replies.join(deck, ["session_id", "topic_id"]).select("session_id", "topic_id", "label", "msg_from", "msg_to", "types", "json"))

    def staleness(self, quizzes: DataFrame, settings_key: str) -> DataFrame:
        return store.staleness(self.turns, quizzes, settings_key)
