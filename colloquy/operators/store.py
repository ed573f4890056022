"""The quiz store: Parquet tables, upserts by merge, staleness, progress.

A merge keeps what isn't in the new rows by an anti-join and adds the new ones, so it shuffles on the key once. A save writes
the buckets that it changes, and becomes visible as a new version, all at once.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import turn_text
from ..schema import ATTEMPT, COVERAGE, QUIZ
from ..tables import hadoop

GENERATOR_VERSION = "1"
TABLES = {"quiz": QUIZ, "attempt": ATTEMPT, "coverage": COVERAGE}
#: Columns that a conflicting upsert replaces; the others keep their first value.
REPLACED = ("model", "created_at", "topics", "flashcards", "questions", "redaction_report")


class StoreError(ValueError):
    pass


def fingerprints(turns: DataFrame, up_to: Column | None = None) -> DataFrame:
    """session_id -> fingerprint over the roles and texts of all turns, or of those before up_to, in order."""
    rows = turns if up_to is None else turns.where(F.col("msg_idx") < up_to)
    parts = F.array_sort(F.collect_list(F.struct("msg_idx", turn_text(F.col("role"), F.col("text")).alias("x"))))
    return rows.groupBy("session_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["x"]), ""), 256).alias("fingerprint"), F.count("*").alias("messages"))


def newest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), tie)
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def staleness(turns: DataFrame, quizzes: DataFrame, settings: str, version: str = GENERATOR_VERSION) -> DataFrame:
    """session_id, state, new_messages, quiz_id: the newest quiz of each session against its present turns.

    States are checked in the order generator_stale, diverged, extended, settings_changed, fresh; new without a quiz.
    """
    held = newest(quizzes, "session_id", "created_at", "quiz_id").select("session_id", "quiz_id", F.col("fingerprint").alias("then"), "covered_messages", "settings_key", "generator_version")
    part = turns.join(held.select("session_id", "covered_messages"), "session_id").withColumnRenamed("covered_messages", "_c")
    now = fingerprints(part, F.col("_c")).select("session_id", "fingerprint")
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("messages"))
    rows = sizes.join(held, "session_id", "left").join(now, "session_id", "left")
    # A quiz that covers nothing has the fingerprint of nothing.
    current = F.coalesce("fingerprint", F.sha2(F.lit(""), 256))
    state = (
        F.when(F.col("quiz_id").isNull(), "new").when(F.col("generator_version") != version, "generator_stale").when(current != F.col("then"), "diverged")
        .when(F.col("messages") > F.col("covered_messages"), "extended").when(F.col("settings_key") != settings, "settings_changed").otherwise("fresh")
    )
    fresh = F.when(state == "extended", F.col("messages") - F.col("covered_messages")).otherwise(0)
    return rows.select("session_id", "quiz_id", state.alias("state"), fresh.alias("new_messages"), F.col("covered_messages").alias("from_message"))


def upsert(old: DataFrame, new: DataFrame, key: str, replaced: tuple[str, ...]) -> DataFrame:
    """Rows of new whose key is known replace only these columns; others are added. new has one row per key."""
    picked = [F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in replaced else F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns if c != key]
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    return both.select(key, *picked)


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in new are new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def evolved(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that an older table lacks."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def progress(attempts: DataFrame) -> DataFrame:
    """What an attempt means: resumable with any answer, completed once finished, its percentage to one place."""
    answers = F.from_json("answers", "map<string, string>")
    return attempts.select(
        "quiz_id", "position", (F.coalesce(F.size(answers), F.lit(0)) > 0).alias("resumable"), F.col("completed_at").isNotNull().alias("completed"), F.coalesce(F.size(answers), F.lit(0)).alias("answered"),
        F.when(F.col("max_score") > 0, F.round(F.col("score") / F.col("max_score") * 100, 1)).otherwise(0.0).alias("percentage"), F.coalesce("updated_at", "started_at").alias("updated_at"),
    )


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """One attempt per quiz, the last touched; a missing touch counts as its start."""
    by = Window.partitionBy("quiz_id").orderBy(F.desc(F.coalesce("updated_at", "started_at")), F.desc("attempt_id"))
    return attempts.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def covered_messages(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("quiz_id").agg(F.greatest(F.max("range_to") + 1, F.lit(0)).alias("covered_messages"))


def quiz_list(quizzes: DataFrame, attempts: DataFrame, most: int = 100) -> DataFrame:
    """Newest first with progress; the limit is the list's length."""
    return quizzes.join(progress(latest_attempts(attempts)), "quiz_id", "left").orderBy(F.desc("created_at"), "quiz_id").limit(most)


def stats(quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    a = quizzes.agg(F.count("*").alias("quizzes"), F.count_distinct("session_id").alias("conversations"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    return a.withColumn("attempts", F.lit(attempts.count()))


class Conflict(StoreError):
    """Another writer has committed the version that this one would be."""


#: Guards the creation of manifests in a local folder, whose file system can't create a file only if it is new.
_local = threading.Lock()

#: A change of a table: the keys it touches (None: all), and the new rows of their buckets, made from the present ones.
Change = tuple[DataFrame | None, Callable[[DataFrame], DataFrame]]


class QuizStore:
    """Versioned tables below a path, for any number of writers.

    A version is a manifest (``log/<number>.json``) of the folders that hold each bucket of each table; buckets are by a hash
    of quiz_id. A writer reads the newest version, writes the buckets that it changes to new folders, and creates the next
    manifest, which succeeds for one writer only; the others plan their change again on the new version. What was
    written for a manifest that didn't come about is deleted, and readers never see it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, tries: int = 20):
        self.spark, self.path, self.buckets, self.tries = spark, path.rstrip("/"), buckets, tries
        self._fs, _ = hadoop(spark, self.path)

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _names(self, *names: str) -> list[str]:
        at = self._at(*names)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the newest version; 0 for an empty store."""
        return max((int(n.split(".")[0]) for n in self._names("log") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": self.buckets, "tables": {name: {} for name in TABLES}}
        stream = self._fs.open(self._at("log", f"{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version), name)

    def _rows(self, manifest: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for bucket, folder in sorted(manifest["tables"][name].items()) if buckets is None or int(bucket) in buckets]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        held = self.spark.read.option("mergeSchema", "true").parquet(*folders)
        return evolved(held, {f.name: F.lit(None).cast(f.dataType) for f in TABLES[name]}).select(TABLES[name].names)

    def commit(self, plan: Callable[[Callable[[str], DataFrame]], dict[str, Change]]) -> int:
        """Makes a change part of the store and returns its version. plan gets the tables of the version that it changes, and
        is asked again after a conflict."""
        for _ in range(self.tries):
            version = self.version()
            now = self.manifest(version)
            token = uuid.uuid4().hex
            try:
                tables = {name: dict(held) for name, held in now["tables"].items()}
                for name, (keys, merged) in plan(lambda name, m=now: self._rows(m, name)).items():
                    touched = self._touched(keys, now["buckets"])
                    rows = merged(self._rows(now, name, touched))
                    written = self._write(name, rows, token, now["buckets"])
                    tables[name] = {b: f for b, f in tables[name].items() if touched is not None and int(b) not in touched} | written
                self._publish(version + 1, now | {"tables": tables})
                return version + 1
            except Conflict:
                self._discard(token)
            except BaseException:
                self._discard(token)
                raise
        raise StoreError(f"no version could be committed in {self.tries} tries")

    def _touched(self, keys: DataFrame | None, buckets: int) -> set[int] | None:
        if keys is None:
            return None
        return {r[0] for r in keys.select(F.pmod(F.xxhash64("quiz_id"), F.lit(buckets)).cast("int")).distinct().collect()}

    def _write(self, name: str, rows: DataFrame, token: str, buckets: int) -> dict[str, str]:
        folder = f"data/{name}/{token}"
        typed = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        typed.withColumn("_bucket", F.pmod(F.xxhash64("quiz_id"), F.lit(buckets)).cast("int")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def _publish(self, version: int, manifest: dict) -> None:
        at = self._at("log", f"{version:020d}.json")
        with _local if self._fs.getScheme() == "file" else contextlib.nullcontext():
            try:
                stream = self._fs.create(at, False)
            except Py4JJavaError as error:
                if self._fs.exists(at):
                    raise Conflict(f"version {version} exists") from error
                raise
            stream.write(json.dumps(manifest).encode())
            stream.close()

    def _discard(self, token: str) -> None:
        for name in TABLES:
            self._fs.delete(self._at("data", name, token), True)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what no one of the last versions holds; how many folders went. Not while a writer is at work."""
        newest = self.version()
        held = {f.split("/")[2] for v in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(v)["tables"].values() for f in t.values()}
        gone = [(name, token) for name in TABLES for token in self._names("data", name) if token not in held]
        for name, token in gone:
            self._fs.delete(self._at("data", name, token), True)
        for v in range(1, newest - keep + 1):
            self._fs.delete(self._at("log", f"{v:020d}.json"), False)
        return len(gone)

    def save(self, quizzes: DataFrame, coverage: DataFrame, keep_progress: bool = False) -> None:
        """Upserts quizzes, replaces their coverage and, unless kept, clears the progress of those that existed, all in one version."""
        if not quizzes.where("coalesce(questions, '[]') = '[]' and coalesce(flashcards, '[]') = '[]'").isEmpty():
            raise StoreError("an empty quiz isn't saved")
        changes: dict[str, Change] = {
            "quiz": (quizzes, lambda old: upsert(old, quizzes, "quiz_id", REPLACED)),
            "coverage": (coverage, lambda old: replace_group(old, coverage, "quiz_id")),
        }
        if not keep_progress:
            changes["attempt"] = (quizzes, lambda old: _cleared(old, quizzes))
        self.commit(lambda _: changes)

    def _known(self, rows: DataFrame, quizzes: DataFrame) -> None:
        missing = rows.join(quizzes, "quiz_id", "left_anti").select("quiz_id").first()
        if missing:
            raise StoreError(f"no quiz {missing[0]}")

    def save_progress(self, rows: DataFrame) -> None:
        """rows: attempt columns, one per quiz. A known attempt keeps its id, start and score."""
        self._progress(rows.select(ATTEMPT.names), ("position", "answers", "results", "updated_at"))

    def finish(self, rows: DataFrame) -> None:
        """Keeps the score and resets the position: coming back begins afresh."""
        self._progress(_reset(rows.select(ATTEMPT.names)), ("position", "answers", "results", "score", "max_score", "completed_at", "updated_at"))

    def _progress(self, rows: DataFrame, replaced: tuple[str, ...]) -> None:
        def plan(table: Callable[[str], DataFrame]) -> dict[str, Change]:
            self._known(rows, table("quiz"))
            return {"attempt": (rows, lambda old: upsert(latest_attempts(old), rows, "quiz_id", replaced).select(ATTEMPT.names))}

        self.commit(plan)

    def clear_progress(self, quizzes: DataFrame) -> None:
        self.commit(lambda _: {"attempt": (quizzes, lambda old: _cleared(old, quizzes))})

    def delete(self, quizzes: DataFrame) -> None:
        """Quizzes with their attempts and coverage."""
        self.commit(lambda _: {name: (quizzes, lambda old: delete_keys(old, quizzes, "quiz_id")) for name in ("attempt", "coverage", "quiz")})

    def clear(self) -> int:
        """Empties the store; how many quizzes there were."""
        n = self.table("quiz").count()
        self.commit(lambda _: {name: (None, lambda old: old.limit(0)) for name in TABLES})
        return n


def _reset(attempts: DataFrame) -> DataFrame:
    return attempts.withColumns({"position": F.lit(0), "answers": F.lit("{}"), "results": F.lit(None).cast("string")})


def _cleared(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    mine = attempts.join(quizzes.select("quiz_id").distinct(), "quiz_id", "left_semi")
    return replace_group(attempts, _reset(mine), "quiz_id")
