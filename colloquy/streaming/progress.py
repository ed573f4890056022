"""Progress of streams and of a session's stages as a table that other sessions can read while work goes on.

Rows are JSON files in a folder of the shared store, one per event, named by time and number, so readers see whole rows only
(a file is written under another name first). They hold counts, never data.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..tables import hadoop

SCHEMA = "source string, id string, name string, event string, batch long, done long, total long, rows long, rows_so_far long, at_ms long"


class ProgressTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.n = spark, folder.rstrip("/"), 0
        self._fs, at = hadoop(spark, self.folder)
        self._fs.mkdirs(at)

    def add(self, **row) -> None:
        self.n += 1
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        row["at_ms"] = int(time.time() * 1000)
        name = f"{row['at_ms']:015d}-{self.n:06d}-{uuid.uuid4().hex[:8]}.json"
        stream = self._fs.create(path(f"{self.folder}/_{name}"), False)
        stream.write((json.dumps(row) + "\n").encode())
        stream.close()
        self._fs.rename(path(f"{self.folder}/_{name}"), path(f"{self.folder}/{name}"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.folder)

    def stages(self) -> None:
        """A row for each active stage: tasks done, of how many. Call it from a thread of one's own while a job runs."""
        tracker = self.spark.sparkContext.statusTracker()
        for number in tracker.getActiveStageIds():
            info = tracker.getStageInfo(number)
            if info:
                self.add(source="stage", id=str(info.stageId), name=info.name, event="progress", done=info.numCompletedTasks, total=info.numTasks)

    def listener(self) -> StreamingQueryListener:
        """A listener that adds a row for each batch of the session's streams, and for their beginning and end."""
        return _Listener(self)


class _Listener(StreamingQueryListener):
    def __init__(self, table: ProgressTable):
        self.table, self.rows = table, {}

    def onQueryStarted(self, event) -> None:
        self.table.add(source="stream", id=str(event.id), name=event.name, event="started", rows_so_far=0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.id)
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        self.table.add(source="stream", id=key, name=p.name, event="progress", batch=p.batchId, rows=p.numInputRows, rows_so_far=self.rows[key])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.table.add(source="stream", id=str(event.id), event="failed" if event.exception else "ended", rows_so_far=self.rows.get(str(event.id), 0))
