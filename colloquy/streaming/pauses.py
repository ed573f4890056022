"""Activity sessions on a stream of timed turns: a pause beyond the gap ends one, as pauses end topics in a batch.

An extension: the reference reads whole transcripts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(turns: DataFrame, key: str = "session_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, began, ended, turns per stretch of activity. Turns later than the watermark are dropped by Spark; on a batch
    frame the same plan gives all stretches."""
    stretch = F.session_window(ts, gap)
    out = turns.withWatermark(ts, late).groupBy(key, stretch.alias("w")).agg(F.count("*").alias("turns"), F.min(ts).alias("began"), F.max(ts).alias("ended"))
    return out.select(key, "began", "ended", "turns")
