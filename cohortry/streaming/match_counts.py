"""An extension beyond batch: counts by match, team and window over a directory of event rows as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], kind: str, window: str = "10 minutes", late: str = "30 minutes", id_column: str = "event_id") -> DataFrame:
    """Per window and key: events and shots, repeats of an event within the watermark counted once."""
    fresh = events.withWatermark(time, late).dropDuplicatesWithinWatermark([id_column])
    return fresh.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n_events"), F.count_if(F.col(kind) == "Shot").alias("n_shots")).select("w.start", "w.end", *keys, "n_events", "n_shots")
