"""Event windows: grids of days around events, baselines, overlaps and day cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_grid(events: DataFrame, streams: DataFrame, days: DataFrame, before: int = 7, after: int = 14) -> DataFrame:
    """``event_id, event_date, stream, offset, date`` and the day's cells: every event, stream and offset, empty days as 0.

    Events (bounded by the caller) are exploded over offsets first; streams meet them by a broadcast.
    """
    grid = events.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("date", F.date_add("event_date", F.col("offset")))
    return grid.crossJoin(F.broadcast(streams)).join(days, ["stream", "date"], "left").fillna(0)


def baseline(events: DataFrame, days: DataFrame, value: str, weight: str, lo: int = -37, hi: int = -8) -> DataFrame:
    """Per event and stream, over offsets ``lo`` to ``hi``: the weighted mean of ``value``, and ``weight`` per day with empty days in the denominator."""
    span = events.withColumn("date", F.explode(F.sequence(F.date_add("event_date", lo), F.date_add("event_date", hi))))
    rows = span.join(days, "date")
    return rows.groupBy("event_id", "stream").agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("base_mean"), (F.sum(weight) / (hi - lo + 1)).alias("per_day"))


def overlaps(events: DataFrame, before: int = 7, after: int = 14) -> DataFrame:
    """Adds ``overlap``: whether another event's window covers the event's date. A range semi-join by exploding windows to days."""
    cover = events.select(F.col("event_id").alias("other"), F.explode(F.sequence(F.date_add("event_date", -before), F.date_add("event_date", after))).alias("event_date"))
    hit = events.join(cover, "event_date").filter("event_id <> other").select("event_id").distinct().withColumn("overlap", F.lit(True))
    return events.join(hit, "event_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))


def day_cells(rows: DataFrame, url: str, sent: str) -> DataFrame:
    """Per stream and date: distinct urls and distinct sentences."""
    return rows.groupBy("stream", "date").agg(F.count_distinct(url).alias("urls"), F.count_distinct(sent).alias("sents"))
