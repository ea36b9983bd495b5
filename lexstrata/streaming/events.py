"""Structured Streaming over event and document files: windows with late data, exactly-once appends, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream (files are immutable; each batch lands as a new one)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def drop_future(rows: DataFrame, ts: str = "ts", limit: str = "2 days") -> DataFrame:
    """Early data: stamps later than ``limit`` from now go."""
    return rows.filter(F.col(ts) <= F.current_timestamp() + F.expr(f"INTERVAL {limit}"))


def tumbling(rows: DataFrame, keys: list[str], value: str, width: str = "7 days", start: str = "4 days", ts: str = "ts", late: str | None = "3 days") -> DataFrame:
    """Counts and sums by tumbling windows; weeks that start on Monday by default. ``late`` is the watermark (None in batch)."""
    rows = rows.withWatermark(ts, late) if late else rows
    w = F.window(ts, width, width, start)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sliding(rows: DataFrame, keys: list[str], value: str, width: str, step: str, ts: str = "ts", late: str | None = "3 days") -> DataFrame:
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, key: str, gap: str = "1 hour", ts: str = "ts", late: str | None = "3 days") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_once(stream: DataFrame, table_path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append each id once, ever: a batch is reduced to its new ids against the table, as ids never expire."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.parquet(table_path).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        # a batch that runs again finds its rows in the table and adds none
        rows.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
