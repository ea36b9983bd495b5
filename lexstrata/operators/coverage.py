"""What a corpus covers: streams and their weights, countries, windows, stale streams, majorities, manifests and overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_catalogue(docs: DataFrame, stream: str = "stream") -> DataFrame:
    """``stream, n_docs, weight, first, last``; a stream's fixed weight is the root of its documents."""
    n = F.count(F.lit(1))
    return docs.groupBy(stream).agg(n.alias("n_docs"), F.sqrt(n).alias("weight"), F.min("date").alias("first"), F.max("date").alias("last"))


def by_key(docs: DataFrame, key: str, done: dict[str, DataFrame], doc: str = "doc_id") -> DataFrame:
    """Per key: documents, how many are in each of the ``done`` tables, first and last date."""
    rows = docs
    for name, table in done.items():
        rows = rows.join(table.select(doc).distinct().withColumn(f"__{name}", F.lit(1)), doc, "left")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("docs"), *(F.count(f"__{n}").alias(n) for n in done), F.min("date").alias("first"), F.max("date").alias("last"))


def stale_streams(docs: DataFrame, keys: Sequence[str], before: Column, least: int) -> DataFrame:
    """Streams of at least ``least`` documents whose last one is older than ``before``."""
    return docs.groupBy(*keys).agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("n")).filter((F.col("last") < before) & (F.col("n") >= least))


def window_coverage(docs: DataFrame, key: str, now: Column, prior: Column, stream: Column) -> DataFrame:
    """``key, now, prior, streams``: documents of a window and the one before it, and the window's distinct streams."""
    return docs.groupBy(key).agg(F.count_if(now).alias("now"), F.count_if(prior).alias("prior"), F.count_distinct(F.when(now, stream)).alias("streams"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key; ties go to the value that sorts first."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def manifest(totals: dict[str, DataFrame], coverage: DataFrame, versions: dict[str, str], settings: dict[str, str]) -> DataFrame:
    """A run's manifest as one row: ``versions, settings, totals`` (maps) and ``countries`` (the coverage rows by country)."""
    spark = coverage.sparkSession
    counts = {name: df.count() for name, df in totals.items()}
    as_map = lambda d, kind: F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).cast(kind).alias("value")) for k, v in sorted(d.items()))))
    rows = coverage.agg(F.array_sort(F.collect_list(F.struct(*coverage.columns))).alias("countries"))  # a row for each country
    return spark.range(1).select(as_map(versions, "string").alias("versions"), as_map(settings, "string").alias("settings"), as_map(counts, "bigint").alias("totals")).join(rows, F.lit(True))


def overview(manifest_row: DataFrame, alerts: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """A view's front page: the manifest with the last date of the alerts and how many of each shown tier there are."""
    n = alerts.filter(F.col("tier").isin(list(tiers))).agg(F.max("end").alias("data_last_date"), *(F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in tiers))
    return manifest_row.join(n, F.lit(True))


def topic_months(prevalence: DataFrame) -> DataFrame:
    """Topic prevalence as columns by country and topic: ``country, topic, months, n, balanced``, zero where a month has none."""
    months = prevalence.select("country", "period").distinct()
    grid = months.join(prevalence.select("country", "topic").distinct(), "country")
    full = grid.join(prevalence, ["country", "period", "topic"], "left").na.fill(0, ["n", "balanced"])
    rows = F.array_sort(F.collect_list(F.struct("period", "n", "balanced")))  # a row for each month
    return full.groupBy("country", "topic").agg(rows.alias("r")).select("country", "topic", F.col("r.period").alias("months"), F.col("r.n").alias("n"), F.col("r.balanced").alias("balanced"))
