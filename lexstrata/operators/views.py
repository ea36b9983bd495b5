"""Views over series and alerts: bands, heatmaps, evidence, ranking, briefs, and series for papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tone_bands(series: DataFrame, group: Sequence[str]) -> DataFrame:
    """Group mean by weights and its standard error: sqrt(sum (w se)^2) / sum w; ``delta_se`` from delta / z where \\|z\\| >= 0.5, else the stream's upper median of those."""
    ratio = F.when(F.abs("z") >= 0.5, F.abs(F.col("delta") / F.col("z")))
    per = series.withColumn("__r", ratio)
    rank = F.row_number().over(Window.partitionBy("stream").orderBy(F.col("__r").asc_nulls_last()))
    n = F.count("__r").over(Window.partitionBy("stream"))
    mid = F.max(F.when(F.col("__k") == F.floor(F.col("__n") / 2) + 1, F.col("__r"))).over(Window.partitionBy("stream"))
    per = per.withColumn("__k", rank).withColumn("__n", n).withColumn("__d", F.coalesce("__r", mid))
    w = F.when(F.col("delta").isNotNull(), F.col("w"))
    return per.groupBy(*group).agg(
        (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("mean"), (F.sqrt(F.sum(F.pow(F.col("w") * F.col("se"), 2))) / F.sum("w")).alias("se"),
        (F.sqrt(F.sum(F.pow(w * F.col("__d"), 2))) / F.sum(w)).alias("delta_se"), F.sum("n").alias("n"),
    )


def heatmap(series: DataFrame, keys: Sequence[str], min_n: int = 5) -> DataFrame:
    """Cells of ``keys`` in two scopes, all outlets and official ones, from one pass."""
    scopes = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("outlet") == "official", F.lit("official")))))
    rows = series.withColumn("scope", scopes).groupBy("scope", *keys).agg(F.sum("n").alias("n"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("value"))
    return rows.filter(F.col("n") >= min_n)


def best_sentences(sents: DataFrame, score: str, k: int, key: str = "doc_id") -> DataFrame:
    """The best sentence of each document, the ``k`` best of those; ties by document and index."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "idx")
    return sents.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").orderBy(F.desc(score), key).limit(k)


def evidence(alerts: DataFrame, sents: DataFrame, on: Sequence[str], score: str, k: int = 5) -> DataFrame:
    """Each alert with an array of its best sentences, one of a document; text only of official outlets."""
    pairs = alerts.select("alert_id", *on).join(sents, list(on))
    one = pairs.withColumn("__d", F.row_number().over(Window.partitionBy("alert_id", "doc_id").orderBy(F.desc(score), "idx"))).filter("__d = 1")
    top = one.withColumn("__r", F.row_number().over(Window.partitionBy("alert_id").orderBy(F.desc(score), "doc_id"))).filter(F.col("__r") <= k)
    text = F.when(F.col("outlet") == "official", F.substring("sent", 1, 300))
    lists = top.groupBy("alert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "doc_id", "idx", F.round(score, 3).alias("score"), text.alias("text")))), lambda x: x.dropFields("__r")).alias("evidence"))
    return alerts.join(lists, "alert_id", "left")


def ranked_alerts(alerts: DataFrame, recent_from: Column) -> DataFrame:
    """Alerts in order (recent ones first, then by \\|z\\| log10(n + 10)) with their place as ``alert_id``."""
    score = F.abs("z") * F.log10(F.col("n") + 10)
    recent = (F.col("end") >= recent_from).cast("int")
    order = Window.orderBy(F.desc("recent"), F.desc(F.round("score", 9)), "stream", "start")
    return alerts.withColumn("score", score).withColumn("recent", recent).withColumn("alert_id", F.row_number().over(order))


def brief_selection(alerts: DataFrame, top_country: int = 3, top_stream: int = 4) -> DataFrame:
    """Recent alerts that are not weak: strong before moderate, then by score; so many of each level."""
    rank = F.when(F.col("tier") == "strong", 0).when(F.col("tier") == "moderate", 1).otherwise(2)
    rows = alerts.filter((F.col("recent") == 1) & (F.col("tier") != "weak"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy(rank, F.desc("score"), "alert_id")))
    return rows.filter(F.col("place") <= F.when(F.col("level") == "country", top_country).otherwise(top_stream))


def public_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("tier").isin("strong", "moderate"))


def quiet(covered: DataFrame, alerts: DataFrame, key: str = "country") -> DataFrame:
    """Covered groups without an alert."""
    return covered.select(key).distinct().join(alerts.select(key), key, "left_anti")


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of a small result (at most ``most`` rows, else an error) as Markdown."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"## {title}", "", *head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])


def pooled(rows: DataFrame, by: Sequence[str], source: str, metrics: Sequence[str], weight: str, skip: Column | None = None) -> DataFrame:
    """Rows of each source, and pooled rows (source ``pooled``) without those of ``skip``: means by documents and by sentences."""
    every = rows.withColumn("__w", F.explode(F.array_compact(F.array(F.col(source), F.when(~F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(True), F.lit("pooled"))))))
    aggs = [F.count(F.lit(1)).alias("docs"), F.sum(weight).alias("sents")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_by_doc"), (F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(f"{m}_by_sent")]
    return every.groupBy(F.col("__w").alias(source), *by).agg(*aggs)


def daily_table(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per date: documents, sum of tone, and for each target the documents and the sum of its stance."""
    aggs = [F.count_distinct("doc_id").alias("n"), F.sum(F.when(F.col("target").isNull(), F.col("tone"))).alias("tone")]
    for t in targets:
        own = F.col("target") == t
        aggs += [F.count_if(own).alias(f"{t}_k"), F.sum(F.when(own, F.col("stance"))).alias(f"{t}_sum")]
    return rows.groupBy("date").agg(*aggs)


def signal_cells(rows: DataFrame, keys: Sequence[str], value: str, high: float = 0.5) -> DataFrame:
    """Cells of classified sentences: documents and sentences by class, scored ones, high ones, mean and population deviation."""
    return rows.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("class") == "W", F.col("doc_id"))).alias("docs_w"), F.count_if(F.col("class") == "W").alias("sent_w"), F.count_if(F.col("class") == "A").alias("sent_a"),
        F.count(value).alias("scored"), F.count_if(F.col(value) >= high).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
    )
