"""Transcripts: speaker turns, question-answer pairs, aligned versions and pulse summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_lines(text: Column, askers: str, spokes: str, noise: str = "^$") -> Column:
    """``array<struct<line, kind, label, rest>>``: kind is q, a, noise or null (goes on with the line before)."""

    def one(line: Column, i: Column) -> Column:
        label = F.regexp_extract(line, "^\\s*([^:：]{1,40})[:：]", 1)
        rest = F.regexp_replace(line, "^\\s*[^:：]{1,40}[:：]\\s*", "")
        kind = F.when(F.trim(line).rlike(noise), "noise").when(label.rlike(askers), "q").when(label.rlike(spokes), "a")
        return F.struct(i.alias("line"), kind.alias("kind"), F.when(kind.isin("q", "a"), label).alias("label"), F.when(kind.isin("q", "a"), rest).otherwise(line).alias("rest"))

    return F.transform(F.split(text, "\n"), one)


def fill_turns(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Unlabelled lines take the kind and label of the line before; noise is dropped. Adds ``pair``: how many questions began so far (a question after an answer, or after another asker's)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = lines.filter("kind IS NULL OR kind <> 'noise'").withColumn("__k", F.last("kind", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("label", F.last("label", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("__k").over(w)
    begins = (F.col("__k") == "q") & (F.coalesce(before, F.lit("")) != "q") | ((F.col("kind") == "q") & (before == "q") & (F.lag("label").over(w) != F.col("label")))
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    return rows.withColumn("pair", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__k IS NOT NULL").withColumn("kind", F.col("__k")).drop("__k", "begins")


def qa_pairs(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, pair, question, answer``, texts of each side joined by lines; pairs before the first question have none."""
    side = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct(order, text)))), lambda x: x[text]), "\n")
    return turns.groupBy(key, "pair").agg(side("q").alias("question"), side("a").alias("answer"), F.count_if(F.col("kind") == "q").alias("n_q"), F.count_if(F.col("kind") == "a").alias("n_a"))


def line_ranges(lines: DataFrame, key: str, order: str, n: str) -> DataFrame:
    """Sentence index range ``i0, i1`` (end exclusive) of each line from its number of sentences."""
    w = Window.partitionBy(key).orderBy(order)
    return lines.withColumn("i1", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i0", F.col("i1") - F.col(n))


def pair_scores(pairs: DataFrame, scores: DataFrame, key: str, dims: Sequence[str], idx: str = "idx") -> DataFrame:
    """``key, pair``, mean scores of the sentences whose numbers a pair lists, and how many of them are scored."""
    long = pairs.select(key, "pair", F.explode(idx).alias("idx")).distinct()
    return long.join(scores, [key, "idx"], "left").groupBy(key, "pair").agg(*(F.avg(d).alias(d) for d in dims), F.count(dims[0]).alias("n"))


def aligned(a: DataFrame, b: DataFrame, key: str, seq: str) -> DataFrame:
    """Pairs of two versions by position, only where a key has as many in both."""
    n = lambda d, c: d.groupBy(key).agg(F.count(F.lit(1)).alias(c))
    same = n(a, "n1").join(n(b, "n2"), key).filter("n1 = n2").select(key)
    return a.join(same, key, "left_semi").join(b, [key, seq])


def long_summary(rows: DataFrame, keys: Sequence[str], metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``keys, metric, key, value``: counts of rows that meet each condition, over all and by the values of ``by``, in one pass."""
    sets = [F.struct(F.lit("").alias("key"))] + [F.struct(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("?"))).alias("key")) for c in by]
    long = rows.withColumn("__k", F.explode(F.array(*sets))).groupBy(*keys, F.col("__k.key").alias("key")).agg(*(F.count_if(c).cast("double").alias(m) for m, c in metrics.items()))
    return long.unpivot([*keys, "key"], list(metrics), "metric", "value")


def month_over_month(summary: DataFrame, keys: Sequence[str], month: str = "month") -> DataFrame:
    """Adds ``previous`` and ``delta``: the value one calendar month before."""
    before = summary.select(*keys, F.add_months(month, 1).alias(month), F.col("value").alias("previous"))
    return summary.join(before, [*keys, month], "left").withColumn("delta", F.col("value") - F.col("previous"))


def top_quotes(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, cut: int, k: int) -> DataFrame:
    """The first ``k`` rows of each key, no two with the same first ``cut`` characters."""
    rows = rows.withColumn("__d", F.row_number().over(Window.partitionBy(*keys, F.substring(text, 1, cut)).orderBy(*order))).filter("__d = 1").drop("__d")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def capped_quotes(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, group: str, free: str, per_group: int = 2, k: int = 4, cut: int = 80) -> DataFrame:
    """As ``top_quotes``, with at most ``per_group`` of a ``group`` other than ``free``; duplicates don't use the cap up."""
    rows = rows.withColumn("__d", F.row_number().over(Window.partitionBy(*keys, F.substring(text, 1, cut)).orderBy(*order))).filter("__d = 1").drop("__d")
    rows = rows.withColumn("__g", F.row_number().over(Window.partitionBy(*keys, group).orderBy(*order))).filter((F.col(group) == free) | (F.col("__g") <= per_group)).drop("__g")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)
