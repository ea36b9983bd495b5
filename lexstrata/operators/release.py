"""Dataset releases and public views: policies, accounting, summaries, guarded exports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.sources.shared import small


def metadata_only(source: Column, forwarded: Column, sources: Sequence[str]) -> Column:
    """Whether only metadata may be released."""
    return source.isin(list(sources)) | F.coalesce(forwarded, F.lit(False))


def public_text(outlet: Column, text: Column, limit: int = 300) -> Column:
    """Only official text may be published, up to ``limit`` characters."""
    return F.when(outlet == "official", F.substring(text, 1, limit))


def violations(evidence: DataFrame, limit: int = 300) -> DataFrame:
    """Rows that break the text policy; an export goes on only if there is none."""
    return evidence.filter((F.col("text").isNotNull()) & ((F.coalesce("outlet", F.lit("")) != "official") | (F.length("text") > limit)))


def assert_public_safe(evidence: DataFrame, limit: int = 300) -> None:
    if violations(evidence, limit).limit(1).count():
        raise ValueError("text that may not be published")


def snapshot_status(fetched: Column, date: Column, cutoff: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Null for rows in the snapshot; else the drop (a date after it) or the exclusion (fetched after it, out of range)."""
    out = F.when(date > F.date_add(F.to_date(cutoff), 1), "drop:date_after_snapshot").when(fetched > cutoff, "exclude:fetched_after_snapshot")
    if start is not None:
        out = out.when(date < start, "exclude:before_range")
    if end is not None:
        out = out.when(date > end, "exclude:after_range")
    return out


def accounting(rows: DataFrame, reason: str = "reason", key: str = "id", examples: int = 10) -> DataFrame:
    """``reason, n, examples``: how many rows and the first ids of each reason.

    Only candidates for the examples are gathered: the ids are cut to the first ones
    in each task's and key's share before they meet.
    """
    from pyspark.sql import Window

    bad = rows.filter(F.col(reason).isNotNull())
    w = Window.partitionBy(reason).orderBy(key)
    first = bad.select(reason, key).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= examples)
    few = first.groupBy(reason).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return bad.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).join(few, reason)


def coverage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents, first and last date and characters by keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("n_chars").alias("chars"))


def top_values(rows: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    """``group, top``: the commonest ``k`` values, ``+N more`` at the end."""
    from pyspark.sql import Window

    n = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(group)))
    few = n.filter(F.col("r") <= k).groupBy(group).agg(F.max("all").alias("all"), F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"].cast("string")).alias("v"))
    more = F.when(F.col("all") > k, F.concat(F.lit(" +"), (F.col("all") - k).cast("string"), F.lit(" more"))).otherwise("")
    return few.select(group, F.concat(F.array_join("v", ", "), more).alias("top"))


def changes(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """``key, old, new, delta`` where a count differs between two manifests."""
    a, b = now.select(key, F.col(value).alias("new")), before.select(key, F.col(value).alias("old"))
    out = a.join(b, key, "full_outer").select(key, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    return out.filter("old <> new").withColumn("delta", F.col("new") - F.col("old"))


def reprints(docs: DataFrame, least: int = 40) -> DataFrame:
    """Official texts that other outlets reprint word for word: ``official, other``, joined on a hash and compared in full."""
    h = docs.filter(F.length("text") >= least).select("doc_id", "outlet", "text", F.sha1(F.col("text").cast("binary")).alias("h"))
    a = h.filter("outlet = 'official'").select(F.col("doc_id").alias("official"), "h", F.col("text").alias("t1"))
    b = h.filter("outlet <> 'official'").select(F.col("doc_id").alias("other"), "h", F.col("text").alias("t2"))
    return a.join(b, "h").filter("t1 = t2").select("official", "other")


def write_release(df: DataFrame, path: str, keys: Sequence[str] = ("date", "source", "id")) -> None:
    """Zstd Parquet, range-partitioned and sorted by the keys; an existing release is never overwritten."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Gzipped JSON lines in a fixed order within each file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "gzip").json(path)


def semantic_rows(meta: DataFrame, tone: DataFrame, topic: DataFrame, mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Released documents with what is known of them: tone and topic (either may be missing) and sorted targets.

    ``meta`` has a row per released document; others are left out, as are documents
    without tone and topic. Own targets (``self``) don't count.
    """
    known = tone.join(topic, key, "full_outer")
    targets = mentions.filter(~F.col("self")).groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("targets"))  # as many as there are targets
    return meta.join(known, key).join(targets, key, "left")


def shrunk(local: DataFrame, remote: DataFrame, append_only: Sequence[str], deletable: Sequence[str] = ()) -> DataFrame:
    """``path, action`` for a manifest (``path, sha, bytes``): append-only files that became smaller are refused, missing ones are deleted only under ``deletable`` prefixes."""
    under = lambda prefixes: F.lit(False) if not prefixes else F.col("path").rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")
    both = local.select("path", F.col("sha").alias("s1"), F.col("bytes").alias("b1")).join(remote.select("path", F.col("sha").alias("s2"), F.col("bytes").alias("b2")), "path", "full_outer")
    action = F.when(F.col("s1").isNull(), F.when(under(deletable), "delete").otherwise("keep")).when(F.col("s2").isNull(), "add").when(F.col("s1") == F.col("s2"), "same")
    return both.select("path", action.when(under(append_only) & (F.col("b1") < F.col("b2")), "refuse").otherwise("change").alias("action"))


def line_deltas(before: DataFrame, after: DataFrame, key: str = "file", lines: str = "lines") -> DataFrame:
    """``file, before, after, delta`` of a collection run; files without a change are left out."""
    both = before.select(key, F.col(lines).alias("before")).join(after.select(key, F.col(lines).alias("after")), key, "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before")).filter("delta <> 0")


def log_counts(lines: DataFrame, patterns: dict[str, str], column: str = "value") -> DataFrame:
    """``pattern, n``: log lines that match each named pattern, in one pass."""
    found = F.explode(F.array_compact(F.array(*(F.when(F.col(column).rlike(rx), F.lit(name)) for name, rx in patterns.items()))))
    have = lines.select(found.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    names = lines.sparkSession.createDataFrame([(n,) for n in patterns], "pattern string")
    return names.join(have, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def leaks(rows: DataFrame, official: DataFrame, allowed: Sequence[str], text: str = "text") -> DataFrame:
    """``id, leak``: published texts of non-official outlets, texts that differ from the stored official one (by SHA-1), and fields that are not allowed.

    A text that an official source published first and media reprint word for word is reported as ``reprint``, which is no leak.
    """
    extra = [c for c in rows.columns if c not in allowed and c not in ("id", "outlet", text)]
    own = rows.join(official.select("id", F.sha1(F.col("text").cast("binary")).alias("__stored")), "id", "left")
    known = small(official.select(F.sha1(F.col("text").cast("binary")).alias("__sha")).distinct().withColumn("__known", F.lit(True)))
    own = own.withColumn("__sha", F.sha1(F.col(text).cast("binary"))).join(known, "__sha", "left")
    field = F.lit(None).cast("string")
    for c in reversed(extra):
        field = F.when(F.col(c).isNotNull(), F.lit(f"field:{c}")).otherwise(field)
    said = F.col(text).isNotNull()
    leak = F.when(said & (F.col("outlet") == "official") & ~F.col("__sha").eqNullSafe(F.col("__stored")), "text_differs").when(said & ~F.col("outlet").eqNullSafe(F.lit("official")) & F.col("__known"), "reprint").when(said & ~F.col("outlet").eqNullSafe(F.lit("official")), "media_text").otherwise(field)
    return own.select("id", leak.alias("leak")).filter("leak IS NOT NULL")
