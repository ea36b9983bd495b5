"""Ingestion: validation, date repair, exactly-once appends, sealing, corrections and set algebra on manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Required fields and vocabularies of a document.
REQUIRED = ("id", "country", "source", "lang", "date", "url", "text")
OUTLETS = ("official", "state_media", "media", "commentary")


def first_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first copy of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def reason(source_file: Column | None = None, country_dir: Column | None = None) -> Column:
    """Why a row is dropped (the first failing check), null if it is good. Columns: those of a document as strings."""
    c = F.col
    missing = F.filter(F.array(*(F.when(F.trim(F.coalesce(c(k), F.lit(""))) == "", k) for k in REQUIRED)), lambda x: x.isNotNull())
    day = F.try_to_date(c("date"), "yyyy-MM-dd")
    out = F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    out = out.when(~c("id").startswith(F.concat(c("source"), F.lit(":"))), "id_not_prefixed_by_source")
    if source_file is not None:
        out = out.when(c("source") != source_file, "source_differs_from_file")
    if country_dir is not None:
        out = out.when(F.upper(c("country")) != country_dir, "country_differs_from_dir")
    out = out.when(~F.coalesce(c("outlet"), F.lit("")).isin(*OUTLETS), "bad_outlet")
    out = out.when(~c("date").rlike("^\\d{4}-\\d{2}-\\d{2}$"), "date_not_iso").when(day.isNull(), "date_invalid").when(~F.year(day).between(1990, 2100), "date_implausible")
    out = out.when(~c("lang").rlike("^[a-z]{2,3}(-[A-Za-z0-9]+)?$"), "bad_lang").when(~c("url").rlike("^https?://"), "bad_url")
    return out.when((F.coalesce(c("fetched"), F.lit("")) != "") & F.try_to_timestamp(c("fetched")).isNull(), "bad_fetched")


def url_date(url: Column) -> Column:
    """A date in the URL: yyyy/mm/dd, yyyy-mm-dd or yyyymmdd; null if there is none or it is no day."""
    found = F.regexp_extract(url, "(?<!\\d)((?:19|20)\\d{2})([-/]?)(0[1-9]|1[0-2])\\2(0[1-9]|[12]\\d|3[01])(?!\\d)", 0)
    return F.try_to_date(F.regexp_replace(found, "[-/]", ""), "yyyyMMdd")


def guard_date(date: Column, url: Column, today: Column) -> Column:
    """A date later than two days from today is replaced by the URL's, else by that of the Buddhist year, else null."""
    limit = F.date_add(today, 2)
    buddhist = F.try_to_date(F.concat((F.year(date) - 543).cast("string"), F.date_format(date, "-MM-dd")), "yyyy-MM-dd")
    ok = lambda x: F.when(x <= limit, x)
    return F.coalesce(ok(date), ok(url_date(url)), F.when(F.year(date) - 543 >= 1990, ok(buddhist)))


def append_new(batch: DataFrame, existing: DataFrame, key: str = "id", order: Sequence[Column] = ()) -> DataFrame:
    """The rows of a batch that are new: first copy of an id, not among the existing ids (which never expire)."""
    return first_wins(batch, key, order or [F.lit(1)]).join(existing.select(key), key, "left_anti")


def replace_rows(batch: DataFrame, existing: DataFrame, key: str = "id", order: Sequence[Column] = ()) -> DataFrame:
    """Existing rows with those of the batch in their place: the last copy wins."""
    last = first_wins(batch, key, [*order] or [F.lit(1)])
    return existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def backfill(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Old rows, with nulls of ``columns`` filled from new copies."""
    extra = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns)).dropDuplicates([key])
    out = old.join(extra, key, "left")
    return out.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else c for c in old.columns))


def correct_dates(docs: DataFrame, fixes: DataFrame, key: str = "id") -> DataFrame:
    """Dates from a small table ``id, new_date``; a null one excludes the document."""
    f = fixes.select(F.col(key).alias("__id"), "new_date", F.lit(True).alias("__hit"))
    out = docs.join(F.broadcast(f), F.col(key) == F.col("__id"), "left").filter("__hit IS NULL OR new_date IS NOT NULL")
    return out.withColumn("date", F.coalesce("new_date", "date")).drop("__id", "__hit", "new_date")


def relabel(docs: DataFrame, verified: Sequence[str], channel: Column, forwarded: Column) -> DataFrame:
    """Posts that are forwarded or of a channel that is not verified lose their official label."""
    off = F.coalesce(forwarded, F.lit(False)) | ~F.coalesce(channel.isin(list(verified)), F.lit(False))
    return docs.withColumn("source", F.when(off, F.concat(F.col("source"), F.lit("_unofficial"))).otherwise(F.col("source"))).withColumn("outlet", F.when(off, "commentary").otherwise(F.col("outlet")))


def sync_status(corpus: DataFrame, mirror: DataFrame, key: str, place: str, label: str) -> DataFrame:
    """``key, status``: new, gone, moved, relabelled or same, by a full outer join."""
    a = corpus.select(key, F.col(place).alias("p1"), F.col(label).alias("l1"), F.lit(1).alias("in_a"))
    b = mirror.select(key, F.col(place).alias("p2"), F.col(label).alias("l2"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "gone").when(~F.col("p1").eqNullSafe(F.col("p2")), "moved").when(~F.col("l1").eqNullSafe(F.col("l2")), "relabelled").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def manifest_diff(local: DataFrame, remote: DataFrame, path: str = "path", digest: str = "sha") -> DataFrame:
    """``path, action``: add, change, copy (same content elsewhere), keep or missing (only remote)."""
    r = remote.select(path, F.col(digest).alias("r_sha"), F.lit(1).alias("r"))
    elsewhere = remote.select(F.col(digest).alias("sha2")).distinct().withColumn("e", F.lit(1))
    rows = local.select(path, digest, F.lit(1).alias("l")).join(r, path, "full_outer").join(elsewhere, F.col(digest) == F.col("sha2"), "left")
    action = F.when(F.col("l").isNull(), "missing").when(F.col("r").isNull() & F.col("e").isNotNull(), "copy").when(F.col("r").isNull(), "add").when(F.col(digest) != F.col("r_sha"), "change").otherwise("keep")
    return rows.select(path, action.alias("action"))


def complete(sealed: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Sealed ids that are not there: a table is complete if this is empty."""
    return sealed.select(key).join(seen.select(key), key, "left_anti")


def stale(rows: DataFrame, state: DataFrame, version: str, key: str = "doc_id", stage: str = "version") -> DataFrame:
    """Rows that a stage has to (re)do: not in its state, or of another version."""
    return rows.join(state.filter(F.col(stage) == version).select(key), key, "left_anti")


def seal(staged: DataFrame, path: str, manifest_path: str, month: str, key: str = "id") -> dict:
    """Write a staging table as an immutable part, verify it by count and digest of ids, then commit its manifest row.

    A part without a manifest row is not there for readers, so a crash leaves no half
    part; a re-run writes another part and commits that.
    """
    spark = staged.sparkSession
    import uuid

    part = f"{path.rstrip('/')}/{month}/{uuid.uuid4().hex}"
    mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("h")).first()
    staged.write.parquet(part)
    want, got = mark(staged), mark(spark.read.parquet(part))
    if want != got:
        raise RuntimeError("the part differs from the staged rows")
    row = spark.createDataFrame([(part, month, got["n"], str(got["h"]))], "path string, month string, n long, digest string")
    row.coalesce(1).write.mode("append").parquet(manifest_path)
    return row.first().asDict()


def sealed_docs(spark, manifest_path: str) -> DataFrame:
    """All committed parts, the first copy of an id by seal order."""
    paths = [r["path"] for r in spark.read.parquet(manifest_path).select("path").distinct().collect()]
    rows = spark.read.parquet(*sorted(paths)).withColumn("__f", F.input_file_name())
    return first_wins(rows, "id", [F.col("__f")]).drop("__f")
