"""Line dedup by site-relative frequency.

A line is boilerplate of a host if the share of the host's pages that contain it
exceeds ``max_ratio``. Rows of a host with equal texts are one page: otherwise a
document copied often enough would lose every line in all its copies, before a
later stage could keep one of them. So the ratio can be low. Copies are combined
map-side before the shuffle; pages are then counted in the same pass as lines (as a
null line of every page), and the counts are written once.

``min_pages`` is evidence, not size: on a host of a few pages, two near copies of
one page would pass any ratio and lose all that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import BROADCAST_ROWS, free_names, salt_of, written

#: Share of a host's pages beyond which a line is boilerplate.
MAX_RATIO = 0.01
#: Pages of a host that must share a line at least.
MIN_PAGES = 5
#: Bytes of lines that a broadcast list may have.
BROADCAST_BYTES = 64 << 20
#: Space, tab and carriage return at a line's ends are not part of the line.
BLANKS = " \t\r"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; empty without ``://``."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def _line(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def boilerplate_lines(df: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``h, line, pages, total``: the lines of each host that exceed the ratio.

    At most (mean distinct lines of a page) / ``max_ratio`` lines of a host can.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col("text"), "\n", -1), _line), lambda x: x != ""))
    none = F.array().cast("array<string>")
    marks = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(lines, none))
    pages = df.select(F.coalesce(host, F.lit("")).alias("h"), F.col(text_col).alias("text")).distinct()
    counts = pages.select("h", F.explode(marks).alias("line")).groupBy("h", "line").agg(F.count(F.lit(1)).alias("pages"))
    counts = written(counts.filter((F.col("pages") >= min_pages) | F.col("line").isNull()), "line-counts")
    # a host's lines are few after the filter: at least min_pages pages share each
    totals = counts.filter("line is null").select("h", F.col("pages").alias("total"))
    return counts.filter("line is not null").join(totals, "h").filter(F.col("pages") > F.col("total") * F.lit(max_ratio))


def line_dedup(
    df: DataFrame,
    host: Column | None = None,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    report: str | None = "line_report",
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = 16,
) -> DataFrame:
    """``df`` with boilerplate lines taken out of its text; no row is dropped.

    ``host`` defaults to the column ``source``. All columns stay, whatever their
    names; if ``report`` is given, a column of that name is set to
    ``struct<n_lines, n_dropped>``.

    A line that fewer than ``min_pages`` pages of the host share always stays, so
    hosts of a few pages lose nothing. Edge cases: a null host counts as the empty
    host; a null text stays null and has 0 lines, but counts as a page in the
    host's total; an empty text is one empty line, and empty lines always stay; a
    text without dropped lines comes back byte for byte; a text that consists of
    boilerplate only becomes empty. Repeated rows are one page, and each is cleaned.
    """
    host = F.col("source") if host is None else host
    found = written(boilerplate_lines(df, host, text_col, max_ratio, min_pages).select("h", "line"), "boilerplate")
    size = found.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("bytes")).first()
    h, bad, salt, kept, gone = free_names(df, "h", "bad", "salt", "kept", "gone")
    by_host = found.groupBy(F.col("h").alias(h)).agg(F.collect_list("line").alias(bad))
    keyed = df.withColumn(h, F.coalesce(host, F.lit("")))
    if size["rows"] <= broadcast_rows and size["bytes"] <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(by_host), h, "left")
    else:  # hosts of many pages are dealt over the salts
        every = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn(salt, salt_of(F.col(text_col), salts)).join(every, [h, salt], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # a hash lookup finds which of the host's lines a text has; only those are compared with each line
    own = F.array_intersect(F.col(bad), F.transform(lines, _line))
    stay = lambda hit: F.when(F.size(hit) > 0, F.filter(lines, lambda x: ~F.array_contains(hit, _line(x)))).otherwise(lines)
    out = joined.withColumn(kept, F.when(F.col(bad).isNotNull() & F.col(text_col).isNotNull(), F.get(F.transform(F.array(own), stay), F.lit(0))))
    out = out.withColumn(gone, F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(F.col(kept))))
    text = F.when(F.col(gone) > 0, F.array_join(F.col(kept), "\n")).otherwise(F.col(text_col))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    about = F.struct(n.cast("long").alias("n_lines"), F.col(gone).cast("long").alias("n_dropped"))
    columns = [text.alias(c) if c == text_col else about.alias(c) if c == report else F.col(f"`{c}`") for c in df.columns]
    return out.select(*columns, *([about.alias(report)] if report and report not in df.columns else []))
