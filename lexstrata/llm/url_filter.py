"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is literal text with ``*`` (any run of characters), ``^`` (one
character that is not a letter or digit, or an end of the URL) and ``|`` at an
end (the URL's start or end). Its literal tokens are the runs of ``a-z0-9`` that
any match holds as whole tokens; the one that is rarest in the URLs at hand is
its place in the index. A URL's distinct tokens and host suffixes fetch the
candidates in one broadcast hash join, and only fetched rules run their regular
expression. Everything is SQL functions: no Python runs on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import maybe_broadcast, small_table

#: Fixed host rules: verdict and rule, a host with a path prefix.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Fixed pattern rules; a URL that matches one is blocked unless a host rule decides.
PATTERN_RULES = (
    "^spam-farm^", "^spam-farm-*.", "^adult-x^", "^adult-content^", "^free-casino^", "^online-casino^", "^xxx-*/",
    "^buy-viagra^", "^cheap-pills^", "^link-farm^", "/wp-login.php^", "/cgi-bin/*^phish^", "^click^redirect^", "^malware-*.exe|",
)

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern rule."""

    rule: str
    regex: str
    tokens: tuple[str, ...]


def compile_pattern(rule: str) -> Pattern:
    """The Java regular expression of a rule and the whole tokens that each match holds."""
    text = rule.lower()
    start, end = text.startswith("|"), text.endswith("|") and len(text) > 1
    body = text[start : len(text) - end]
    regex = "".join(".*" if c == "*" else "(?:^|$|[^a-z0-9])" if c == "^" else re.escape(c) if c.isascii() else c for c in body)
    tokens = []
    for m in re.finditer(TOKEN, body):
        left = body[m.start() - 1] != "*" if m.start() else start
        right = body[m.end()] != "*" if m.end() < len(body) else end
        if left and right:
            tokens.append(m[0])
    return Pattern(rule, ("^" if start else "") + regex + ("$" if end else ""), tuple(dict.fromkeys(tokens)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(u, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, patterns: Iterable[Pattern]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules (bounded by the rules, not by the URLs)."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    if not wanted:
        return {}
    found = urls.select(F.explode(F.array_intersect(_tokens(F.col("url")), F.lit(wanted))).alias("token")).groupBy("token").count()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in found.collect()}


def filter_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: Iterable[tuple[str, str]] = HOST_RULES,
    pattern_rules: Iterable[str] = PATTERN_RULES,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, pattern``.

    ``rule`` is the longest host rule that fits (of equal length the first in
    text order), with its verdict; where none fits it is null and the verdict is
    ``block`` if a pattern rule matches, else ``allow``. ``pattern`` is the first
    of the matching pattern rules, whatever the verdict. The rules are given by
    the caller and are not made from the data; their table is broadcast if it has
    at most ``BROADCAST_ROWS`` rows and joined by a shuffle else.

    Edge cases: a null URL, or one without ``://``, has an empty host and path
    and fits no host rule, yet its tokens may fetch pattern rules; repeated rows
    (also of one id) are each judged; null ids stay null; an empty table gives an
    empty result. Other columns of ``df`` are not read.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    patterns = [compile_pattern(r) for r in dict.fromkeys(pattern_rules)]
    seen = rarest_tokens(pages, patterns)
    rows = []
    hosts = sorted({r: v for v, r in host_rules}.items(), key=lambda x: (len(x[0]), [-ord(c) for c in x[0]]))
    for no, (rule, verdict) in enumerate(hosts, 1):
        name, _, path = rule.partition("/")
        rows.append(("h:" + name.lower(), no, "/" + path, None, rule, verdict))
    for no, p in enumerate(reversed(patterns), 1):
        key = min(p.tokens, key=lambda t: (seen[t], t)) if p.tokens else ""  # without a token: judged for every URL
        rows.append(("t:" + key, no, None, p.regex, p.rule, None))
    rules = small_table(df.sparkSession, rows, key=pa.string(), no=pa.int32(), prefix=pa.string(), regex=pa.string(), rule=pa.string(), verdict=pa.string())

    host, path = host_path(F.col("url"))
    pages = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    tokens = F.transform(F.array_union(_tokens(F.col("url")), F.array(F.lit(""))), lambda t: F.concat(F.lit("t:"), t))
    keyed = pages.withColumn("key", F.explode(F.concat(suffixes, tokens)))
    judged = keyed.join(maybe_broadcast(rules.select("key", "no", "prefix", "regex"), len(rows)), "key", "left")
    fits = F.col("path").startswith(F.col("prefix"))
    hit = F.expr("lower(url) rlike regex")
    best = judged.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(F.col("prefix").isNotNull() & fits, F.col("no"))).alias("host_no"),
        F.max(F.when(F.col("regex").isNotNull() & hit, F.col("no"))).alias("pattern_no"),
    )
    by_host = maybe_broadcast(rules.filter("prefix is not null").select(F.col("no").alias("host_no"), "rule", "verdict"), len(rows))
    by_pattern = maybe_broadcast(rules.filter("regex is not null").select(F.col("no").alias("pattern_no"), F.col("rule").alias("pattern")), len(rows))
    out = best.join(by_host, "host_no", "left").join(by_pattern, "pattern_no", "left")
    own = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "pattern")
