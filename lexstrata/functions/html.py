"""HTML, feeds and URLs as Column expressions; only balanced elements and entities need Python."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that end a line.
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|figure|figcaption|pre|form|dd|dt|dl"
#: Entities that the JVM chain decodes; &amp; comes last.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&laquo;", "«"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All named and numeric entities."""
    return text.map(lambda t: None if t is None else entities.unescape(t))


def basic_unescape(text: Column) -> Column:
    """The common entities, in the JVM."""
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def collapse(text: Column) -> Column:
    """Blanks of a line collapsed, empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\s\\u00a0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_html(page: Column, every_entity: bool = False) -> Column:
    """Text of a page: scripts, styles and comments out, blocks as lines, other tags as blanks, entities decoded."""
    t = F.regexp_replace(F.coalesce(page, F.lit("")), "(?is)<(script|style|noscript)\\b[^>]*>.*?</\\1\\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, f"(?i)</?(?:{BLOCKS})\\b[^<>]*>", "\n")
    t = F.regexp_replace(t, "<[^<>]*>", " ")
    return collapse(unescape(t) if every_entity else basic_unescape(t))


def paragraphs(page: Column) -> Column:
    """Texts of ``<p>`` elements, joined by lines."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit("(?is)<p\\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, lambda x: F.replace(clean_html(x), F.lit("\n"), F.lit(" "))), lambda x: x != ""), "\n")


def meta(page: Column, name: str) -> Column:
    """Content of a meta element by name or property; null without one."""
    a = F.regexp_extract(page, f"(?is)<meta\\b[^>]*(?:name|property)=[\"']{re.escape(name)}[\"'][^>]*content=[\"']([^\"']*)", 1)
    b = F.regexp_extract(page, f"(?is)<meta\\b[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{re.escape(name)}[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def element_text(page: Column, name: str) -> Column:
    """Text of the first element of this name; null without one."""
    return F.nullif(F.trim(F.replace(clean_html(F.regexp_extract(page, f"(?is)<{name}\\b[^>]*>(.*?)</{name}\\s*>", 1)), F.lit("\n"), F.lit(" "))), F.lit(""))


def title_of(page: Column) -> Column:
    """og:title, else the title element, else the first heading."""
    return F.coalesce(meta(page, "og:title"), element_text(page, "title"), element_text(page, "h1"))


def json_ld(page: Column, field: str) -> Column:
    """A field of the page's first JSON-LD object."""
    block = F.regexp_extract(page, "(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>", 1)
    return F.get_json_object(block, f"$.{field}")


def links(page: Column) -> Column:
    """``href`` of anchors in order."""
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit("(?is)<a\\b[^>]*\\bhref=[\"']([^\"']*)[\"']"), F.lit(1))


def lang_attribute(page: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(page, "(?is)<html\\b[^>]*\\blang=[\"']?([a-zA-Z-]+)", 1)), F.lit(""))


def sitemap(xml: Column) -> Column:
    """``array<struct<loc, lastmod>>`` of a sitemap or an index of them."""
    entries = F.regexp_extract_all(xml, F.lit("(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    of = lambda x, tag: F.nullif(F.trim(basic_unescape(F.regexp_extract(x, f"(?is)<{tag}>\\s*(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?\\s*</{tag}>", 1))), F.lit(""))
    return F.transform(entries, lambda x: F.struct(of(x, "loc").alias("loc"), of(x, "lastmod").alias("lastmod")))


def rss_items(xml: Column) -> Column:
    """``array<struct<title, link, published>>`` of a feed."""
    items = F.regexp_extract_all(xml, F.lit("(?is)<item\\b[^>]*>(.*?)</item>"), F.lit(1))
    of = lambda x, tag: F.nullif(F.trim(basic_unescape(F.regexp_extract(x, f"(?is)<{tag}>\\s*(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?\\s*</{tag}>", 1))), F.lit(""))
    plain = lambda x: F.regexp_replace(of(x, "pubDate"), "^[A-Za-z]{3},\\s*|\\s*(?:GMT|UTC?|Z)$", "")
    zoned = lambda x: F.when(x.rlike("[+-]\\d{4}$"), x).otherwise(F.concat(x, F.lit(" +0000")))
    stamp = lambda x: F.try_to_timestamp(zoned(plain(x)), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.transform(items, lambda x: F.struct(of(x, "title").alias("title"), of(x, "link").alias("link"), stamp(x).alias("published")))


def balanced(name: str = "div"):
    """An Arrow UDF of (page, marker): the inner HTML of the element of this name whose start tag holds the marker; null without one."""
    tag = re.compile(rf"<(/?){name}\b[^>]*>", re.I)

    @F.pandas_udf(StringType())
    def inner(page: pd.Series, marker: pd.Series) -> pd.Series:
        def of(p, mark):
            if not p or not mark:
                return None
            depth = start = 0
            for m in tag.finditer(p):
                if depth == 0:
                    if not m[1] and mark in m[0]:
                        depth, start = 1, m.end()
                    continue
                depth += -1 if m[1] else 1
                if depth == 0:
                    return p[start : m.start()]
            return p[start:] if depth else None

        return pd.Series([of(p, m) for p, m in zip(page, marker)], index=page.index)

    return inner


@F.pandas_udf(StringType())
def decoded(body: pd.Series) -> pd.Series:
    """Text of raw bytes, gzipped or not, by the charset they name (GB 2312 and GBK as GB 18030), UTF-8 else."""
    import gzip

    def of(b):
        if b is None:
            return None
        b = bytes(b)
        b = gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b
        m = re.search(rb"charset=[\"']?([\w-]+)", b[:2048], re.I)
        name = m[1].decode().lower() if m else "utf-8"
        try:
            return b.decode("gb18030" if name in ("gb2312", "gbk") else name, "replace")
        except LookupError:
            return b.decode("utf-8", "replace")

    return body.map(of)


def canonical_url(url: Column) -> Column:
    """https, no ``www.``, default port, query or fragment; host lower case; no slash at the end."""
    u = F.regexp_replace(F.trim(url), "[?#].*$", "")
    host = F.lower(F.regexp_extract(u, "^[a-zA-Z]+://([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(?:80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[a-zA-Z]+://[^/]*(.*)$", 1), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path)).otherwise(u)


def native_id(url: Column) -> Column:
    """The last number of at least ``3`` digits in the path, else 16 hex digits of the SHA-1."""
    found = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "(\\d{3,})[^\\d/]*/?$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(F.sha1(url.cast("binary")), 1, 16))


def robots_allowed(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path may be fetched: the longest matching rule wins, of equal length an allow; ``*`` and a final ``$`` are wild cards."""
    best = F.array(*(F.when(path.rlike("^" + ".*".join(re.escape(x) for x in p.rstrip("$").split("*")) + ("$" if p.endswith("$") else "")), F.struct(F.lit(len(p)).alias("n"), F.lit(kind == "allow").alias("ok"))) for kind, p in rules if p))
    top = F.array_max(F.array_compact(best))
    return F.coalesce(top["ok"], F.lit(True))
