"""A registry of page parsers: site name to a function of the page; unknown sites use the general one."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

FIELDS = ("title", "date", "text", "speaker", "section")
Parser = Callable[[str], dict]
PARSERS: dict[str, Parser] = {}


def parser(*sites: str) -> Callable[[Parser], Parser]:
    """Register a parser for sites."""

    def add(fn: Parser) -> Parser:
        PARSERS.update(dict.fromkeys(sites, fn))
        return fn

    return add


def _plain(markup: str) -> str:
    markup = re.sub(r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", markup)
    return " ".join(entities.unescape(re.sub(r"<[^<>]*>", " ", markup)).split())


@parser("general")
def general(page: str) -> dict:
    """Title from og:title, title or h1; date from JSON-LD, article:published_time or time; text of paragraphs inside article, else of the page."""
    find = lambda rx: (re.search(rx, page, re.I | re.S) or [None, None])[1]
    ld = {}
    if block := find(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>"):
        try:
            ld = json.loads(block)
            ld = next((x for x in ld if isinstance(x, dict)), {}) if isinstance(ld, list) else ld if isinstance(ld, dict) else {}
        except ValueError:
            pass
    title = find(r'property="og:title"[^>]*content="([^"]*)') or find(r"<title[^>]*>(.*?)</title>") or find(r"<h1[^>]*>(.*?)</h1>") or ld.get("headline")
    date = ld.get("datePublished") or find(r'property="article:published_time"[^>]*content="([^"]*)') or find(r'<time[^>]*datetime="([^"]*)')
    body = find(r"<article\b[^>]*>(.*)</article>") or page
    paras = [p for p in map(_plain, re.split(r"(?i)</?p\b[^>]*>", body)) if p]
    author = ld.get("author")
    return {
        "title": _plain(str(title)) if title else None, "date": str(date)[:10] if date else None, "text": "\n".join(paras), "section": ld.get("articleSection") if isinstance(ld.get("articleSection"), str) else None,
        "speaker": author.get("name") if isinstance(author, dict) else author if isinstance(author, str) else None,
    }


def parse_pages(pages: DataFrame, site: str | None = None, page: str = "html", parsers: dict[str, Parser] | None = None, piece: int = 4 << 20) -> DataFrame:
    """Adds ``parsed``, a struct of ``FIELDS``, by the parser of the column ``site``; null pages give nulls.

    A worker holds one Arrow batch and the parsed fields of about ``piece`` characters
    of pages (a single page at least), which it hands on before it parses more.
    """
    table = {**PARSERS, **(parsers or {})}
    names = pages.columns
    kind = pa.struct([(f, pa.string()) for f in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(batch: pa.RecordBatch, begin: int, found: list[dict]) -> pa.RecordBatch:
            parsed = pa.array(found, kind)
            return pa.RecordBatch.from_arrays([*batch.slice(begin, len(found)).columns, parsed], names=[*names, "parsed"])

        for batch in batches:
            texts, begin, held, found = batch.column(names.index(page)), 0, 0, []
            sites = batch.column(names.index(site)) if site else None
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                own = table.get(sites[k].as_py() if site else "general", general)(text) if text else {}
                found.append({f: x if (x := own.get(f)) is None or isinstance(x, str) else str(x) for f in FIELDS})
                held += len(text or "")
                if held >= piece:
                    yield of(batch, begin, found)
                    begin, held, found = k + 1, 0, []
            if found:
                yield of(batch, begin, found)

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("parsed", StructType([StructField(f, StringType()) for f in FIELDS]))]))
