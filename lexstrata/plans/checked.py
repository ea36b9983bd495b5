"""Queries over literal rows, for scripts, dates, markup and files that the tables do not have.

Each has its expected rows, worked out by hand, as its SQL. ``cases`` is for a
function of one column, ``rows`` for an operator over small tables.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zipfile
import zlib
from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import dates as D
from lexstrata.functions import html as H
from lexstrata.functions import math as M
from lexstrata.functions import text as T
from lexstrata.operators import classify, gazetteer, ingest, publish, release, sampling, search, views
from lexstrata.plans.registry import query
from lexstrata.sources import files, shared, sinks

Build = Callable[[SparkSession], DataFrame]


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool) or isinstance(x, (int, float)):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def _values(columns: dict[str, str], expected: list[tuple]) -> str:
    """A SELECT of rows with DuckDB types."""
    names = list(columns)
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected)
    quoted = [f'"{n}"' for n in names]
    return f"SELECT {', '.join(f'CAST({q} AS {columns[n]}) AS {q}' for n, q in zip(names, quoted))} FROM (VALUES {body}) AS t({', '.join(quoted)})"


def rows(name: str, columns: dict[str, str], expected: list[tuple], build: Build) -> None:
    """Register a query whose rows are known; ``columns`` gives their DuckDB types."""
    query(name, _values(columns, expected))(lambda spark, sf_dir: build(spark).select(*columns))


def cases(name: str, of: Callable[[Column], Column], pairs: list[tuple], kind: str = "string") -> None:
    """Register a query that applies a function to each first item of ``pairs``; the second is its result as text."""

    def build(spark: SparkSession) -> DataFrame:
        df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], f"no int, x {kind}")
        return df.select("no", of(F.col("x")).cast("string").alias("y"))

    rows(name, {"no": "INTEGER", "y": "VARCHAR"}, [(i, y) for i, (_, y) in enumerate(pairs)], build)


def joined(of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.array_join(of(c), "|")


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of these bytes in the shared folder."""
    path = f"{shared.folder(spark)}/lexstrata-{uuid4().hex}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data), 0, len(data))
    out.close()
    return path


def fresh(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/lexstrata-{uuid4().hex}"


# functions of text

cases("fn_norm", T.norm, [("Ещё ёж", "Еще еж"), ("كتاب ١٢", "کتاب 12"), (None, ""), ("plain", "plain"), ("ۀة", "هه")])
cases("fn_fold", T.fold, [("Éclair ŞĞ", "eclair sg"), ("한국 ЁЛКА", "한국 елка"), ("ASCII Only", "ascii only"), (None, "")])
cases("fn_has_cjk", T.has_cjk, [("近日", "true"), ("한국", "true"), ("かな", "true"), ("abc é", "false"), (None, "false")])
cases("fn_index_terms", joined(T.index_terms), [("NNSA近日 12345 1234 Été", "nnsa|近|日|近日|1234|ete"), ("a a b", "a|a|b"), ("abc 12345", "abc"), ("Ёлка", "елка"), ("", "")])
cases("fn_sentences", joined(T.sentences), [('He said "Go." Then left! Ok?\nNew line. and on', 'He said "Go.|Then left!|Ok?|New line. and on'), ("今天。明天！好", "今天。|明天！"), ("U.S. troops", "U.S. troops"), ("Да. Нет.", "Да.|Нет."), (None, "")])
cases("fn_cut_long", joined(lambda c: T.cut_long(c, 10)), [("one, two, three", "one, two,|three"), ("aaaa bbbb cccc", "aaaa bbbb|cccc"), ("x" * 25, "x" * 10 + "|" + "x" * 10 + "|" + "x" * 5), ("short", "short")])
cases("fn_n_words", T.n_words, [("two words 近日", "4"), ("", "0"), (None, "0"), ("don't", "2")])
cases("fn_cjk_share", T.cjk_share, [("近日ab", "0.5"), ("...", None), ("abc", "0.0"), ("近日", "1.0")])
cases("fn_clean", T.clean, [("see https://x.y/z  now", "see now"), (" a\n b ", "a b"), (None, "")])
cases("fn_first_sentence", lambda c: T.first_sentence(c, 20), [("One here. Two.", "One here."), ("今天。明天", "今天。"), ("a very long sentence without an end", "a very long…")])
cases("fn_norm_title", T.norm_title, [("Hello, World 2!", "helloworld2"), ("А — Б", "аб"), ("x" * 90, "x" * 80)])
cases("fn_title_template", T.title_template, [("Briefing on 2 April 2026!", "briefing on april"), ("№ 5", "")])
cases("fn_md_escape", T.md_escape, [("a|b", "a\\|b"), ("a \n b", "a b")])
cases("fn_speaker_prefix", T.speaker_prefix_removed, [("Mao Ning: Hello", "Hello"), ("发言人：你好", "你好"), ("no prefix", "no prefix"), ("x" * 50 + ": y", "x" * 50 + ": y")])
cases("fn_wayback_stamp", T.wayback_stamp, [("x20240102030405y 123", "20240102030405"), ("202401020304056", None), (None, None)])
cases("fn_archive_link", lambda c: T.archive_link(F.lit("http://a/b"), c), [("https://web.archive.org/web/20240101id_/http://x", "https://web.archive.org/web/20240101/http://x"), ("20240101", "https://web.archive.org/web/20240101/http://a/b"), (None, "https://web.archive.org/web/http://a/b"), ("odd", "https://web.archive.org/web/http://a/b")])
cases("fn_fa_norm", T.fa_norm, [("كتاب ي", "کتاب ی"), ("می‌شود ۱۲", "می شود 12"), (None, "")])
cases("fn_ascii_digits", T.ascii_digits, [("۱۴۰۳/٠٢", "1403/02"), ("12", "12")])
cases("fn_eligible_en", lambda c: T.eligible(c, F.lit("en")), [("x" * 25, "true"), ("x" * 24, "false"), (" " * 9 + "x" * 20, "false"), (None, "false")])
cases("fn_eligible_zh", lambda c: T.eligible(c, F.lit("zh")), [("近" * 10, "true"), ("近" * 9, "false")])
cases("fn_crc31", T.crc31, [(x, str(zlib.crc32(x.encode()) & 0x7FFFFFFF)) for x in ("", "abc", "近日", "Да.")])
cases("fn_make_id", lambda c: T.make_id(F.lit("s"), c), [(x, "s:" + hashlib.sha1(x.encode()).hexdigest()[:16]) for x in ("http://a", "http://a/é")])
cases("fn_bucket_of", lambda c: T.bucket_of(c, 97), [("", str(0x811C9DC5 % 97)), ("a", str((((0x811C9DC5 ^ 97) * 16777619) & 0xFFFFFFFF) % 97)), ("近日", str((((((0x811C9DC5 ^ ord("近")) * 16777619) & 0xFFFFFFFF) ^ ord("日")) * 16777619 & 0xFFFFFFFF) % 97))])
cases("fn_sha256", lambda c: F.sha2(c.cast("binary"), 256), [(x, hashlib.sha256(x.encode()).hexdigest()) for x in ("", "近日")])
cases("fn_phrases_in", joined(lambda c: classify.phrases_in(c, ["red line", "peace talks"])), [("A RED LINE and peace talks", "red line|peace talks"), ("none", "")])
cases("fn_readable", lambda c: F.lit(gazetteer.readable("(?<!x)abc(?!x)", ["(?<!x)", "(?!x)"])), [("", "abc")])
cases("fn_signal", lambda c: classify.signal(c, F.lit("en"), {"en": "strike"}, {"en": "nuclear"}, {"en": "^why"}), [("nuclear strike", "W"), ("nuclear power", "A"), ("nuclear strike?", None), ("why nuclear", None), ("nothing", None)])
cases("fn_tags", lambda c: classify.tags(c, [("license", "L"), ("idiot", "I")]), [("MIT License idiot", "L; I"), ("zzz", "Other / General")])
cases("fn_priority_group", lambda c: classify.priority_group(c, [("gov", "ministry"), ("wire", "agency")]), [("the agency of the ministry", "gov"), ("an agency", "wire"), ("none", None)])

# functions of dates

cases("fn_written_dates_all", D.first_date, [("March 5, 2024", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("30 February 2024", None), ("5 мая 2024 года", "2024-05-05"), ("3 Şubat 2021", "2021-02-03"), ("05.03.2024", "2024-03-05"), ("2024-3-5", "2024-03-05"), ("none", None)])
cases("fn_jalali", D.jalali_text, [("1403/01/01", "2024-03-20"), ("1402/12/29", "2024-03-19"), ("1399/12/30", "2021-03-20"), ("۱۴۰۰/۰۱/۰۱", "2021-03-21"), ("1357/11/22", "1979-02-11"), ("1403/13/01", None)])
cases("fn_roc", D.roc_date, [("113年5月20日", "2024-05-20"), ("中華民國99年1月1日", "2010-01-01"), ("none", None)])
cases("fn_tehran", D.tehran_date, [("2024-03-05T21:00:00Z", "2024-03-06"), ("2024-03-05T21:00:00", "2024-03-05"), ("2024-03-05T20:29:00Z", "2024-03-05")])
cases("fn_term_at", lambda c: D.term_at(c.cast("date"), [("2016-05-20", "first"), ("2024-05-20", "second")]), [("2022-01-01", "first"), ("2024-05-20", "second"), ("2010-01-01", None)])
cases("fn_inferred_year", lambda c: D.inferred_year(F.lit(12), F.lit(30), c.cast("date")), [("2024-01-02", "2023-12-30"), ("2024-12-31", "2024-12-30")])
cases("fn_reconciled", lambda c: D.reconciled(c.cast("date"), F.lit("2024-01-01").cast("date"), F.lit("2024-06-01").cast("date")), [("2024-05-01", "2024-01-01"), ("2024-01-03", "2024-01-03")])
cases("fn_period_range", lambda c: F.concat_ws("..", D.period_range(c)["lo"].cast("string"), D.period_range(c)["hi"].cast("string")), [("2024-02", "2024-02-01..2024-02-29"), ("2024-12", "2024-12-01..2024-12-31")])
cases("fn_months_between", lambda c: F.array_join(F.transform(D.months_between(c.cast("date"), F.lit("2024-02-10").cast("date")), lambda x: x.cast("string")), "|"), [("2023-12-31", "2024-02-01|2024-01-01|2023-12-01"), ("2024-02-01", "2024-02-01")])
cases("fn_utc_stamp", D.utc_stamp, [("2024-03-05T21:00:00Z", "2024-03-05 21:00:00"), ("2024-03-05T21:00:00+03:30", "2024-03-05 17:30:00"), ("2024-03-05T21:00:00", "2024-03-05 21:00:00"), ("2024-03-05", "2024-03-05 00:00:00"), ("odd", None), ("", None)])
cases("fn_cutoff", lambda c: D.cutoff(c, F.lit("2024-06-01 12:00:00").cast("timestamp")), [("2024-05-01", "2024-05-01 23:59:59"), ("2024-06-01", "2024-06-01 12:00:00"), (None, "2024-06-01 12:00:00"), ("2024-05-31T10:00:00+02:00", "2024-05-31 08:00:00")])

# functions of numbers

cases("fn_soft_log_loss", lambda c: F.round(M.soft_log_loss(c, F.lit(0.5)), 6), [(0.5, "0.693147"), (0.9, "1.203973")], "double")
cases("fn_normal_cdf", lambda c: F.round(M.normal_cdf(c), 3), [(0.0, "0.5"), (1.96, "0.975"), (-1.96, "0.025")], "double")
cases("fn_alert_score", lambda c: F.round(M.alert_score(c, F.lit(90)), 6), [(-4.0, "8.0"), (3.0, "6.0")], "double")
cases("fn_bit_reversed", lambda c: sampling.bit_reversed(c, 3), [(0, "0"), (1, "4"), (2, "2"), (3, "6"), (4, "1")], "long")
cases("fn_scattered", sampling.scattered, [(k, str(zlib.crc32(str(k).encode()) * 2654435761 % 2**32)) for k in (0, 1, 77)], "long")
cases("fn_held_out", sampling.held_out, [(k, str(zlib.crc32(str(k).encode()) % 1000 < 200).lower()) for k in range(12)], "long")
cases("fn_undelta", joined(lambda c: publish.undelta(publish.delta(c))), [([3, 7, 20], "3|7|20"), ([], ""), ([5], "5")], "array<long>")
cases("fn_sealed", lambda c: publish.unsealed(publish.sealed(c.cast("binary"), F.lit(b"0123456789abcdef"), F.lit(b"012345678901")), F.lit(b"0123456789abcdef")), [("secret", "secret"), ("近", "近")])

# markup

PAGE = '<html lang="en"><head><title>T &amp; t</title><meta property="og:title" content="OG"><script type="application/ld+json">{"datePublished":"2024-01-02"}</script></head><body><div class="a"><p>One<br>1</p><div>in</div><p>Two</p></div><a href="/x">l</a></body></html>'
cases("fn_html_titles", lambda c: F.concat_ws("|", H.title_of(c), H.lang_attribute(c), F.array_join(H.links(c), ",")), [(PAGE, "OG|en|/x"), ("<title> plain </title>", "plain|")])
cases("fn_html_paragraphs", H.paragraphs, [(PAGE, "One 1\nTwo"), ("none", "")])
cases("fn_html_json_ld", lambda c: H.json_ld(c, "datePublished"), [(PAGE, "2024-01-02"), ("<p>", None)])
cases("fn_html_balanced", lambda c: H.balanced("div")(c, F.lit('class="a"')), [(PAGE, "<p>One<br>1</p><div>in</div><p>Two</p>")])
cases("fn_html_decoded", lambda c: F.right(H.decoded(c), F.lit(2)), [(bytearray("<meta charset=gbk>近日".encode("gb18030")), "近日"), (bytearray("<meta charset=utf-8>é!".encode()), "é!")], "binary")
cases("fn_canonical_url", H.canonical_url, [("http://www.Ex.org:80/a/?q#f", "https://ex.org/a"), ("https://ex.org", "https://ex.org")])
cases("fn_robots", lambda c: H.robots_allowed(c, [("disallow", "/a"), ("allow", "/a/b"), ("disallow", "/*.pdf$")]), [("/a/x", "false"), ("/a/b/c", "true"), ("/z.pdf", "false"), ("/z.pdfx", "true")])

# feeds and files

rows("feed_sitemap", {"loc": "VARCHAR", "lastmod": "VARCHAR"}, [("http://a/?x=1&y", "2024-01-01"), ("http://b", None)], lambda s: files.sitemap_rows(s.createDataFrame([("<urlset><url><loc>http://a/?x=1&amp;y</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://b</loc></url></urlset>",)], "xml string")))
rows("feed_rss", {"title": "VARCHAR", "link": "VARCHAR", "published": "TIMESTAMP"}, [("A b", "http://c", "2024-03-05 10:00:00"), ("B", None, "2024-03-06 10:00:00")], lambda s: files.feed_rows(s.createDataFrame([("<rss><item><title><![CDATA[A b]]></title><link>http://c</link><pubDate>Tue, 05 Mar 2024 13:30:00 +0330</pubDate></item><item><title>B</title><pubDate>Wed, 6 Mar 2024 10:00:00 GMT</pubDate></item></rss>",)], "xml string")))
rows("feed_wordpress", {"id": "BIGINT", "date": "DATE", "url": "VARCHAR", "title": "VARCHAR", "text": "VARCHAR"}, [(1, "2024-03-05", "http://w/1", "A & b", "x\ny")], lambda s: files.wordpress_posts(s.createDataFrame([('[{"id":1,"date_gmt":"2024-03-05T01:00:00","link":"http://w/1","title":{"rendered":"A &amp; b"},"content":{"rendered":"<p>x</p><p>y</p>"}}]',)], "body string")))
rows("feed_telegram", {"post": "VARCHAR", "text": "VARCHAR"}, [("ch/1", "Hi\nyou"), ("ch/2", "")], lambda s: files.telegram_posts(s.createDataFrame([('<div data-post="ch/1"><div class="tgme_widget_message_text x">Hi<br/>you</div></div><div data-post="ch/2"></div>',)], "html string")))
rows("feed_cdx", {"original": "VARCHAR", "stamp": "VARCHAR", "status": "INTEGER", "digest": "VARCHAR", "length": "BIGINT"}, [("http://a/", "20240101000000", 200, "AAA", 512), ("http://a/", "20240201000000", None, "BBB", 600)], lambda s: files.cdx_rows(s.createDataFrame([("urlkey timestamp original mimetype statuscode digest length",), ("org,a)/ 20240101000000 http://a/ text/html 200 AAA 512",), ("org,a)/ 20240201000000 http://a/ text/html - BBB 600",), ("resume-key",)], "value string")))

LINES = '{"id":"s:1","source":"s","text":"é","tags":["a"],"odd":5}\nnot json\n[1]\n\n{"id":"s:2","source":"s"}\n{"id":"s:3'.encode()
rows("scan_jsonl", {"id": "VARCHAR", "extra": "VARCHAR"}, [("s:1", '{"odd":"5"}'), ("s:2", None)], lambda s: files.read_jsonl(s, put(s, "a.jsonl", LINES))[0])
rows("scan_jsonl_gz", {"id": "VARCHAR"}, [("s:1",), ("s:2",)], lambda s: files.read_jsonl(s, put(s, "a.jsonl.gz", gzip.compress(LINES)))[0])
rows("scan_complete_lines", {"line": "BIGINT", "start": "BIGINT"}, [(i, LINES[:n].rfind(b"\n") + 1) for i, n in enumerate([k for k, c in enumerate(LINES) if c == 10], 1)], lambda s: files.complete_lines(s, put(s, "a.jsonl", LINES)))
rows("scan_snapshot", {"bytes_read": "BIGINT", "tail_bytes": "BIGINT", "sha256": "VARCHAR", "lines": "BIGINT"}, [(LINES.rindex(b"\n") + 1, 10, hashlib.sha256(LINES[:-10]).hexdigest(), 4)], lambda s: files.snapshot_info(s, put(s, "a.jsonl", LINES)))
rows("scan_line_ids", {"i": "VARCHAR"}, [("s:1",), (None,), ("s:2",)], lambda s: s.createDataFrame([('{"id":"s:1","text":"x"}',), ("odd",), ('{"a":1,"id":"s:2"}',)], "v string").select(files.line_id(F.col("v")).alias("i")))
rows("scan_ids", {"id": "VARCHAR"}, [("s:1",), ("s:2",)], lambda s: files.read_ids(s, put(s, "ids", b"# mark\ns:1\n\ns:2\ns:1\n")))
rows("scan_parts_order", {"id": "VARCHAR", "t": "VARCHAR"}, [("s:1", "old"), ("s:2", "act")], lambda s: files.all_docs(s.createDataFrame([("s:1", "zz", "/p/2.gz", "new"), ("s:1", "zz", "/p/legacy/9.gz", "old")], "id string, country string, file string, t string"), s.createDataFrame([("s:1", "zz", "/active", "act"), ("s:2", "zz", "/active", "act"), ("s:3", "yy", "/active", "no")], "id string, country string, file string, t string"), ["ZZ"]))
rows("scan_csv", {"date": "VARCHAR", "name": "VARCHAR"}, [("2024-01-01", "x")], lambda s: files.read_csv(s, put(s, "a.csv", "﻿date,name\n2024-01-01 , x\n".encode()), "date string, name string"))


def workbook() -> bytes:
    """Two sheets whose files are numbered the other way round."""
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="one" r:id="r9"/><sheet name="two" r:id="r5"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r9" Target="worksheets/sheet2.xml"/><Relationship Id="r5" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si><si><r><t>ru</t></r><r><t>ns</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c><c r="AA1"><v>7</v></c></row></sheetData></worksheet>')
    return data.getvalue()


rows("scan_xlsx_named", {"row": "BIGINT", "v": "VARCHAR"}, [(3, "hello|-|in")], lambda s: files.read_xlsx(s, put(s, "b.xlsx", workbook()), "two").select("row", F.array_join("values", "|", "-").alias("v")))
rows("scan_xlsx_first", {"row": "BIGINT", "v": "VARCHAR", "n": "INTEGER"}, [(1, "runs|7", 27)], lambda s: files.read_xlsx(s, put(s, "b.xlsx", workbook())).select("row", F.array_join("values", "|").alias("v"), F.size("values").alias("n")))


def matrix() -> bytes:
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype=np.float32).reshape(3, 2))
    return out.getvalue()


rows("scan_npy", {"row": "BIGINT", "v": "VARCHAR"}, [(0, "0.0|1.0"), (1, "2.0|3.0"), (2, "4.0|5.0")], lambda s: files.read_npy(s, [put(s, "m.npy", matrix()), "/nowhere/n.npy"]).select("row", F.array_join(F.transform("vector", lambda x: x.cast("string")), "|").alias("v")))
rows("scan_aggregate", {"k": "BIGINT", "n": "INTEGER"}, [(3, 2)], lambda s: files.read_aggregate(s, put(s, "a.json", b'{"k": 3,\n "rows": [{"a": 1}, {"a": 2}]}'), "k long, rows array<struct<a:int>>").select("k", F.size("rows").alias("n")))
rows("scan_terms", {"a": "VARCHAR", "b": "VARCHAR", "c": "VARCHAR"}, [("g", "x", "a OR b"), ("g", "plain", "plain")], lambda s: s.createDataFrame(search.read_terms(["## g", "# no", "x | a OR b", "plain"]), "a string, b string, c string"))
rows("scan_legacy", {"source": "VARCHAR", "text": "VARCHAR", "via": "VARCHAR"}, [("old", "a", "direct")], lambda s: files.import_legacy(s.createDataFrame([("http://1", "a"), ("http://2", " "), ("http://3", None), ("http://1", "a")], "url string, text string"), "old", "text"))
rows("scan_qa", {"text": "VARCHAR", "speaker": "VARCHAR"}, [("Q?\n\nA.", "Li"), ("Only", None)], lambda s: files.qa_documents(s.createDataFrame([("s", "Q?", "A.", "en", "Li"), ("s", "Q?", "A.", "en", "Li"), ("s", "", "Only", "en", "N/A"), ("s", "", "", "en", "x")], "source string, question string, answer string, lang string, speaker string"), F.col("question"), F.col("answer"), "lang"))


def tailed(s: SparkSession) -> DataFrame:
    """A file grows, another is rewritten, a third stays: modes and lines of the second reading."""
    paths = [put(s, f"{n}.jsonl", b"a\nb\n") for n in ("grow", "change", "stay")]
    _, state = files.tail(s, paths)
    fs = s._jvm.org.apache.hadoop.fs
    for path, data in zip(paths, (b"a\nb\nc\npart", b"x\nb\nc\n")):
        out = fs.Path(path).getFileSystem(s._jsc.hadoopConfiguration()).create(fs.Path(path), True)
        out.write(bytearray(data), 0, len(data))
        out.close()
    lines, now = files.tail(s, paths, state)
    name = F.regexp_extract("file", "([a-z]+)\\.jsonl$", 1).alias("name")
    got = lines.groupBy(name).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("start").cast("string"), 3, "0"), "value"))), "|").alias("lines"))
    return now.select(name, "mode", "done").join(got, "name", "left")


rows("scan_tail", {"name": "VARCHAR", "mode": "VARCHAR", "done": "BIGINT", "lines": "VARCHAR"}, [("grow", "append", 6, "004:c"), ("change", "replace", 6, "000:x|002:b|004:c"), ("stay", "same", 4, None)], tailed)

# sinks


def sealed(s: SparkSession) -> DataFrame:
    parts, manifest = f"{fresh(s)}/parts", f"{fresh(s)}/manifest"
    batch = s.createDataFrame([("s:1", "a"), ("s:2", "b")], "id string, text string")
    ingest.seal(batch, parts, manifest, "2024-01")
    ingest.seal(s.createDataFrame([("s:2", "later"), ("s:3", "c")], batch.schema), parts, manifest, "2024-02")
    return ingest.sealed_docs(s, manifest)


rows("sink_seal", {"id": "VARCHAR"}, [("s:1",), ("s:2",), ("s:3",)], sealed)


def released(s: SparkSession, kind: str) -> DataFrame:
    df = s.createDataFrame([("2024-01-02", "s", "b"), ("2024-01-01", "s", 'a "q", x')], "date string, source string, id string")
    path = fresh(s)
    if kind == "parquet":
        release.write_release(df, path)
        return s.read.parquet(path)
    if kind == "csv":
        release.write_csv(df, path)
        return s.read.option("header", True).option("escape", '"').csv(path)
    release.write_jsonl(df, path, ["date"])
    return s.read.json(path)


for _kind in ("parquet", "csv", "jsonl"):
    rows(f"sink_release_{_kind}", {"date": "VARCHAR", "id": "VARCHAR"}, [("2024-01-02", "b"), ("2024-01-01", 'a "q", x')], lambda s, k=_kind: released(s, k))


def bucketed(s: SparkSession) -> DataFrame:
    path = fresh(s)
    sinks.write_buckets(s.createDataFrame([("a", 0, 1), ("b", 1, 2)], "token string, bucket int, n int"), path)
    return s.read.json(path).select("token", "n", "bucket")


rows("sink_buckets", {"token": "VARCHAR", "n": "BIGINT", "bucket": "INTEGER"}, [("a", 1, 0), ("b", 2, 1)], bucketed)


def materialized(s: SparkSession) -> DataFrame:
    docs = s.createDataFrame([("1", "c", "s"), ("2", "c", "t")], "id string, country string, source string")
    path = fresh(s)
    sinks.materialize(docs, docs.select("id"), path)
    return s.read.json(path).groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"))


rows("sink_materialize", {"country": "VARCHAR", "source": "VARCHAR", "n": "BIGINT"}, [("c", "s", 1), ("c", "t", 1)], materialized)
rows("sink_prune", {"name": "VARCHAR"}, [("b2",)], lambda s: sinks.prune(s.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",)], "name string"), 2, "b1"))
rows("sink_markdown", {"md": "VARCHAR"}, [("true",)], lambda s: s.createDataFrame([(str("| 1 | a\\|b |" in views.markdown(s.createDataFrame([(1, "a|b")], "n int, t string"), "T")).lower(),)], "md string"))
