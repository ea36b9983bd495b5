"""WARC derivatives against Python's own HTML parser, stored responses, odd headers; long texts in linear time."""

import gzip
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lexstrata.llm import warc
from lexstrata.llm.license_scan import license_scan, templates_of

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Text, title, metas and links by the library's event parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.metas, self.links, self.skip, self.in_title = [], None, [], [], None, None

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in warc._LINE:
            self.text.append("\n")
        own = {k: v for k, v in attrs if v is not None}
        if tag == "meta" and own:
            self.metas.append(own)
        elif own.get(warc._LINKS.get(tag)):
            self.links.append(own[warc._LINKS[tag]])
        if tag == "title":
            self.in_title = []
        elif tag in warc._RAW:
            self.skip = tag

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        elif tag == "title" and self.in_title is not None:
            self.title = " ".join("".join(self.in_title).split()) if self.title is None else self.title
            self.in_title = None
        elif tag in warc._LINE and not self.skip:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title is not None:
            self.in_title.append(data)
        elif not self.skip:
            self.text.append(data)


def test_against_the_event_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        if r.html is None:
            continue
        p = Plain()
        p.feed(r.html)
        p.close()
        want = "\n".join(x for x in (" ".join(x.split()) for x in "".join(p.text).split("\n")) if x)
        text, title, metas, links = warc.parse_html(r.html)
        assert (text, title or "", [x["url"] for x in links], metas) == (want, p.title or "", p.links, p.metas), r.page_id


@pytest.mark.parametrize("page", ["<" + "a" * 3_000_000, "<a " + "b" * 3_000_000 + ">", "<a" * 1_000_000, "<a b='" * 500_000, "<!" * 1_000_000, "<script>" * 300_000, "<a " + "b " * 1_000_000 + ">", "<p a=" + " " * 2_000_000 + ">"])
def test_markup_is_read_once(page):
    began = time.process_time()
    warc.parse_html(page)
    assert time.process_time() - began < 20


def test_many_phrases_are_counted_once(spark):
    n = 400_000
    df = spark.createDataFrame([(1, "cc by nc " * n)], "doc_id long, text string")
    began = time.time()
    r = license_scan(df).first()
    assert time.time() - began < 60
    assert (r.n_base, r.first_word, r.last_word, r.n_words) == (n, 0, 3 * (n - 1), 3 * n)


def test_templates_of_a_table(spark):
    table = spark.createDataFrame([("x", "some own terms of use apply here"), (None, "y"), ("z", None)], "label string, text string")
    df = spark.createDataFrame([(1, "see: some own terms\nof use apply here"), (2, "none")], "doc_id long, text string")
    assert [r.labels for r in license_scan(df, templates=templates_of(table)).orderBy("doc_id").collect()] == ["x", ""]
    with pytest.raises(ValueError):
        templates_of(table.union(table), most=1)


def test_stored_responses_keep_digests(spark, tmp_path):
    """A response record with a declared charset, stored digests and a URL with a line end."""
    body = "<title>été</title><p>café".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:GIVEN\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(head + block + b"\r\n\r\n"))
    got = warc.stored_responses(warc.read_warc(spark, str(tmp_path / "in.warc.gz"), binary=True))
    odd = got.withColumn("target_uri", F.lit("http://a/\r\nX: 1%"))
    records = warc.derivatives(odd, keep=()).cache()
    text = {r.warc_type: r for r in records.collect()}
    assert text["conversion"].content == "café" and text["conversion"].source_payload_digest == "sha1:GIVEN"
    assert text["conversion"].source_block_digest == warc.sha1_digest(block) and text["conversion"].refers_to == "<urn:uuid:1>"
    warc.write_warc(records, f"{tmp_path}/out")
    back = warc.read_warc(spark, f"{tmp_path}/out/part-*").collect()
    assert {r.headers["WARC-Target-URI"] for r in back} == {"http://a/%0D%0AX: 1%25"}
    assert all(r.headers["X-Source-Payload-Digest"] == "sha1:GIVEN" and "charset=iso-8859-1" in r.headers["X-Source-HTTP-Headers"] and "X" not in r.headers for r in back)
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data.count(b"\x1f\x8b\x08") >= 2  # a member for each record
    with pytest.raises(ValueError):
        warc.write_warc(records, f"{tmp_path}/out")
