"""Queries with SQL against DuckDB, round trips, and properties of single parts."""

import json
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.llm import queries as q
from lexstrata.llm import warc
from lexstrata.llm.exact_dedup import exact_dedup
from lexstrata.llm.license_scan import TEMPLATES, Index, words_of
from lexstrata.llm.line_dedup import line_dedup
from lexstrata.llm.url_filter import compile_pattern

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({q.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_exact_dedup_under_collisions(spark):
    """With a digest of one hex digit, texts that share it are told apart by their content."""
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    weak = exact_dedup(df, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(weak) == key(exact_dedup(df)) and weak.filter("kept").count() == 40


def test_line_dedup_by_shuffle(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (line_dedup(df, max_ratio=0.05, min_pages=2, broadcast_rows=n) for n in (10**6, 0))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_line_dedup_counts_copies_once(spark):
    """A group of copies of over a third of a host's rows keeps its text; a line of many different pages goes, from the copies too."""
    rows = [(i, "a", "copied line\nits second line\nshare this page") for i in range(60)]
    rows += [(100 + i, "a", f"line {i}\n share this page\r\nend {i}") for i in range(80)]
    rows += [(200 + i, "small", f"only {i}\nshare this page") for i in range(4)]
    rows += [(300, "a", "share this page")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    want = {i: "copied line\nits second line" for i in range(60)} | {100 + i: f"line {i}\nend {i}" for i in range(80)}
    assert got == want | {300: ""} | {200 + i: f"only {i}\nshare this page" for i in range(4)}


words = st.lists(st.sampled_from(sorted({w for _, t in TEMPLATES for w in words_of(t)}) + [b"x%d" % i for i in range(9)]), max_size=40)


@given(words, st.integers(0, len(TEMPLATES) - 1), st.integers(0, 99))
@settings(max_examples=300, deadline=None)
def test_similarity_join_is_exact(noise, t, seed):
    frequency = {w: (hash(w) ^ seed) % 97 for _, x in TEMPLATES for w in words_of(x)}
    index = Index.build(TEMPLATES, frequency, 0.8)
    block = {*noise, *words_of(TEMPLATES[t][1])[seed % 3 :]}
    want = [i for i, (_, x) in enumerate(TEMPLATES) if 10 * len(block & set(words_of(x))) >= 8 * len(set(words_of(x)))]
    assert sorted(i for i, _ in index.matches(block)) == want


def test_license_places(spark):
    from lexstrata.llm.license_scan import license_scan

    text = "Apache License, Version 2; under the MIT-license.\nCC BY-NC cc by nc"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (14, 4, 0, 11, "apache-2,cc-by-nc,mit")


def test_pattern_tokens():
    assert compile_pattern("^spam-farm^").tokens == ("spam", "farm")
    assert compile_pattern("*spam-*farm*").tokens == ()
    assert compile_pattern("|http^x.*").tokens == ("http", "x")


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    records = warc.derivatives(warc.responses_of(pages)).cache()
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        warc.write_warc(records, path, compression)
        files = f"{path}/part-*"
        got = {r.headers["WARC-Record-ID"]: r for r in warc.read_warc(spark, files).collect()}
        assert len(got) == 80
        for r in records.collect():
            back = got[r.record_id]
            assert back.content == r.content and back.headers["WARC-Refers-To"] == r.refers_to
            assert back.headers["WARC-Block-Digest"] == warc.sha1_digest(back.content.encode()) == r.block_digest
            if r.warc_type == "metadata":
                about = json.loads(back.content)["Envelope"]
                assert about["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
                assert about["Payload-Metadata"]["HTTP-Response-Metadata"]["Entity-Digest"] == r.source_payload_digest
    by_id = {r.page_id: r for r in pages.collect()}
    for r in records.collect():
        assert r.source_payload_digest == warc.sha1_digest(by_id[r.page_id].html.encode())


def test_html_text():
    text, title, metas, links = warc.parse_html("<title>A &amp; B</title><meta name=d content='x'><p>one<br>two <b>three</b><script>var t='</p>';</script><!-- <p>no --><a href=/l>four</a><img src=\"i.png\"><p>&lt;five&gt;")
    assert (text, title) == ("one\ntwo threefour\n<five>", "A & B")
    assert metas == [{"name": "d", "content": "x"}] and [x["url"] for x in links] == ["/l", "i.png"]


def test_names_and_contract(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))
    assert os.path.exists(q.tokenizer()[0])
