"""Queries against their SQL on rows that the generated tables hardly have."""

import os

import duckdb
import pytest
from test_oracles import SF, TABLES, canon

from lexstrata.plans import catalog

PAGES = """SELECT * FROM (VALUES (0::BIGINT, 'u', '<html lang="DE"><title>a &quot;b&quot; &amp; c </title><h1>x</h1>'), (1, 'u', '<html><h1>only a heading</h1>'), (2, 'u', '<meta property="og:title" content="og"><title>t</title>'),
(3, 'u', NULL), (4, 'u', '<html lang=''de''><TITLE' || chr(10) || '>two' || chr(10) || 'lines</TITLE >x</title>'), (5, 'u', '<title>&amp;lt; <b>bold</b></title>'), (6, 'u', ''), (7, 'u', '<title>  </title>')) t(page_id, url, html)"""
DOCUMENTS = """SELECT CASE doc_id WHEN 30 THEN NULL ELSE doc_id END AS doc_id, CASE doc_id WHEN 20 THEN '' WHEN 21 THEN '   ' WHEN 22 THEN NULL WHEN 51 THEN '' WHEN 53 THEN ' ' WHEN 58 THEN '' ELSE text END AS text,
CASE doc_id WHEN 24 THEN NULL WHEN 25 THEN 'English' WHEN 26 THEN '' ELSE lang END AS lang, source, n_chars FROM documents"""


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in (("pages", PAGES), ("documents", DOCUMENTS)):
        con.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet)")
    for t in TABLES:
        if not (at / f"{t}.parquet").exists():
            os.symlink(f"{SF}/{t}.parquet", at / f"{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["ingest_reasons", "pages_title_meta", "release_accounting"])
def test_odd_rows(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    df = catalog.queries()[name](spark, odd)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracles()[name]})").fetchall()
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(canon, r)) for r in want)
