"""Every operator with nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexstrata.llm import queries as q
from lexstrata.llm.decontaminate import contaminated
from lexstrata.llm.exact_dedup import exact_dedup
from lexstrata.llm.language_id import identify, learn
from lexstrata.llm.license_scan import license_scan
from lexstrata.llm.line_dedup import line_dedup
from lexstrata.llm.near_dedup import near_dedup
from lexstrata.llm.packing import pack_documents
from lexstrata.llm.quality import quality
from lexstrata.llm.url_filter import filter_urls
from lexstrata.llm.warc import derivatives, responses_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Lorem ipsum dolor sit amet consectetur. " * 30_000
PROSE = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest again today"
ROWS = [
    (1, PROSE, "en", "a", 90), (2, PROSE, "en", "a", 90), (2, PROSE, "en", "a", 90), (3, None, "en", "a", None), (4, "", "de", None, 0), (None, PROSE, None, "b", 1), (None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)), (6, "x", "en", "b", 1), (7, "\n\n \t", "fr", "b", 4), (8, "12345 !!! ???", "fr", "b", 13), (9, "\x00\x02 odd \u2028 bytes <|endoftext|> 😀", "en", "a", 5), (10, "a" * 200_000, "en", "a", 9),
]
CLASH = ("keep_id", "g", "t", "salt", "w", "__h", "__bad", "line_report", "key", "row", "words", "p", "h", "a", "b", "rep", "component_id", "score", "part", "nth", "rank", "kind", "value", "block", "data", "of", "bin", "L", "m", "s", "lang_pred", "n_shingles", "url2")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "odd bytes"), (None, PROSE), (1, PROSE)], "item_id long, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact(docs, empty):
    got = exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (2, 4, False)
    assert by[3].keep_id == 4 and by[3].group_size == 3  # null counts as empty
    assert all(r.keep_id in (2, 4) and not r.kept for r in got if r.doc_id is None)
    assert exact_dedup(empty).count() == 0


def test_exact_all_ids_null(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")
    assert [(r.keep_id, r.kept) for r in exact_dedup(df).collect()] == [(None, True)] * 2


def test_lines(docs, empty):
    out = line_dedup(docs, min_pages=2, max_ratio=0.3)
    assert set(out.columns) == set(docs.columns) and out.count() == len(ROWS)
    got = {r.doc_id: r.text for r in out.filter("doc_id IS NOT NULL").collect()}
    assert got[1] == PROSE and got[3] is None and got[5] == LONG and got[7] == "\n\n \t"
    assert line_dedup(empty).count() == 0


def test_language(docs, empty):
    model = learn(docs)
    got = {r.doc_id: r for r in identify(docs, model, keep=("doc_id",)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[8].lang_pred == "und" and got[3].score == 0
    assert got[5].lang_pred in ("en", "de", "fr") and 0 <= got[5].score <= 1
    assert identify(empty, model, keep=("doc_id",)).count() == 0
    assert {r.lang_pred for r in identify(docs, learn(empty), keep=("doc_id",)).collect()} == {"und"}


def test_near(docs, empty):
    got = near_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[3].n_shingles == by[4].n_shingles == by[7].n_shingles == 0 and by[4].component_id == 4 and by[6].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup(empty).count() == 0


def test_decontaminate(docs, bench, empty):
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert {(1, 1), (2, 1), (None, 1)} <= set(got) and got[1, 1].similarity == 1.0
    assert not any(d in (3, 4, 6, 7) for d, _ in got)
    assert contaminated(empty, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_packing(docs, empty):
    path, pattern = q.tokenizer()
    got = pack_documents(docs, path, pattern).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 1
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert pack_documents(empty, path, pattern).count() == 0


def test_quality(spark, docs, empty):
    ids = spark.createDataFrame([(1,), (2,), (5,), (6,), (None,), (9,)], "doc_id long")
    got = quality(docs, ids).collect()
    assert len(got) == len(ROWS) and all(r.perplexity is None and not r.kept for r in got if r.n_symbols == 0)
    assert quality(empty, ids).count() == 0
    assert all(r.kept for r in quality(docs, ids.limit(0)).collect() if r.n_symbols)


def test_license(docs, empty):
    assert license_scan(docs).count() == len(ROWS) and license_scan(empty).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x", "https://x.example.com/de/", None, "no scheme", "http://spam-farm.org/", "http://net", "http://y.net/", "HTTP://Q.org/fr/?a=1#b", "x://y?//net/"]
    df = spark.createDataFrame([(i, u, "c", "c", "c") for i, u in enumerate(urls)] + [(None, urls[0], "c", "c", "c"), (0, urls[0], "c", "c", "c")], "page_id long, url string, host string, rule string, `row` string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()]
    by = {g[0]: g[1:] for g in got if g[0] is not None}
    assert len(got) == len(urls) + 2
    assert by[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and by[1][2:] == ("example.com/de/", "block")
    assert by[2] == ("", "", None, "allow") == by[3] and by[4] == ("spam-farm.org", "/", None, "block")
    assert by[5] == ("net", "", None, "allow") and by[6][2] == "net/" and by[7] == ("q.org", "/fr/", "org/fr/", "allow") and by[8] == ("y", "", None, "allow")
    assert filter_urls(df.limit(0)).count() == 0


def test_warc(spark):
    df = spark.createDataFrame([(1, "http://x/", "<p>a"), (1, "http://x/", "<p>a"), (2, None, None), (None, "u", "<script>" * 2000 + "<a" * 5000), (3, "u", "")], "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    got = derivatives(responses_of(df)).collect()
    assert len(got) == 10 and [r.content for r in got if r.page_id == 2 and r.warc_type == "conversion"] == [""]
    assert derivatives(responses_of(df.limit(0))).count() == 0


def test_stages(spark, docs, empty, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, df in (("some", docs), ("none", empty)):
        left = df.select(*corpus_pipeline.COLUMNS, "lang_pred", "g") if name == "some" else df
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, left, str(tmp_path))
            path = f"{tmp_path}/{name}-{i}"
            out.write.parquet(path)
            left = spark.read.parquet(path)
            if i < 4:
                assert left.columns == list(corpus_pipeline.COLUMNS), stage
            assert left.count() >= (name == "some")
