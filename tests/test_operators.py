"""Hand-computed expectations for functions and operators, in scripts that the tables do not have too."""

import datetime as dt
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import dates as D
from lexstrata.functions import html as H
from lexstrata.functions import math as M
from lexstrata.functions import text as T
from lexstrata.operators import classify, gazetteer, ingest, passages, publish, release, sampling, search, series, turns, vectors, views
from lexstrata.sources import files


def one(spark, value, of, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(of(F.col("x")).alias("y")).first().y


# text

@pytest.mark.parametrize("s", ["Ёлка ещё", "كتاب يوم ۱۲٣", "plain ASCII", "近日 한국어", "", "a😀b"])
def test_norm_keeps_length(spark, s):
    assert len(one(spark, s, T.norm)) == len(s)


def test_norm_and_fold(spark):
    assert one(spark, "Ещё ёж", T.norm) == "Еще еж"
    assert one(spark, "كتاب ١٢", T.norm) == "کتاب 12"
    assert one(spark, "Éclair ŞĞ 한국", T.fold) == "eclair sg 한국"
    assert one(spark, None, T.norm) == ""


def test_tokens(spark):
    assert set(one(spark, "NNSA近日 12345 1234 Été", T.index_tokens)) == {"nnsa", "近", "日", "近日", "1234", "ete"}
    assert one(spark, "a a b", T.index_terms) == ["a", "a", "b"]


@pytest.mark.parametrize("token", ["", "a", "ab", "abc", "近日"])
def test_bucket(spark, token):
    h = 0x811C9DC5
    for c in token[:2]:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    assert one(spark, token, lambda c: T.bucket_of(c, 97)) == h % 97


def test_sentences(spark):
    assert one(spark, 'He said "Go." Then left! Ok?\nNew line. and on', T.sentences) == ['He said "Go.', "Then left!", "Ok?", "New line. and on"]
    assert one(spark, "今天。明天！好", T.sentences) == ["今天。", "明天！"]
    assert one(spark, "U.S. troops", T.sentences) == ["U.S. troops"]
    long = ", ".join(f"word{i}" for i in range(200))
    parts = one(spark, long, T.sentences)
    assert all(len(p) <= 300 for p in parts) and " ".join(parts) == long
    assert [len(p) for p in one(spark, "x" * 700, T.sentences)] == [300, 300, 100]


def test_counts_and_scope(spark):
    assert one(spark, "two words 近日", T.n_words) == 4
    assert one(spark, "近日ab", T.cjk_share) == 0.5
    df = spark.createDataFrame([(None, "headline", "t", "x", None), (None, None, "t", "t ", None), (None, None, "t", "x", "p"), ("given", None, "t", "t", None), (None, None, None, "x", None)], "g string, k string, h string, t string, c string")
    assert [r[0] for r in df.select(T.text_scope(*map(F.col, "gkhtc"))).collect()] == ["headline", "headline", "lead_p", "given", "full"]
    assert one(spark, "x20240102030405y 123", T.wayback_stamp) == "20240102030405"
    assert one(spark, "Briefing on 2 April 2026!", T.title_template) == "briefing on april"
    assert one(spark, "see https://x.y/z  now", T.clean) == "see now"


# dates

@pytest.mark.parametrize("s,want", [("March 5, 2024", (2024, 3, 5)), ("5 Mar 2024", (2024, 3, 5)), ("30 February 2024", None), ("5 мая 2024 года", (2024, 5, 5)), ("3 Şubat 2021", (2021, 2, 3)), ("05.03.2024", (2024, 3, 5)), ("2024年3月5日", (2024, 3, 5)), ("none", None)])
def test_written_dates(spark, s, want):
    assert one(spark, s, D.first_date) == (dt.date(*want) if want else None)


@pytest.mark.parametrize("s,want", [("1403/01/01", (2024, 3, 20)), ("1402/12/29", (2024, 3, 19)), ("1399/12/30", (2021, 3, 20)), ("۱۴۰۰/۰۱/۰۱", (2021, 3, 21)), ("1357/11/22", (1979, 2, 11)), ("1403/13/01", None)])
def test_jalali(spark, s, want):
    assert one(spark, s, D.jalali_text) == (dt.date(*want) if want else None)


def test_jalali_is_continuous(spark):
    days = spark.sql("SELECT y, m, d FROM (SELECT explode(sequence(1390, 1408)) y), (SELECT explode(sequence(1, 12)) m), (SELECT explode(sequence(1, 29)) d)").select("y", "m", "d", D.jalali_date(F.col("y"), F.col("m"), F.col("d")).alias("g")).orderBy("y", "m", "d").collect()
    for a, b in zip(days, days[1:]):
        assert (b.g - a.g).days == (1 if b.d > a.d else 3 if a.m <= 6 else 2 if a.m < 12 else (b.g - a.g).days) and 0 < (b.g - a.g).days <= 3


def test_other_calendars(spark):
    assert one(spark, "113年5月20日", D.roc_date) == dt.date(2024, 5, 20)
    assert one(spark, "2024-03-05T21:00:00Z", D.tehran_date) == dt.date(2024, 3, 6)
    assert one(spark, "2024-03-05T21:00:00", D.tehran_date) == dt.date(2024, 3, 5)
    d = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        D.inferred_year(F.lit(12), F.lit(30), d("2024-01-02")).alias("a"), D.reconciled(d("2024-05-01"), d("2024-01-01"), d("2024-06-01")).alias("b"), D.reconciled(d("2024-01-03"), d("2024-01-01"), d("2024-06-01")).alias("c"),
        D.term_at(d("2022-01-01"), [("2016-05-20", "x"), ("2024-05-20", "y")]).alias("d"), D.period_range(F.lit("2024-02"))["hi"].alias("e"),
    ).first()
    assert tuple(row) == (dt.date(2023, 12, 30), dt.date(2024, 1, 1), dt.date(2024, 1, 3), "x", dt.date(2024, 2, 29))


# html and files

PAGE = '<html lang="en"><head><title>T &amp; t</title><meta property="og:title" content="OG"><script type="application/ld+json">{"datePublished":"2024-01-02"}</script></head><body><div class="a"><p>One<br>1</p><div>in</div><p>Two &eacute;</p></div><a href="/x">l</a></body></html>'


def test_html(spark):
    assert one(spark, PAGE, H.title_of) == "OG" and one(spark, PAGE, H.lang_attribute) == "en" and one(spark, PAGE, H.links) == ["/x"]
    assert one(spark, PAGE, lambda c: H.json_ld(c, "datePublished")) == "2024-01-02"
    assert one(spark, PAGE, H.paragraphs) == "One 1\nTwo &eacute;"
    assert one(spark, PAGE, lambda c: H.clean_html(c, True)).split("\n") == ["T & t", "One", "1", "in", "Two é", "l"]
    assert one(spark, PAGE, lambda c: H.balanced("div")(c, F.lit('class="a"'))) == "<p>One<br>1</p><div>in</div><p>Two &eacute;</p>"
    assert one(spark, bytearray("<meta charset=gbk>近日".encode("gb18030")), H.decoded, "binary").endswith("近日")
    assert one(spark, "http://www.Ex.org:80/a/?q#f", H.canonical_url) == "https://ex.org/a"
    rules = [("disallow", "/a"), ("allow", "/a/b"), ("disallow", "/*.pdf$")]
    assert [one(spark, p, lambda c: H.robots_allowed(c, rules)) for p in ("/a/x", "/a/b/c", "/z.pdf", "/z.pdfx")] == [False, True, False, True]


def test_feeds(spark):
    xml = spark.createDataFrame([("<urlset><url><loc>http://a/?x=1&amp;y</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://b</loc></url></urlset>", "<rss><item><title><![CDATA[A b]]></title><link>http://c</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item></rss>")], "xml string, rss string")
    assert [tuple(r) for r in files.sitemap_rows(xml).collect()] == [("http://a/?x=1&y", "2024-01-01"), ("http://b", None)]
    r = files.feed_rows(xml, "rss").first()
    assert (r.title, r.link, r.published) == ("A b", "http://c", dt.datetime(2024, 3, 5, 10))
    body = spark.createDataFrame([('[{"id":1,"date_gmt":"2024-03-05T01:00:00","link":"http://w/1","title":{"rendered":"A &amp; b"},"content":{"rendered":"<p>x</p><p>y</p>"}}]',)], "body string")
    assert tuple(files.wordpress_posts(body).first()) == (1, dt.date(2024, 3, 5), "http://w/1", "A & b", "x\ny")
    tg = spark.createDataFrame([('<div data-post="ch/1"><div class="tgme_widget_message_text x">Hi<br/>you</div></div><div data-post="ch/2"></div>',)], "html string")
    assert [tuple(r) for r in files.telegram_posts(tg).collect()] == [("ch/1", "Hi\nyou"), ("ch/2", "")]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes('{"id":"s:1","source":"s","text":"é","tags":["a"],"odd":5}\nnot json\n[1]\n\n{"id":"s:2","source":"s"}\n{"id":"s:3'.encode())
    good, bad = files.read_jsonl(spark, str(path))
    assert sorted((r.id, r.extra) for r in good.collect()) == [("s:1", '{"odd":"5"}'), ("s:2", None)] and bad.count() == 3
    lines = files.complete_lines(spark, str(path)).collect()
    assert [r.line for r in lines] == [1, 2, 3, 4, 5] and lines[1].start == len(path.read_bytes().split(b"\n")[0]) + 1
    info = files.snapshot_info(spark, str(path)).first()
    assert (info.lines, info.bad_lines, info.tail_bytes) == (4, [2], len(b'{"id":"s:3'))
    (tmp_path / "ids").write_text("# mark\ns:1\n\ns:2\ns:1\n")
    assert files.read_ids(spark, str(tmp_path / "ids")).count() == 2
    a = spark.createDataFrame([("s:1", "zz", "/p/2.gz", "new"), ("s:1", "zz", "/p/legacy/9.gz", "old")], "id string, country string, file string, t string")
    b = spark.createDataFrame([("s:1", "zz", "/active", "act"), ("s:2", "zz", "/active", "act")], a.schema)
    assert {(r.id, r.t) for r in files.all_docs(a, b, ["ZZ"]).collect()} == {("s:1", "old"), ("s:2", "act")}


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿date,name\n2024-01-01 , x\n".encode())
    assert tuple(files.read_csv(spark, str(tmp_path / "a.csv"), "date string, name string").first()) == ("2024-01-01", "x")
    data = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="one"/><sheet name="two"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(data.getvalue())
    assert files.read_xlsx(spark, str(tmp_path / "b.xlsx"), "two").first()["values"] == ["hello", None, "in"]


# search

DOCS = [(1, "x:1", "en", "Title", "The nuclear test site was closed. Later the old treaty was signed by both states of the union.", "RU", "2024-01-03"), (2, "x:2", "ru", "Заявление", "Ядерное оружие и ещё договор", "RU", "2024-01-10"), (3, "x:3", "zh", "声明", "中国近日宣布核试验", "CN", "2024-02-01"), (4, "x:4", "fa", "t", "برنامه هسته‌ای ايران", "IR", "2024-02-02"), (5, "x:5", "en", "nuclear", "nothing here", "US", "2024-02-02")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, id string, lang string, title string, text string, country string, d string").withColumn("date", F.to_date("d")).withColumn("source", F.lit("x"))


@pytest.mark.parametrize("q,want", [
    ("nuclear test", {1}), ("nuclear", {1, 5}), ("nuclear AND treaty", {1}), ("nuclear NOT treaty", {5}), ("(treaty OR nothing) nuclear", {1, 5}), ('"test site" OR договор', {1, 2}), ("nucl*", {1, 5}), ("NUCLEAR", {1, 5}), ("uclear", set()),
    ("еще", {2}), ("核试验", {3}), ("近日", {3}), ("近日 OR treaty", {1, 3}), ("ایران", {4}), ("nuclear NEAR/10 treaty", {1}), ("nuclear NEAR/2 treaty", set()), ("test NEAR/3 closed", {1}),
])
def test_search(corpus, q, want):
    assert {r.doc_id for r in search.search(corpus, q).collect()} == want


@pytest.mark.parametrize("q", ["(a", "a AND", "AND a", "a ) b OR", "NOT", "a NEAR/2 (b OR c)", '"a" OR'])
def test_search_errors(q):
    with pytest.raises(ValueError):
        search.parse(q)


def test_search_parts(spark, corpus):
    assert search.plan_query("近日 OR treaty").route == "union" and search.plan_query("核试验").route == "cjk" and search.plan_query("近日").route == "scan" and search.plan_query("a b").route == "words"
    assert {r.doc_id for r in search.search(corpus, "ядерного", stem=search.suffix_stem).collect()} == {2}
    where = search.filters(country=["ru"], date_to="2024-01-05")
    assert [r.doc_id for r in search.search(corpus, "the", where).collect()] == [1]
    tree = search.parse('"the old" OR old')
    spans = corpus.filter("doc_id = 1").select(search.hit_spans(F.col("text"), tree).alias("s")).first().s
    assert [(x.s, x.e) for x in spans] == [(40, 47)]
    snip = search.snippets(corpus.filter("doc_id = 1"), search.parse("treaty"), 1).first().snips[0]
    assert snip.hit == "treaty" and snip.left.endswith("old ") and snip.right.startswith(" was")
    found, bad = search.term_report(corpus, [("a", "nuclear"), ("b", "(")])
    assert {(r.label, r.doc_id) for r in found.collect()} == {("a", 1), ("a", 5)} and list(bad) == ["b"]
    assert search.read_terms(["## g", "# no", "x | a OR b", "plain"]) == [("g", "x", "a OR b"), ("g", "plain", "plain")]
    assert [tuple(r) for r in search.count_by(corpus.withColumn("hits", F.lit(2)), "week").orderBy("bucket").collect()][0] == ("2024-01-01", 1, 2)


# series

def test_rolling_z(spark):
    weeks = [dt.date(2026, 1, 5) + dt.timedelta(7 * i) for i in range(20)]
    rows = [("s", w, 30, 0.4 if i == 15 else 0.2 + 0.01 * (i % 2), 0.01) for i, w in enumerate(weeks)]
    df = spark.createDataFrame(rows, "stream string, period date, n int, mean double, se double")
    z = {r.period: r for r in series.rolling_z(df, ["stream"]).collect()}
    assert z[weeks[5]].z is None and z[weeks[15]].z > 3 and abs(z[weeks[10]].z) < 2
    low = df.withColumn("n", F.when(F.col("period") == F.lit(weeks[15]), 3).otherwise(F.col("n")))
    assert {r.period: r for r in series.rolling_z(low, ["stream"]).collect()}[weeks[15]].z is None
    flat = spark.createDataFrame([("s", w, 14, 0.25 if i < 10 else 0.0, 0.0) for i, w in enumerate(weeks[:11])], df.schema)
    got = {r.period: r.z for r in series.rolling_z(flat, ["stream"], binomial=True).collect()}[weeks[10]]
    assert math.isclose(got, -0.25 / math.sqrt(0.25 * 0.75 / 14))


def test_calendar_runs_and_tiers(spark):
    df = spark.createDataFrame([("s", dt.date(2026, 1, 5), 10), ("s", dt.date(2026, 1, 26), 10)], "stream string, period date, n int")
    assert [r.n for r in series.fill_calendar(df, ["stream"], "week").orderBy("period").collect()] == [10, 0, 0, 10]
    rows = [("s", dt.date(2026, 1, 5), 3.5, 0.05), ("s", dt.date(2026, 1, 12), 4.0, 0.06), ("s", dt.date(2026, 1, 19), 1.0, 0.06), ("s", dt.date(2026, 1, 26), 5.0, 0.01)]
    runs = series.merge_runs(series.flagged(spark.createDataFrame(rows, "stream string, period date, z double, delta double")), ["stream"], "week").collect()
    assert len(runs) == 1 and (runs[0].z, runs[0].n_periods, runs[0].start, runs[0].end) == (4.0, 2, dt.date(2026, 1, 5), dt.date(2026, 1, 12))
    t = lambda z, n: spark.range(1).select(series.tier(F.lit(z), F.lit(n))).first()[0]
    assert [t(-4.6, 1), t(3.6, 1), t(3.1, 2), t(3.1, 1)] == ["strong", "moderate", "moderate", "weak"]


def test_composition_shift_is_no_tone_shift(spark):
    rows = [("a", "c", "p1", 50, 0.2, 0.0, 0.0, 1.0), ("b", "c", "p1", 50, 0.6, 0.0, 0.0, 1.0), ("a", "c", "p2", 5, 0.2, 0.0, 0.0, 1.0), ("b", "c", "p2", 95, 0.6, 0.0, 0.0, 1.0)]
    out = series.combine(spark.createDataFrame(rows, "stream string, country string, period string, n int, mean double, delta double, z double, w double"), ["country", "period"], 3).collect()
    assert {r.value for r in out} == {0.4} and all(r.adj_delta == 0 for r in out)


# the rest

def test_gazetteer_veto(spark):
    pats = [gazetteer.Pattern("us", "en", r"\bStates\b", veto=r"United Mexican States"), gazetteer.Pattern("us", "ru", r"США")]
    df = spark.createDataFrame([(1, "The United Mexican States met", "en"), (2, "United Mexican States; then the States", "en"), (3, "США и Китай", "ru"), (4, "the States", "xx"), (5, "the states", "en")], "doc_id int, sent string, lang string").withColumn("country", F.lit("US"))
    assert {r.doc_id for r in gazetteer.mentions(df, pats).collect()} == {2, 3, 4}


def test_passages(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("idx"), F.lit("s").alias("text"), F.lit(60).alias("ntok"))).alias("s"))
    assert [(c.pidx, c.s0, c.s1) for c in df.select(passages.chunk(F.col("s")).alias("c")).first().c] == [(1, 0, 2), (2, 3, 5), (3, 6, 8), (4, 9, 11)]


def test_turns(spark):
    text = "Reporter: One?\nmore?\nSpokesperson: Yes.\nindeed.\nReporter: Two?\nSpokesperson: No."
    lines = spark.createDataFrame([(1, text)], "k int, t string").select("k", F.explode(turns.classify_lines(F.col("t"), "Reporter", "Spokesperson")).alias("x")).select("k", "x.*")
    pairs = turns.qa_pairs(turns.fill_turns(lines, "k", "line"), "k", "line", "rest").orderBy("pair").collect()
    assert [(p.question, p.answer) for p in pairs] == [("One?\nmore?", "Yes.\nindeed."), ("Two?", "No.")]


@pytest.mark.parametrize("codes,alpha", [([(1, [0, 0]), (2, [1, 1]), (3, [0, 0])], 1.0), ([(1, [0, 1]), (2, [1, 0]), (3, [0, 1])], -0.6667), ([(1, [1, 1]), (2, [1, 1])], None), ([(1, [0, 0, 1]), (2, [1, 1, 1]), (3, [0, None, 0])], 0.5)])
def test_krippendorff(spark, codes, alpha):
    long = spark.createDataFrame([(u, v) for u, vs in codes for v in vs], "unit int, value int")
    got = sampling.krippendorff(long).first().alpha
    if alpha == 0.5:  # against the definition
        units = [[v for v in vs if v is not None] for _, vs in codes]
        n = sum(map(len, units))
        do = sum((a != b) / (len(u) - 1) for u in units for i, a in enumerate(u) for j, b in enumerate(u) if i != j)
        every = [v for u in units for v in u]
        de = sum(a != b for i, a in enumerate(every) for j, b in enumerate(every) if i != j) / (n - 1)
        alpha = 1 - do / de
    assert got is None if alpha is None else round(got, 4) == round(alpha, 4)


def test_sampling(spark):
    df = spark.range(5000).select(sampling.held_out(F.col("id")).alias("h"))
    assert 0.17 < df.filter("h").count() / 5000 < 0.23
    import zlib

    assert one(spark, 77, lambda c: sampling.held_out(c), "long") == (zlib.crc32(b"77") % 1000 < 200)
    order = [r[0] for r in spark.range(16).select(sampling.bit_reversed(F.col("id"), 4)).collect()]
    assert sorted(order) == list(range(16)) and order[:4] == [0, 8, 4, 12]
    sizes = spark.createDataFrame([("a", 100), ("b", 25), ("c", 4)], "k string, n int")
    assert sum(r.seats for r in sampling.allocate(sizes, 10, "k").collect()) == 10
    auc = sampling.auc(spark.createDataFrame([("k", 0.1, 0), ("k", 0.4, 0), ("k", 0.4, 1), ("k", 0.8, 1)], "k string, s double, y int"), "s", "y", ["k"]).first().auc
    assert auc == 0.875


def test_soft_labels(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, [float(i % 10), 1.0], min(max((i % 10) / 10, 0.05), 0.95)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x array<double>, p double").withColumn("f", array_to_vector("x"))
    model, reg = sampling.fit_soft(df, "f", "p", "k", (0.001, 1.0))
    assert model.coefficients[0] > 0.3 and reg == 0.001
    z = spark.createDataFrame([(float(i) / 10,) for i in range(-50, 50)], "z double")
    b = sampling.calibrate_intercept(z, "z", 0.2)
    assert abs(sum(1 / (1 + math.exp(-(i / 10 + b))) for i in range(-50, 50)) / 100 - 0.2) < 0.01


def test_ingest(spark, tmp_path):
    base = dict(id="s:1", country="RU", source="s", lang="ru", date="2024-01-01", url="https://x", text="t", outlet="official", fetched=None)
    cases = [({}, None), ({"text": " "}, "missing:text"), ({"id": "z:1"}, "id_not_prefixed_by_source"), ({"date": "2024-02-30"}, "date_invalid"), ({"date": "1.1.2024"}, "date_not_iso"), ({"date": "2199-01-01"}, "date_implausible"), ({"lang": "Russian"}, "bad_lang"), ({"url": "x"}, "bad_url"), ({"outlet": None}, "bad_outlet"), ({"fetched": "??"}, "bad_fetched")]
    schema = ", ".join(f"{k} string" for k in base)
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], schema)
    assert [r[0] for r in df.select(ingest.reason()).collect()] == [w for _, w in cases]
    parts, manifest = f"{tmp_path}/parts", f"{tmp_path}/manifest"
    rows = spark.createDataFrame([("s:1", "a"), ("s:2", "b")], "id string, text string")
    assert ingest.seal(rows, parts, manifest, "2024-01")["n"] == 2
    ingest.seal(spark.createDataFrame([("s:2", "later"), ("s:3", "c")], rows.schema), parts, manifest, "2024-02")
    assert sorted(r.id for r in ingest.sealed_docs(spark, manifest).collect()) == ["s:1", "s:2", "s:3"]
    fill = ingest.backfill(spark.createDataFrame([("1", None), ("2", "x")], "id string, sample string"), spark.createDataFrame([("1", "n"), ("2", "n")], "id string, sample string"), "id", ["sample"])
    assert {tuple(r) for r in fill.collect()} == {("1", "n"), ("2", "x")}


def test_release(spark, tmp_path):
    ok = spark.createDataFrame([("official", "x" * 300), ("media", None)], "outlet string, text string")
    release.assert_public_safe(ok)
    for bad in (("media", "x"), ("official", "x" * 301), (None, "x")):
        with pytest.raises(ValueError):
            release.assert_public_safe(spark.createDataFrame([bad], ok.schema))
    df = spark.createDataFrame([("2024-01-02", "s", "b"), ("2024-01-01", "s", "a")], "date string, source string, id string")
    release.write_release(df, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        release.write_release(df, f"{tmp_path}/r")


def test_publish(spark):
    docs = spark.createDataFrame([("a", i, 40) for i in range(5)] + [("b", 9, 10)], "k string, i int, size int")
    assert [(r.k, r.i, r.shard) for r in publish.size_shards(docs, ["k"], ["i"], "size", 70).orderBy("k", "i").collect()] == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 9, 0)]
    ids = one(spark, [3, 7, 20], publish.delta, "array<long>")
    assert ids == [3, 4, 13] and one(spark, ids, publish.undelta, "array<long>") == [3, 7, 20]
    key, iv = F.lit(b"0123456789abcdef"), F.lit(b"012345678901")
    assert one(spark, "secret", lambda c: publish.unsealed(publish.sealed(c.cast("binary"), key, iv), key)) == "secret"


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0, "a"), (2, [1.0, 0.1], 10, "b"), (3, [1.0, 0.0], 14, "b"), (4, [1.0, 0.0], 15, "b"), (5, [1.0, 0.0], 3, "a")], "vec_id long, embedding array<double>, day int, country string")
    assert sorted((r.i, r.j) for r in vectors.echo_edges(rows, 0.99).collect()) == [(1, 2), (1, 3), (2, 5), (3, 5), (4, 5)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (8, 9)], "i long, j long")
    assert {r.node: r.component for r in vectors.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert abs(spark.range(1).select(M.normal_cdf(F.lit(1.96))).first()[0] - 0.975) < 1e-3


def test_classify_and_views(spark):
    assert one(spark, "MIT License idiot", lambda c: classify.tags(c, [("license", "L"), ("idiot", "I")])) == "L; I"
    assert one(spark, "zzz", lambda c: classify.tags(c, [("license", "L")])) == "Other / General"
    sig = lambda s: one(spark, s, lambda c: classify.signal(c, F.lit("en"), {"en": "strike"}, {"en": "nuclear"}, {"en": "^why"}))
    assert [sig("nuclear strike"), sig("nuclear power"), sig("nuclear strike?"), sig("why nuclear")] == ["W", "A", None, None]
    df = spark.createDataFrame([(1, 0, "PUTIN: Hello"), (1, 1, "again"), (1, 2, "XI: Hi")], "k int, i int, t string")
    said = classify.labelled_paragraphs(df, "k", "i", "t", "^([A-Z]+):\\s*")
    assert classify.own_words(said, "k", "i", "t", "PUTIN").first().own_text == "Hello\nagain"
    assert "| 1 | a\\|b |" in views.markdown(spark.createDataFrame([(1, "a|b")], "n int, t string"), "T")


def test_series_across_streams(spark):
    alerts = spark.createDataFrame([("s", "2024-05-01", "2024-05-08", 4.0, 100, "strong"), ("t", "2023-01-01", "2023-01-02", 9.0, 100, "strong")], "stream string, start string, end string, z double, n int, tier string")
    ranked = views.ranked_alerts(alerts, F.lit("2024-01-01")).orderBy("alert_id").collect()
    assert [r.stream for r in ranked] == ["s", "t"]


def test_parsers(spark):
    from lexstrata.operators.parsers import parse_pages

    page = '<title>T</title><script type="application/ld+json">{"datePublished":"2024-03-05T10:00","author":{"name":"N"}}</script><article><p>a &amp; b<p>c</article>'
    df = spark.createDataFrame([("x", page), ("mine", "zz"), ("x", None)], "site string, html string")
    got = [r.parsed for r in parse_pages(df, "site", parsers={"mine": lambda p: {"title": p.upper()}}).collect()]
    assert (got[0].title, got[0].date, got[0].text, got[0].speaker) == ("T", "2024-03-05", "a & b\nc", "N")
    assert got[1].title == "ZZ" and got[2].title is None


def test_verbatim(spark):
    docs = spark.createDataFrame([(1, "xx one two three four yy"), (2, "one two"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ne two three fo"), (2, "one two"), (3, ""), (4, None), (5, "zz two three four")], "item_id long, needle string")
    assert sorted(map(tuple, search.verbatim(docs, items).collect())) == [(1, 1), (1, 2), (2, 2)]


def test_echo_edges_of_many_blocks(spark):
    """Tasks are pairs of blocks of bounded size; rows with nulls have no edge."""
    import numpy as np

    n, rng = 90, np.random.default_rng(3)
    e = rng.normal(size=(n, 5)).astype("float32")
    e[7] = 0
    rows = [(i, i * 7 % 40, f"c{i % 3}", [float(x) for x in e[i]]) for i in range(n)] + [(900, 3, None, [1.0] * 5), (901, None, "c1", [1.0] * 5), (902, 3, "c1", None), (903, 3, "c1", [1.0, None, 1.0, 1.0, 1.0]), (904, 3, "c9", [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, day int, country string, embedding array<float>")
    got = {(r.i, r.j): r.sim for r in vectors.echo_edges(df, 0.5, block=8).collect()}
    unit = e.astype("float64") / np.maximum(np.linalg.norm(e.astype("float64"), axis=1, keepdims=True), 1e-300)
    sims = unit @ unit.T
    want = {(i, j): sims[i, j] for i in range(n) for j in range(i + 1, n) if i % 3 != j % 3 and abs(i * 7 % 40 - j * 7 % 40) <= 14 and sims[i, j] >= 0.5}
    assert len(got) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert vectors.echo_edges(df.limit(0), 0.5).count() == 0


def test_cluster_summary_orders_countries(spark):
    members = spark.createDataFrame([(1, 1, 5, "b"), (2, 1, 5, "a"), (3, 1, 2, "c"), (4, 1, 9, "b")], "node long, component long, day int, country string")
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (3, 4, 0.6)], "i long, j long, sim double")
    r = vectors.cluster_summary(members, edges).first()
    assert (r["size"], r["countries"], r["first_day"], r["last_day"], r["span"], r["max_sim"]) == (4, ["c", "b", "a"], 2, 9, 7, 0.7)


def test_parse_pages_in_pieces(spark):
    """Rows, order and nulls survive however a batch is cut; values that are no text become text."""
    from lexstrata.operators.parsers import parse_pages

    pages = [(k, None if k == 5 else "" if k == 6 else f"<title>t{k}</title><p>{'x' * k}</p>") for k in range(40)] + [(40, '<script type="application/ld+json">{"headline": 7, "author": {"name": 8}}</script>')]
    df = spark.createDataFrame(pages, "page_id long, html string").coalesce(1)
    got = {r.page_id: r.parsed for r in parse_pages(df, piece=60).collect()}
    assert len(got) == 41 and all(got[k].title == f"t{k}" and got[k].text == f"t{k}" + f"\n{'x' * k}" * bool(k) for k in range(40) if k not in (5, 6))
    assert set(got[5]) == set(got[6]) == {None} and (got[40].title, got[40].speaker) == ("7", "8")


def test_token_index_of_some_tokens(spark):
    docs = spark.createDataFrame([(1, "Apache", "apache License of 1"), (2, "t", "licensé, license"), (3, "", None)], "doc_id long, title string, text string")
    rows = {(r.token, r.doc): r.tf for r in search.token_index(docs, tokens=["license", "apache"]).collect()}
    assert rows == {("", 1): 5, ("", 2): 3, ("", 3): 0, ("apache", 1): 2, ("license", 1): 1, ("license", 2): 2}
    whole = {(r.token, r.doc): r.tf for r in search.token_index(docs).collect()}
    assert rows == {k: v for k, v in whole.items() if k[0] in ("", "license", "apache")}


def test_postings_count_in_rows(spark):
    assert one(spark, ["b", "a", "b"], lambda c: F.array_sort(publish.counted(c)), "array<string>") == [("a", 1), ("b", 2)]
    assert one(spark, [], publish.counted, "array<string>") == []
    docs = spark.createDataFrame([(1, "x", "y x"), (2, "y", "z"), (1, "", "x"), (3, "", None)], "doc_id long, title string, text string")
    got = {r.token: (r.n, [tuple(p) for p in r.posts]) for r in publish.document_postings(docs, "doc_id", common=0.9).collect()}
    assert got == {"x": (1, [(1, 3)]), "y": (2, [(1, 1), (2, 1)]), "z": (1, [(2, 1)])}
