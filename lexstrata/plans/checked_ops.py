"""Queries over literal rows for operators: search in several scripts, mentions, series, samples, clusters, views, streams."""

from __future__ import annotations

import datetime as dt
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import text as T
from lexstrata.operators import classify, coverage, events, gazetteer, ingest, models, passages, publish, release, sampling, search, turns, vectors, views
from lexstrata.plans.checked import fresh, rows
from lexstrata.sources import sinks
from lexstrata.streaming import events as streams

DOCS = [
    (1, "x:1", "en", "Title", "The nuclear test site was closed. Later the old treaty was signed by both states of the union.", "RU", "2024-01-03"),
    (2, "x:2", "ru", "Заявление", "Ядерное оружие и ещё один договор подписан.", "RU", "2024-01-05"),
    (3, "x:3", "zh", "核试验", "近日，核试验场关闭。", "CN", "2024-01-08"),
    (4, "x:4", "fa", "t", "جمهوری اسلامی ايران", "IR", "2024-01-09"),
    (5, "x:5", "en", "Nuclear power", "NUCLEAR energy, nothing else", "US", "2024-01-10"),
]


def corpus(s: SparkSession) -> DataFrame:
    df = s.createDataFrame(DOCS, "doc_id long, id string, lang string, title string, text string, country string, d string")
    return df.withColumn("date", F.to_date("d")).withColumn("source", F.lit("x"))


#: Queries and the documents that they find, by index and by scan.
FOUND = {
    "nuclear test": "1", "nuclear": "1,5", "nuclear AND treaty": "1", "nuclear NOT treaty": "5", "(treaty OR nothing) nuclear": "1,5", '"test site" OR договор': "1,2", "nucl*": "1,5",
    "еще": "2", "核试验": "3", "近日": "3", "近日 OR treaty": "1,3", "ایران": "4", "nuclear NEAR/10 treaty": "1", "nuclear NEAR/2 treaty": "", "test NEAR/3 closed": "1", "NEARBY OR site": "1",
}
BROKEN = ("(a", "a AND", "AND a", "a ) b OR", "NOT", "a NEAR/2 (b OR c)", '"a" OR', '"a')


def searched(s: SparkSession, indexed: bool) -> DataFrame:
    docs = corpus(s)
    index, out = search.token_index(docs) if indexed else None, None
    for q in FOUND:
        own = search.search(docs, q, index=index).agg(F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ",").alias("docs")).withColumn("q", F.lit(q))
        out = own if out is None else out.unionByName(own)
    return out


for _indexed in (False, True):
    rows("search_scripts_indexed" if _indexed else "search_scripts_scan", {"q": "VARCHAR", "docs": "VARCHAR"}, list(FOUND.items()), lambda s, i=_indexed: searched(s, i))


def readable(q: str) -> bool:
    try:
        search.parse(q)
    except ValueError:
        return False
    return True


def shape(node: search.Node) -> str:
    return node.items[0].text if node.kind == "term" else f"{node.kind}{node.n or ''}(" + ",".join(x.text if isinstance(x, search.Term) else shape(x) for x in node.items) + ")"


TREES = {"a b": "a b", "a OR b c": "or(a,and(b,c))", "a b NOT c": "and(a,not(b,c))", "(a OR b) AND c": "and(or(a,b),c)", 'x* NEAR/3 y NEAR z': "near10(x,y,z)", "a OR (b OR c)": "or(a,b,c)", '"a b" c': "and(a b,c)"}
rows("search_grammar", {"q": "VARCHAR", "tree": "VARCHAR"}, [*TREES.items(), *((q, None) for q in BROKEN)], lambda s: s.createDataFrame([(q, shape(search.parse(q)) if readable(q) else None) for q in (*TREES, *BROKEN)], "q string, tree string"))
ROUTES = {"近日 OR treaty": "union", "核试验": "cjk", "近日": "scan", "a b": "words"}
rows("search_routes", {"q": "VARCHAR", "route": "VARCHAR"}, list(ROUTES.items()), lambda s: s.createDataFrame([(q, search.plan_query(q).route) for q in ROUTES], "q string, route string"))
rows("search_stemmed", {"doc_id": "BIGINT"}, [(2,)], lambda s: search.search(corpus(s), "ядерного", stem=search.suffix_stem))
FORMS = search.Forms({"мир": ("мира", "миру"), "договор": ("договора", "договору")})
rows("search_forms", {"w": "VARCHAR", "stem": "VARCHAR"}, [("договор", "договор"), ("мир", "мир"), ("ядерного", "ядерн")], lambda s: s.createDataFrame([(w, FORMS(w)) for w in ("договор", "мир", "ядерного")], "w string, stem string"))
rows("search_spans", {"doc_id": "BIGINT", "spans": "VARCHAR"}, [(1, "{0}-{1}|{2}-{3}".format(DOCS[0][4].index("old"), DOCS[0][4].index("old") + 3, DOCS[0][4].index(" of ") + 1, DOCS[0][4].index(" of ") + 3)), (2, ""), (5, "")], lambda s: corpus(s).filter("lang IN ('en', 'ru')").select("doc_id", F.array_join(F.transform(search.hit_spans(F.col("text"), search.parse('"old" OR "of"')), lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), "|").alias("spans")))
rows("search_kwic", {"doc_id": "BIGINT", "field": "VARCHAR", "no": "INTEGER", "left": "VARCHAR", "hit": "VARCHAR", "right": "VARCHAR"}, [(5, "title", 1, "", "Nuclear", " power"), (5, "text", 1, "", "NUCLEAR", " energy,…"), (1, "text", 1, "The ", "nuclear", " test site…")], lambda s: search.hit_rows(corpus(s), search.parse("nuclear"), ["doc_id"], 12))
rows("search_snippets", {"doc_id": "BIGINT", "snips": "VARCHAR"}, [(1, "nuclear"), (5, "NUCLEAR")], lambda s: search.snippets(search.search(corpus(s), "nuclear"), search.parse("nuclear")).select("doc_id", F.array_join(F.transform("snips", lambda x: x["hit"]), "|").alias("snips")))
rows("search_hits_omitted", {"doc_id": "BIGINT", "few": "INTEGER", "many": "INTEGER"}, [(1, 1, None), (5, 2, None)], lambda s: search.with_hits(search.search(corpus(s), "nuclear"), search.parse("nuclear")).select("doc_id", F.col("hits").alias("few")).join(search.with_hits(search.search(corpus(s), "nuclear"), search.parse("nuclear"), 1).select("doc_id", F.col("hits").alias("many")), "doc_id"))

# mentions

PATS = [gazetteer.Pattern("us", "en", r"\bStates\b", veto=r"United Mexican States"), gazetteer.Pattern("us", "ru", "США"), gazetteer.Pattern("jp", "zh", "东京|日本", country="JP"), *gazetteer.SUPPLEMENT]
SAID = [
    (1, "The United Mexican States met", "en", "US"), (2, "United Mexican States; then the States", "en", "US"), (3, "США и Китай", "ru", "RU"), (4, "the States", "xx", "US"), (5, "the states", "en", "US"),
    (6, "新华社东京6月16日电 会议", "zh", "CN"), (7, "新华社东京6月16日电 日本", "zh", "JP"), (8, "German and Dutch ships left Ottawa", "en", "US"), (9, "做法方面", "zh", "CN"), (10, "法国军舰", "zh", "CN"),
]


def said(s: SparkSession) -> DataFrame:
    return gazetteer.mentions(s.createDataFrame(SAID, "doc_id int, sent string, lang string, country string"), PATS)


rows("gaz_scripts", {"doc_id": "INTEGER", "target": "VARCHAR", "self": "BOOLEAN"}, [(2, "us", False), (3, "us", False), (4, "us", False), (7, "jp", True), (8, "CANADA", False), (8, "GERMANY", False), (8, "NETHERLANDS", False), (10, "FRANCE", False)], said)


def scored(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    found = s.createDataFrame([(1, 0, "us", False), (1, 0, "us", False), (1, 1, "us", False), (1, 1, "cn", True), (2, 0, "us", False), (3, 4, "cn", False)], "doc_id int, idx int, target string, self boolean")
    return found, s.createDataFrame([(1, 0, 200), (1, 1, 400), (2, 0, 1000), (9, 0, 1)], "doc_id int, idx int, threat int")


rows("gaz_stance_salience", {"doc_id": "INTEGER", "target": "VARCHAR", "n": "BIGINT", "threat": "DOUBLE", "k": "INTEGER"}, [(1, "us", 2, 0.3, 1), (3, "cn", None, None, 1)], lambda s: gazetteer.stance_and_salience(*scored(s), ["threat"], s.createDataFrame([(1,), (3,), (1,)], "doc_id int")))
rows("gaz_counts", {"target": "VARCHAR", "country": "VARCHAR", "docs": "BIGINT", "first": "DATE", "last": "DATE"}, [("a", "RU", 2, "2024-01-01", "2024-01-05"), ("b", "RU", 1, "2024-01-05", "2024-01-05")], lambda s: gazetteer.mention_counts(s.createDataFrame([(1, "a", "RU", dt.date(2024, 1, 1)), (1, "a", "RU", dt.date(2024, 1, 1)), (2, "a", "RU", dt.date(2024, 1, 5)), (2, "b", "RU", dt.date(2024, 1, 5))], "doc_id int, target string, country string, date date"), ["target", "country"]))
rows("gaz_audit_countries", {"pat": "INTEGER", "sentences": "BIGINT", "countries": "VARCHAR"}, [(0, 4, "RU,CN")], lambda s: gazetteer.pattern_audit(s.createDataFrame([(0, "RU", 1, 0, False), (0, "RU", 1, 1, True), (0, "CN", 2, 0, False), (0, "RU", 3, 0, False)], "pat int, country string, doc_id int, idx int, self boolean"), 1))
rows("say_turns_to_scores", {"k": "INTEGER", "pair": "INTEGER", "threat": "DOUBLE", "n": "BIGINT"}, [(1, 1, 300.0, 2), (1, 2, None, 0)], lambda s: turns.pair_scores(s.createDataFrame([(1, 1, [2, 3]), (1, 2, [9])], "k int, pair int, idx array<int>"), s.createDataFrame([(1, 2, 200), (1, 3, 400), (1, 4, 900)], "k int, idx int, threat int"), "k", ["threat"]))
rows("say_labelled", {"own": "VARCHAR"}, [("Hello\nagain",)], lambda s: classify.own_words(classify.labelled_paragraphs(s.createDataFrame([(1, 0, "PUTIN: Hello"), (1, 1, "again"), (1, 2, "XI: Hi")], "k int, i int, t string"), "k", "i", "t", "^([A-Z]+):\\s*"), "k", "i", "t", "PUTIN").select(F.col("own_text").alias("own")))

# models and scores

rows("model_doc_tone", {"doc_id": "BIGINT", "nsent": "BIGINT", "threat": "DOUBLE"}, [(1, 2, 0.3), (2, 1, 1.0), (3, 0, None)], lambda s: models.doc_tone(s.range(1, 4).withColumnRenamed("id", "doc_id"), scored(s)[1].filter("doc_id < 9"), ["threat"]))
rows("model_scores_current", {"doc_id": "INTEGER", "idx": "INTEGER", "threat": "INTEGER"}, [(1, 0, 622)], lambda s: models.current(models.score_sentences(s.createDataFrame([(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [0.0, 1.0])], "doc_id int, idx int, sent string, embedding array<double>"), {"threat": ([1.0, -1.0], -0.5)}), s.createDataFrame([(1, 0, "a"), (1, 1, "changed")], "doc_id int, idx int, sent string")).drop("sent"))
rows("model_teacher", {"i": "INTEGER", "threat": "DOUBLE"}, [(1, 0.75), (2, 0.0)], lambda s: models.PatternTeacher({"threat": "threat|war"}).label(s.createDataFrame([(1, "threat of war"), (2, "tea")], "i int, sent string"), "sent").select("i", "threat"))
rows("model_newest_first", {"i": "INTEGER"}, [(3,), (2,)], lambda s: models.newest_first(s.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "i int, d string"), F.col("d"), 2))
rows("model_calibrated", {"mean": "DOUBLE"}, [(0.2,)], lambda s: (lambda z, b: z.agg(F.round(F.avg(1 / (1 + F.exp(-(F.col("z") + b)))), 6).alias("mean")))(*(lambda z: (z, sampling.calibrate_intercept(z, "z", 0.2, 0.1)))(s.range(-50, 50).select((F.col("id") / 10).alias("z")))))
rows("model_esc_balance", {"i": "INTEGER", "esc": "DOUBLE"}, [(1, 0.25), (2, None)], lambda s: s.createDataFrame([(1, 0.5, 0.25), (2, None, 0.5)], "i int, escalation double, deescalation double").select("i", models.esc_balance(F.col("escalation"), F.col("deescalation")).alias("esc")))

# series, events and views

rows("event_day_cells", {"stream": "VARCHAR", "urls": "BIGINT", "sents": "BIGINT"}, [("s", 2, 3)], lambda s: events.day_cells(s.createDataFrame([("s", "d", "u1", "a"), ("s", "d", "u1", "b"), ("s", "d", "u2", "c"), ("s", "d", "u2", "a")], "stream string, date string, u string, t string"), "u", "t"))
rows("view_tone_bands", {"c": "VARCHAR", "mean": "DOUBLE", "se": "DOUBLE", "delta_se": "DOUBLE", "n": "BIGINT"}, [("x", 0.4, 0.05, 0.05, 30)], lambda s: views.tone_bands(s.createDataFrame([("x", "a", 10, 0.2, 0.06, 0.05, 1.0, 1.0), ("x", "b", 20, 0.6, 0.08, None, None, 1.0)], "c string, stream string, n int, mean double, se double, delta double, z double, w double"), ["c"]).select("c", *(F.round(x, 9).alias(x) for x in ("mean", "se", "delta_se")), "n"))
rows("view_brief", {"alert_id": "INTEGER", "stream": "VARCHAR", "tier": "VARCHAR"}, [(1, "s", "strong"), (2, "u", "moderate")], lambda s: views.brief_selection(views.ranked_alerts(s.createDataFrame([("s", "2024-05-01", "2024-05-08", 4.0, 100, "strong", "stream"), ("t", "2023-01-01", "2023-01-02", 9.0, 100, "strong", "stream"), ("u", "2024-05-01", "2024-05-09", -3.6, 90, "moderate", "country"), ("v", "2024-05-01", "2024-05-09", 3.0, 9, "weak", "stream")], "stream string, start string, end string, z double, n int, tier string, level string"), F.lit("2024-01-01"))))
rows("view_public_alerts", {"t": "VARCHAR"}, [("strong",), ("moderate",)], lambda s: views.public_alerts(s.createDataFrame([("strong",), ("weak",), ("moderate",)], "tier string")).select(F.col("tier").alias("t")))
rows("view_evidence", {"alert_id": "INTEGER", "docs": "VARCHAR", "texts": "VARCHAR"}, [(1, "7|8", "a|-")], lambda s: views.evidence(s.createDataFrame([(1, "k")], "alert_id int, k string"), s.createDataFrame([("k", 7, 0, 0.9, "a", "official"), ("k", 7, 1, 0.8, "b", "official"), ("k", 8, 0, 0.7, "c", "media"), ("x", 9, 0, 1.0, "d", "media")], "k string, doc_id int, idx int, score double, sent string, outlet string"), ["k"], "score").select("alert_id", F.array_join(F.transform("evidence", lambda x: x["doc_id"].cast("string")), "|").alias("docs"), F.array_join(F.transform("evidence", lambda x: x["text"]), "|", "-").alias("texts")))
rows("view_passages", {"pidx": "INTEGER", "s0": "INTEGER", "s1": "INTEGER"}, [(1, 0, 2), (2, 3, 5), (3, 6, 8), (4, 9, 11)], lambda s: s.range(1).select(F.inline(passages.chunk(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("idx"), F.lit("s").alias("text"), F.lit(60).alias("ntok")))))))


def manifest_row(s: SparkSession) -> DataFrame:
    docs = corpus(s)
    return coverage.manifest({"docs": docs, "mentions": said(s)}, coverage.by_key(docs, "country", {"scored": docs.filter("lang = 'en'")}), {"gazetteer": "v1"}, {"window": "14"})


rows("view_manifest", {"docs": "BIGINT", "mentions": "BIGINT", "version": "VARCHAR", "countries": "VARCHAR"}, [(5, 8, "v1", "CN:1:0|IR:1:0|RU:2:1|US:1:1")], lambda s: manifest_row(s).select(F.col("totals")["docs"].alias("docs"), F.col("totals")["mentions"].alias("mentions"), F.col("versions")["gazetteer"].alias("version"), F.array_join(F.transform("countries", lambda c: F.concat_ws(":", c["country"], c["docs"].cast("string"), c["scored"].cast("string"))), "|").alias("countries")))
rows("view_overview", {"data_last_date": "VARCHAR", "n_strong": "BIGINT", "n_moderate": "BIGINT"}, [("2024-05-08", 1, 0)], lambda s: coverage.overview(manifest_row(s), s.createDataFrame([("strong", "2024-05-08"), ("weak", "2024-06-01")], "tier string, end string"), ["strong", "moderate"]))
rows("view_topic_months", {"country": "VARCHAR", "topic": "INTEGER", "months": "VARCHAR", "n": "VARCHAR"}, [("RU", 1, "2024-01|2024-02", "3|0"), ("RU", 2, "2024-01|2024-02", "1|4")], lambda s: coverage.topic_months(s.createDataFrame([("RU", "2024-01", 1, 3, 0.7), ("RU", "2024-01", 2, 1, 0.3), ("RU", "2024-02", 2, 4, 1.0)], "country string, period string, topic int, n int, balanced double")).select("country", "topic", F.array_join("months", "|").alias("months"), F.array_join(F.transform("n", lambda x: x.cast("string")), "|").alias("n")))

# vectors

MEMBERS = [(1, 1, 5, "RU", "official"), (1, 2, 6, "CN", "media"), (1, 3, 6, "RU", "media"), (9, 9, 1, "US", "official"), (9, 10, 2, "FR", "official"), (20, 20, 3, "US", "media"), (20, 21, 3, "US", "media")]


def members(s: SparkSession) -> DataFrame:
    return s.createDataFrame(MEMBERS, "component int, node int, day int, country string, outlet string")


rows("emb_top_clusters", {"place": "INTEGER", "component": "INTEGER", "n_members": "BIGINT", "countries": "VARCHAR", "official": "VARCHAR", "shown": "VARCHAR"}, [(1, 9, 2, "US>FR", "US>FR", "9,10"), (2, 1, 3, "RU>CN", "RU", "1,2")], lambda s: vectors.top_clusters(members(s), 2, 2).select("place", "component", "n_members", F.array_join("countries", ">").alias("countries"), F.array_join("official", ">").alias("official"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("shown")))
rows("emb_cluster_edges", {"component": "INTEGER", "a": "INTEGER", "b": "INTEGER", "sim": "DOUBLE"}, [(1, 0, 2, 0.9), (1, 1, 2, 0.8)], lambda s: vectors.cluster_edges(s.createDataFrame([(1, 3, 0.90001), (3, 2, 0.8)], "i int, j int, sim double"), members(s)))
rows("emb_counters", {"component": "INTEGER", "counts": "VARCHAR"}, [(1, "RU:2,CN:1"), (9, "FR:1,US:1"), (20, "US:2")], lambda s: vectors.counters(members(s), "component", "country").select("component", F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ",").alias("counts")))
rows("emb_echo_candidates", {"i": "INTEGER"}, [(1,), (3,), (6,)], lambda s: vectors.echo_candidates(s.createDataFrame([(1, "a", "en", "2024-01-01", "article", "x" * 60, False), (2, "a", "en", "2024-01-01", "article", "x" * 59, False), (3, "a", "zh", "2024-01-01", "article", "近" * 24, False), (4, "a", "en", None, "article", "x" * 60, False), (5, "a", "en", "2024-01-01", "briefing", "y" * 60, True), (6, "a", "en", "2024-01-01", "headline", "z" * 60, True), *((k, "a", "en", "2024-01-01", "article", "Weekly report " + "w" * 60 + f" {k}", True) for k in (7, 8, 9))], "i int, source string, lang string, date string, kind string, text string, is_title boolean"), T.title_template(F.col("text"))))
rows("emb_centred", {"i": "INTEGER", "v": "VARCHAR"}, [(1, "-1.0|0.0"), (2, "1.0|0.0"), (3, "0.6|0.8")], lambda s: vectors.centred(s.createDataFrame([(1, "en", [0.0, 2.0]), (2, "en", [4.0, 2.0]), (3, "zh", [3.0, 4.0])], "i int, lang string, embedding array<double>"), "lang", least=2).select("i", F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("string")), "|").alias("v")))

# samples, joins and work lists

rows("work_round_robin", {"i": "INTEGER", "turn": "INTEGER"}, [(1, 1), (9, 1), (2, 2), (7, 3)], lambda s: sampling.round_robin(s.createDataFrame([("a", 1, "2024-01-03"), ("a", 2, "2024-01-02"), ("b", 9, "2024-01-01"), ("a", 7, "2024-01-01")], "k string, i int, d string"), "k", "d", "i"))
rows("work_id_gaps", {"after": "INTEGER", "missing": "INTEGER"}, [(2, 4)], lambda s: sampling.id_gaps(s.createDataFrame([("a", 1), ("a", 2), ("a", 7), ("b", 9)], "k string, i int"), "i", "k"))
rows("work_balanced", {"k": "VARCHAR", "n": "BIGINT"}, [("a", 2), ("b", 1)], lambda s: sampling.balanced(s.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "k string, i int"), ["k"], 2, "i").groupBy("k").agg(F.count(F.lit(1)).alias("n")))
rows("work_deficits", {"lang": "VARCHAR", "missing": "BIGINT"}, [("zh", 5), ("fa", 3)], lambda s: sampling.language_deficits(s.createDataFrame([("en", 10), ("zh", 5)], "lang string, n long"), s.createDataFrame([("en", 8), ("zh", 10), ("fa", 3)], "lang string, n long")))
rows("work_packet_order", {"i": "INTEGER", "place": "BIGINT"}, [(k, n) for n, k in enumerate(sorted(range(1, 6), key=lambda k: (zlib.crc32(f"packet:{k}".encode()), k)), 1)], lambda s: s.createDataFrame([(r["i"], n) for n, r in enumerate(sampling.packet_order(s.createDataFrame([(k,) for k in range(1, 6)], "i int"), "i").collect(), 1)], "i int, place long"))
rows("work_coders", {"coder": "VARCHAR", "dim": "VARCHAR", "n": "BIGINT", "accuracy": "DOUBLE"}, [("x", "threat", 2, 0.5), ("y", "threat", 1, 1.0)], lambda s: sampling.coder_agreement(s.createDataFrame([("1", "x", 1), ("2", "x", 1), ("9", "x", 0), ("1", "y", 1)], "sample_id string, coder string, threat int"), s.createDataFrame([("1", 0.9), ("2", 0.1)], "sample_id string, threat double"), ["threat"]))
rows("work_complete", {"id": "VARCHAR"}, [("b",)], lambda s: ingest.complete(s.createDataFrame([("a",), ("b",)], "id string"), s.createDataFrame([("a",)], "id string")))
rows("work_backfill", {"id": "VARCHAR", "sample": "VARCHAR"}, [("1", "n"), ("2", "x")], lambda s: ingest.backfill(s.createDataFrame([("1", None), ("2", "x")], "id string, sample string"), s.createDataFrame([("1", "n"), ("2", "n")], "id string, sample string"), "id", ["sample"]))
rows("work_shards_of_all", {"shard": "INTEGER"}, [(2,)], lambda s: publish.shards_of_all(s.createDataFrame([("a", [1, 2]), ("b", [2, 3]), ("c", [2])], "token string, shards array<int>"), ["a", "b"]))
rows("work_postings_blocks", {"token": "VARCHAR", "docs": "BIGINT", "most": "BOOLEAN"}, [("x", 40, True), ("y", 1, True)], lambda s: publish.document_postings(s.range(40).select("id", F.lit("").alias("title"), F.when(F.col("id") == 3, "x y").otherwise("x").alias("text")), "id", 1.0, block=16).groupBy("token").agg(F.sum("n").alias("docs"), (F.max("n") <= 32).alias("most")))
rows("work_sizes", {"prefix": "VARCHAR", "bytes": "BIGINT", "files": "BIGINT"}, [("a", 3, 2), ("b", 4, 1)], lambda s: sinks.sizes_by_prefix(s.createDataFrame([("a/x", 1), ("a/y", 2), ("b/z", 4)], "path string, bytes long")))
rows("release_semantic", {"doc_id": "INTEGER", "nsent": "INTEGER", "topic": "INTEGER", "targets": "VARCHAR"}, [(1, 3, 7, "cn,us"), (2, None, 8, None)], lambda s: release.semantic_rows(s.createDataFrame([(1,), (2,), (4,)], "doc_id int"), s.createDataFrame([(1, 3), (3, 1)], "doc_id int, nsent int"), s.createDataFrame([(1, 7), (2, 8)], "doc_id int, topic int"), s.createDataFrame([(1, "us", False), (1, "cn", False), (1, "us", False), (2, "ru", True)], "doc_id int, target string, self boolean")).select("doc_id", "nsent", "topic", F.array_join("targets", ",").alias("targets")))
rows("release_shrunk", {"path": "VARCHAR", "action": "VARCHAR"}, [("docs/a", "refuse"), ("docs/b", "change"), ("x/c", "change"), ("new", "add"), ("same", "same"), ("tmp/d", "delete"), ("docs/e", "keep")], lambda s: release.shrunk(s.createDataFrame([("docs/a", "1", 5), ("docs/b", "1", 9), ("x/c", "1", 1), ("new", "1", 1), ("same", "s", 1)], "path string, sha string, bytes long"), s.createDataFrame([("docs/a", "2", 9), ("docs/b", "2", 5), ("x/c", "2", 9), ("same", "s", 1), ("tmp/d", "1", 1), ("docs/e", "1", 1)], "path string, sha string, bytes long"), ["docs/"], ["tmp/"]))
rows("release_line_deltas", {"file": "VARCHAR", "before": "BIGINT", "after": "BIGINT", "delta": "BIGINT"}, [("a", 3, 5, 2), ("new", 0, 1, 1)], lambda s: release.line_deltas(s.createDataFrame([("a", 3), ("b", 2)], "file string, lines long"), s.createDataFrame([("a", 5), ("b", 2), ("new", 1)], "file string, lines long")))
rows("release_log_counts", {"pattern": "VARCHAR", "n": "BIGINT"}, [("errors", 2), ("added", 1), ("none", 0)], lambda s: release.log_counts(s.createDataFrame([("ERROR x",), ("ERROR +3 docs",), ("ok",)], "value string"), {"errors": "^ERROR", "added": "\\+\\d+ docs", "none": "zzz"}))
rows("release_leaks", {"id": "VARCHAR", "leak": "VARCHAR"}, [("2", "text_differs"), ("3", "media_text"), ("4", "reprint"), ("5", "field:secret")], lambda s: release.leaks(s.createDataFrame([("1", "official", "a", None), ("2", "official", "z", None), ("3", "media", "m", None), ("4", "media", "a", None), ("5", "media", None, "k")], "id string, outlet string, text string, secret string"), s.createDataFrame([("1", "a"), ("2", "b")], "id string, text string"), ["id", "outlet", "text"]))

# streams


def appended(s: SparkSession) -> DataFrame:
    base = fresh(s)
    src, out, ck = (f"{base}/{x}" for x in ("in", "table", "ck"))
    write = lambda r: s.createDataFrame(r, "id string, v int").write.mode("append").parquet(src)
    write([("a", 1), ("b", 2)])
    schema = s.read.parquet(src).schema
    streams.append_once(streams.follow(s, src, schema), out, ck).awaitTermination()
    write([("b", 9), ("c", 4)])
    streams.append_once(streams.follow(s, src, schema), out, ck).awaitTermination()
    streams.append_once(streams.follow(s, src, schema), out, f"{ck}2").awaitTermination()  # a lost checkpoint adds nothing
    return s.read.parquet(out)


rows("stream_append_once", {"id": "VARCHAR", "v": "INTEGER"}, [("a", 1), ("b", 2), ("c", 4)], appended)
rows("stream_drop_future", {"n": "BIGINT"}, [(1,)], lambda s: streams.drop_future(s.createDataFrame([(dt.datetime(2999, 1, 1),), (dt.datetime(2024, 1, 1),)], "ts timestamp")).agg(F.count(F.lit(1)).alias("n")))
rows("stream_weeks", {"start": "TIMESTAMP", "total": "DOUBLE"}, [("2026-01-05 00:00:00", 3.0), ("2026-01-12 00:00:00", 4.0)], lambda s: streams.tumbling(s.createDataFrame([(dt.datetime(2026, 1, 7, 5), "k", 1.0), (dt.datetime(2026, 1, 11, 23), "k", 2.0), (dt.datetime(2026, 1, 12), "k", 4.0)], "ts timestamp, k string, v double"), ["k"], "v", late=None))
