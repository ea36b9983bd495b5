"""Queries on views, passages, classification and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.functions import dates as D
from lexstrata.functions import math as M
from lexstrata.functions import text as T
from lexstrata.operators import classify as C
from lexstrata.operators import passages as P
from lexstrata.operators import views as V
from lexstrata.operators.models import doc_tone
from lexstrata.plans.registry import query, table
from lexstrata.plans.trends import orders_z
from lexstrata.operators import series as S
from lexstrata.sources.testdata import DOCS_SQL, SENTS_SQL, docs, scored_sentences

_SENT = f"WITH {DOCS_SQL}, {SENTS_SQL}"


@query("docs_passages")
def docs_passages(spark, sf_dir):
    sents = F.transform(T.sentences(F.col("text")), lambda s, i: F.struct(i.alias("idx"), s.alias("text"), F.size(F.split(s, " ")).alias("ntok")))
    p = P.passages(docs(spark, sf_dir), sents)
    return p.groupBy("pidx").agg(F.count(F.lit(1)).alias("n"), F.count_if("junk").alias("junk"), F.max("s1").alias("s1"))


@query("view_heatmap", f"""{_SENT}, c AS (SELECT country, lang, outlet, count(*) AS n, avg(hostility) / 1000 AS mean, sqrt(count(*)) AS w FROM docs JOIN scores USING (doc_id) GROUP BY 1, 2, 3),
s AS (SELECT 'all' AS scope, * FROM c UNION ALL SELECT 'official', * FROM c WHERE outlet = 'official') SELECT scope, country, lang, sum(n)::BIGINT AS n, round(sum(w * mean) / sum(w), 6) AS value FROM s GROUP BY 1, 2, 3 HAVING sum(n) >= 5""")
def view_heatmap(spark, sf_dir):
    rows = docs(spark, sf_dir).join(scored_sentences(spark, sf_dir).drop("sent"), "doc_id").groupBy("country", "lang", "outlet").agg(F.count(F.lit(1)).alias("n"), (F.avg("hostility") / 1000).alias("mean"), F.sqrt(F.count(F.lit(1))).alias("w"))
    return V.heatmap(rows, ["country", "lang"]).select("scope", "country", "lang", "n", F.round("value", 6).alias("value"))


@query("view_best_sentences", f"""{_SENT}, b AS (SELECT doc_id, idx, threat, row_number() OVER (PARTITION BY doc_id ORDER BY threat DESC, idx) AS r FROM scores) SELECT doc_id, idx, threat FROM b WHERE r = 1 ORDER BY threat DESC, doc_id LIMIT 20""")
def view_best_sentences(spark, sf_dir):
    return V.best_sentences(scored_sentences(spark, sf_dir), "threat", 20).select("doc_id", "idx", "threat")


@query("view_doc_tone", f"""{_SENT} SELECT documents.doc_id, count(scores.doc_id) AS nsent, round(avg(hostility) / 1000, 6) AS hostility, round(avg(threat) / 1000, 6) AS threat FROM documents LEFT JOIN scores USING (doc_id) GROUP BY 1""")
def view_doc_tone(spark, sf_dir):
    tone = doc_tone(table(spark, sf_dir, "documents"), scored_sentences(spark, sf_dir), ["hostility", "threat"])
    return tone.select("doc_id", "nsent", F.round("hostility", 6).alias("hostility"), F.round("threat", 6).alias("threat"))


@query("view_ranked_alerts")
def view_ranked_alerts(spark, sf_dir):
    runs = S.merge_runs(S.flagged(orders_z(spark, sf_dir, "week"), 1.5, 0.01), ["stream", "metric"], "week").withColumn("tier", S.tier(F.col("z"), F.col("n_periods")))
    ranked = V.ranked_alerts(runs, F.lit("2000-01-01").cast("date")).withColumn("level", F.lit("stream"))
    return V.brief_selection(ranked).select("alert_id", "stream", "start", "end", "tier", F.round("score", 4).alias("score"))


@query("view_quiet_streams", """SELECT DISTINCT source AS country FROM documents WHERE source NOT IN ('src1', 'src2')""")
def view_quiet_streams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("country"))
    return V.quiet(d, d.filter("country IN ('src1', 'src2')"))


@query("view_pooled_series", f"""{_SENT}, t AS (SELECT doc_id, count(*) AS nsent, avg(threat) / 1000 AS threat FROM scores GROUP BY 1), r AS (SELECT source, lang, strftime(date, '%Y-%m') AS month, nsent, threat FROM docs JOIN t USING (doc_id)),
e AS (SELECT * FROM r UNION ALL SELECT 'pooled', lang, month, nsent, threat FROM r WHERE source <> 'src3')
SELECT source, lang, month, count(*) AS docs, sum(nsent)::BIGINT AS sents, round(avg(threat), 9) AS threat_by_doc, round(sum(threat * nsent) / sum(nsent), 9) AS threat_by_sent FROM e GROUP BY 1, 2, 3""")
def view_pooled_series(spark, sf_dir):
    t = scored_sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nsent"), (F.avg("threat") / 1000).alias("threat"))
    rows = docs(spark, sf_dir).join(t, "doc_id").select("source", "lang", F.date_format("date", "yyyy-MM").alias("month"), "nsent", "threat")
    out = V.pooled(rows, ["lang", "month"], "source", ["threat"], "nsent", F.col("source") == "src3")
    return out.withColumn("threat_by_doc", F.round("threat_by_doc", 9)).withColumn("threat_by_sent", F.round("threat_by_sent", 9))


@query("view_signal_cells", f"""{_SENT}, c AS (SELECT doc_id, country, strftime(date, '%Y-%m') AS month, threat / 1000.0::DOUBLE AS v, CASE WHEN regexp_matches(trim(sent), '[?]$') THEN NULL WHEN regexp_matches(sent, '(?i)idiot|scum') THEN 'W' WHEN regexp_matches(sent, '(?i)license') THEN 'A' END AS class FROM docs JOIN scores USING (doc_id) WHERE lang = 'en')
SELECT country, month, count(DISTINCT CASE WHEN class = 'W' THEN doc_id END) AS docs_w, count(*) FILTER (class = 'W') AS sent_w, count(*) FILTER (class = 'A') AS sent_a, count(v) AS scored, count(*) FILTER (v >= 0.5) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd
FROM c WHERE class IS NOT NULL GROUP BY 1, 2""")
def view_signal_cells(spark, sf_dir):
    rows = docs(spark, sf_dir).filter("lang = 'en'").join(scored_sentences(spark, sf_dir), "doc_id")
    rows = rows.withColumn("class", C.signal(F.col("sent"), F.col("lang"), {"en": "idiot|scum"}, {"en": "license"}, {"en": "^\\b$"})).filter("class IS NOT NULL").withColumn("v", F.col("threat") / 1000)
    out = V.signal_cells(rows.withColumn("month", F.date_format("date", "yyyy-MM")), ["country", "month"], "v")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("view_daily_table", f"""{_SENT}, t AS (SELECT doc_id, avg(hostility) / 1000 AS tone, avg(threat) / 1000 AS stance FROM scores GROUP BY 1)
SELECT date, count(DISTINCT doc_id) AS n, round(sum(tone), 9) AS tone, count(*) FILTER (doc_id % 3 = 0) AS a_k, round(sum(stance) FILTER (doc_id % 3 = 0), 9) AS a_sum FROM docs JOIN t USING (doc_id) GROUP BY 1""")
def view_daily_table(spark, sf_dir):
    t = scored_sentences(spark, sf_dir).groupBy("doc_id").agg((F.avg("hostility") / 1000).alias("tone"), (F.avg("threat") / 1000).alias("stance"))
    d = docs(spark, sf_dir).select("doc_id", "date").join(t, "doc_id")
    rows = d.withColumn("target", F.lit(None).cast("string")).unionByName(d.filter("doc_id % 3 = 0").withColumn("target", F.lit("a")))
    return V.daily_table(rows, ["a"]).select("date", "n", F.round("tone", 9).alias("tone"), "a_k", F.round("a_sum", 9).alias("a_sum"))


@query("docs_kind_ladder", f"""WITH {DOCS_SQL} SELECT CASE WHEN regexp_matches(title, '(?i)^the ') THEN 'article' WHEN regexp_matches(title, '(?i)[!]{{2}}') THEN 'shout' WHEN regexp_matches(title, '[|]') THEN 'table' ELSE 'other' END AS kind, count(*) AS n FROM docs GROUP BY 1""")
def docs_kind_ladder(spark, sf_dir):
    kind = C.ladder(F.col("title"), [("^the ", "article"), ("!{2}", "shout"), ("\\|", "table")], "other")
    return docs(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("docs_topic_tags", """SELECT CASE WHEN a AND b THEN 'License; Insult' WHEN a THEN 'License' WHEN b THEN 'Insult' ELSE 'Other / General' END AS tags, count(*) AS n FROM (SELECT regexp_matches(text, '(?i)license') AS a, regexp_matches(text, '(?i)idiot|scum') AS b FROM documents) GROUP BY 1""")
def docs_topic_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(C.tags(F.col("text"), [("license", "License"), ("idiot|scum", "Insult")]).alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query("docs_two_step_filter", """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)mit license|apache license')""")
def docs_two_step_filter(spark, sf_dir):
    return C.two_steps(table(spark, sf_dir, "documents"), "text", ["license"], F.col("text").rlike("(?i)mit license|apache license")).select("doc_id")


@query("docs_first_context", """SELECT doc_id, instr(lower(text), 'license')::INT AS at FROM documents WHERE contains(lower(text), 'license')""")
def docs_first_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(C.first_context(F.col("text"), "license").isNotNull())
    return d.select("doc_id", F.regexp_instr("text", F.lit("(?i)license")).alias("at"))


@query("orders_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y') AS dmy, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def orders_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    o = o.withColumn("dmy", F.date_format("day", "dd.MM.yyyy"))
    # the written date is read back, so the column shows the parser's result
    parsed = D.dmy(F.col("dmy"))
    return o.select("o_orderkey", parsed.alias("day"), "dmy", F.date_trunc("week", parsed).cast("date").alias("week"), D.period_range(F.date_format(parsed, "yyyy-MM"))["hi"].alias("month_end"))


@query("orders_written_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS en, CAST(o_orderdate AS DATE) AS roc FROM orders""")
def orders_written_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    en = D.en_date(F.date_format("d", "MMMM d, yyyy"))
    roc = D.roc_date(F.concat_ws("/", (F.year("d") - 1911).cast("string"), F.month("d"), F.dayofmonth("d")))
    return o.select("o_orderkey", en.alias("en"), roc.alias("roc"))


@query("emb_linear_scores", """SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE * 2 - embedding[2]::DOUBLE + 0.5))), 6) AS p FROM embeddings""")
def emb_linear_scores(spark, sf_dir):
    z = M.linear(F.slice("embedding", 1, 2), [2.0, -1.0], 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.sigmoid(z), 6).alias("p"))
