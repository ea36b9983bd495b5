"""Vector queries over ``embeddings``: the label is country and topic, the id gives the day."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.functions import text as T
from lexstrata.operators import vectors as V
from lexstrata.operators.series import period_of
from lexstrata.plans.registry import query, table
from lexstrata.plans.trends import _TONE_SQL, doc_frame
from lexstrata.sources.shared import saved
from lexstrata.sources.testdata import DOCS_SQL, docs


def vecs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", (F.col("vec_id") % 60).cast("int").alias("day"), F.col("label").cast("string").alias("country"))


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, (vec_id % 60)::INT AS day, label::VARCHAR AS country FROM embeddings)"
_E = f"""{_V}, edges AS (SELECT least(a.vec_id, b.vec_id) AS i, greatest(a.vec_id, b.vec_id) AS j, list_cosine_similarity(a.e, b.e) AS sim
  FROM v a JOIN v b ON a.country <> b.country AND a.vec_id < b.vec_id AND abs(a.day - b.day) <= 14 WHERE list_cosine_similarity(a.e, b.e) >= 0.35)"""


@query("emb_topk", f"WITH {_V} SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS sim FROM v, v q WHERE q.vec_id = 0 AND v.vec_id <> 0 AND v.label < 8 ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id LIMIT 10")
def emb_topk(spark, sf_dir):
    v = vecs(spark, sf_dir)
    q = v.filter("vec_id = 0").select("embedding").first()["embedding"]
    return V.top_k(v.filter("vec_id <> 0 AND label < 8"), F.array(*map(F.lit, q)), 10).select("vec_id", F.round("sim", 6).alias("sim"))


@query("emb_topk_per_label", f"""WITH {_V}, s AS (SELECT v.vec_id, v.label, list_cosine_similarity(v.e, q.e) AS sim FROM v, v q WHERE q.vec_id = 0 AND v.vec_id <> 0)
SELECT vec_id, label, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r = 1 ORDER BY sim DESC, vec_id LIMIT 5""")
def emb_topk_per_label(spark, sf_dir):
    v = vecs(spark, sf_dir)
    q = v.filter("vec_id = 0").select("embedding").first()["embedding"]
    return V.top_k(v.filter("vec_id <> 0"), F.array(*map(F.lit, q)), 5, group="label").select("vec_id", "label", F.round("sim", 6).alias("sim"))


@query("emb_echo_edges", f"WITH {_E} SELECT i, j, round(sim, 6) AS sim FROM edges")
def emb_echo_edges(spark, sf_dir):
    return V.echo_edges(vecs(spark, sf_dir), 0.35).select("i", "j", F.round("sim", 6).alias("sim"))


_C = f"""WITH RECURSIVE {_E}, both_ AS (SELECT i AS x, j AS y FROM edges UNION ALL SELECT j, i FROM edges),
reach(x, y) AS (SELECT x, x FROM both_ UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON reach.y = both_.x), comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY 1)"""


@query("emb_components", f"{_C} SELECT node, component FROM comp")
def emb_components(spark, sf_dir):
    return V.components(V.echo_edges(vecs(spark, sf_dir), 0.35))


@query("emb_echo_clusters", f"""{_C}, m AS (SELECT comp.*, day, country FROM comp JOIN v ON vec_id = node),
s AS (SELECT component, count(*) AS size, min(day) AS first_day, max(day) AS last_day, max(day) - min(day) AS span FROM m GROUP BY 1),
f AS (SELECT component, country, min(day * 1000000 + node) AS k FROM m GROUP BY 1, 2), l AS (SELECT component, string_agg(country, '>' ORDER BY k) AS countries FROM f GROUP BY 1),
b AS (SELECT component, max(sim) AS max_sim FROM edges JOIN comp ON i = node GROUP BY 1)
SELECT component, size, countries, first_day, last_day, span, round(max_sim, 6) AS max_sim FROM s JOIN l USING (component) JOIN b USING (component)""")
def emb_echo_clusters(spark, sf_dir):
    v = vecs(spark, sf_dir)
    edges = saved(V.echo_edges(v, 0.35), "edges")
    members = V.components(edges).join(v.select(F.col("vec_id").alias("node"), "day", "country"), "node")
    return V.cluster_summary(members, edges).select("component", "size", F.array_join("countries", ">").alias("countries"), "first_day", "last_day", "span", F.round("max_sim", 6).alias("max_sim"))


@query("emb_pair_counts", f"""WITH {_E} SELECT CASE WHEN a.day <= b.day THEN a.country || '>' || b.country ELSE b.country || '>' || a.country END AS pair, count(*) AS n FROM edges JOIN v a ON a.vec_id = i JOIN v b ON b.vec_id = j GROUP BY 1""")
def emb_pair_counts(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return V.pair_counts(V.echo_edges(v, 0.35), v.select(F.col("vec_id").alias("node"), "day", "country"))


@query("emb_sim_histogram", f"WITH {_E} SELECT floor((round(sim, 6) - 0.35) / 0.05)::BIGINT AS bin, count(*) AS n FROM edges GROUP BY 1")
def emb_sim_histogram(spark, sf_dir):
    return V.histogram(V.echo_edges(vecs(spark, sf_dir), 0.35).withColumn("sim", F.round("sim", 6)), 0.35, 0.05)


_CENT = f"""{_V}, long AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM v), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM long GROUP BY 1, 2),
c0 AS (SELECT label, max(n) AS n, list(m ORDER BY pos) AS c FROM m GROUP BY 1)"""


@query("emb_label_centroids", f"WITH {_CENT} SELECT label, n, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS first, round(c[64] / sqrt(list_dot_product(c, c)), 6) AS last FROM c0")
def emb_label_centroids(spark, sf_dir):
    c = V.mean_vectors(vecs(spark, sf_dir), ["label"])
    return c.select("label", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"))


@query("emb_topic_assign", f"""WITH {_CENT}, s AS (SELECT vec_id, c0.label AS topic, list_cosine_similarity(e, c) AS sim FROM v, c0)
SELECT vec_id, topic, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS r FROM s) WHERE r = 1""")
def emb_topic_assign(spark, sf_dir):
    v = vecs(spark, sf_dir)
    c = V.mean_vectors(v, ["label"]).select(F.col("label").alias("topic"), "centroid")
    return V.assign(v, c).select("vec_id", "topic", F.round("sim", 6).alias("sim"))


@query("emb_exemplars", f"""WITH {_CENT}, s AS (SELECT vec_id, country, c0.label AS topic, list_cosine_similarity(e, c) AS sim FROM v, c0),
a AS (SELECT vec_id, country, topic, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS r FROM s) WHERE r = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, vec_id) AS p FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY topic, country ORDER BY p) AS c FROM p WHERE p <= 400),
o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN c = 1 THEN 0 ELSE 1 END, p) AS place FROM c)
SELECT topic, place::INT AS place, vec_id, country, round(sim, 6) AS sim FROM o WHERE place <= 3""")
def emb_exemplars(spark, sf_dir):
    v = vecs(spark, sf_dir)
    c = V.mean_vectors(v, ["label"]).select(F.col("label").alias("topic"), "centroid")
    return V.exemplars(V.assign(v, c)).select("topic", "place", "vec_id", "country", F.round("sim", 6).alias("sim"))


@query("emb_kmeans_topics")
def emb_kmeans_topics(spark, sf_dir):
    v = vecs(spark, sf_dir)
    k, centroids = V.fit_topics(v, (8, 10))
    return V.assign(v, centroids).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.lit(k).alias("k"))


_TOPIC = "(doc_id % 6)::INT"


@query("docs_topic_prevalence", f"""{_TONE_SQL}, d AS (SELECT country, source || '|' || lang || '|all' AS stream, CAST(date_trunc('month', date) AS DATE) AS period, {_TOPIC} AS topic FROM docs JOIN tone USING (doc_id) WHERE sample IS NULL),
cell AS (SELECT country, stream, period, topic, count(*) AS k FROM d GROUP BY ALL), tot AS (SELECT country, stream, period, count(*) AS n FROM d GROUP BY ALL), wt AS (SELECT stream, count(*) AS w FROM d GROUP BY 1),
big AS (SELECT * FROM tot JOIN wt USING (stream) WHERE n >= 5), bottom AS (SELECT country, period, sum(w) AS b FROM big GROUP BY ALL),
top AS (SELECT country, period, topic, sum(w * k * 1.0::DOUBLE / n) AS t FROM cell JOIN big USING (country, stream, period) GROUP BY ALL),
raw AS (SELECT country, period, topic, sum(k)::BIGINT AS n FROM cell GROUP BY ALL), al AS (SELECT country, period, sum(n) AS a FROM tot GROUP BY ALL)
SELECT country, period, topic, raw.n, round(raw.n::DOUBLE / a, 6) AS share, round(coalesce(t, 0) / b, 6) AS balanced FROM raw JOIN al USING (country, period) LEFT JOIN top USING (country, period, topic) LEFT JOIN bottom USING (country, period)""")
def docs_topic_prevalence(spark, sf_dir):
    d = doc_frame(spark, sf_dir).select("country", "stream", F.col("month").alias("period"), (F.col("doc_id") % 6).cast("int").alias("topic"))
    return V.prevalence(d).select("country", "period", "topic", "n", F.round("share", 6).alias("share"), F.round("balanced", 6).alias("balanced"))


@query("docs_topic_terms", f"""WITH {DOCS_SQL}, w AS (SELECT doc_id, lang, (doc_id % 6)::INT AS topic, unnest(list_distinct(list_filter(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+'), lambda x: len(x) >= 3 AND NOT regexp_matches(x, '^[0-9]{{5,}}$')))) AS word FROM docs),
d AS (SELECT lang, topic, word, count(*) AS v FROM w GROUP BY ALL), x AS (SELECT *, sum(v) OVER (PARTITION BY lang, word) AS f, sum(v) OVER (PARTITION BY lang, topic) AS total FROM d),
m AS (SELECT lang, sum(v)::DOUBLE / count(DISTINCT topic) AS mean FROM x GROUP BY 1),
r AS (SELECT lang, topic, word, row_number() OVER (PARTITION BY lang, topic ORDER BY round(v::DOUBLE / total * ln(1 + mean / f), 9) DESC, word) AS r FROM x JOIN m USING (lang) WHERE v >= 3 AND total >= 50)
SELECT lang, topic, string_agg(word, ' ' ORDER BY r) AS terms FROM r WHERE r <= 8 GROUP BY ALL""")
def docs_topic_terms(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("topic", (F.col("doc_id") % 6).cast("int"))
    return V.topic_terms(d, F.filter(T.index_terms(F.col("text")), lambda w: F.length(w) >= 3)).select("lang", "topic", F.array_join("terms", " ").alias("terms"))


@query("docs_template_titles", f"""WITH {DOCS_SQL}, k AS (SELECT doc_id, source, trim(regexp_replace(lower(title), '[^\\p{{L}}]+', ' ', 'g')) AS k FROM docs)
SELECT doc_id, count(*) OVER (PARTITION BY source, k) >= 3 AS template FROM k""")
def docs_template_titles(spark, sf_dir):
    return V.template_titles(docs(spark, sf_dir), T.title_template(F.col("title"))).select("doc_id", "template")
