"""Series queries: orders by week and month, events by day, documents by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.operators import coverage as C
from lexstrata.operators import series as S
from lexstrata.plans.registry import query, table
from lexstrata.sources.testdata import DOCS_SQL, SENTS_SQL, docs, scored_sentences


def _r(c: str, digits: int = 4):
    return F.round(F.col(c), digits).alias(c)


def _orders(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Order prices in units of 500,000 by priority and period."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stream"), S.period_of(F.col("o_orderdate"), unit).alias("p"), (F.col("o_totalprice") / 500000).alias("price"))
    return S.stream_series(rows, ["stream"], "p", ["price"])


def orders_z(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    filled = S.fill_calendar(_orders(spark, sf_dir, unit), ["stream", "metric"], unit)
    return S.rolling_z(filled, ["stream", "metric"])


def _z_sql(unit: str) -> str:
    step = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[unit]
    return f"""s AS (
  SELECT o_orderpriority AS stream, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS period, 'price' AS metric, count(*) AS n,
         avg(o_totalprice / 500000) AS mean, coalesce(stddev_samp(o_totalprice / 500000), 0) AS sd,
         coalesce(stddev_samp(o_totalprice / 500000), 0) / sqrt(greatest(count(*), 1)) AS se
  FROM orders GROUP BY 1, 2),
g AS (SELECT stream, 'price' AS metric, CAST(unnest(generate_series(lo, hi, {step})) AS DATE) AS period FROM (SELECT stream, min(period) AS lo, max(period) AS hi FROM s GROUP BY 1)),
f AS (SELECT g.stream, g.metric, g.period, coalesce(n, 0) AS n, mean, sd, se FROM g LEFT JOIN s USING (stream, period)),
b AS (
  SELECT *, avg(CASE WHEN n >= 8 THEN mean END) OVER w AS m, coalesce(stddev_samp(CASE WHEN n >= 8 THEN mean END) OVER w, 0) AS sb, count(CASE WHEN n >= 8 THEN mean END) OVER w AS k
  FROM f WINDOW w AS (PARTITION BY stream ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
z AS (
  SELECT stream, metric, period, n, mean, se, CASE WHEN ok THEN m END AS base, CASE WHEN ok THEN mean - m END AS delta,
         CASE WHEN ok THEN (mean - m) / greatest(sqrt(sb * sb + coalesce(se, 0) * coalesce(se, 0)), 0.01) END AS z
  FROM (SELECT *, n >= 8 AND mean IS NOT NULL AND k >= 6 AS ok FROM b))"""


_Z_OUT = "SELECT stream, metric, period, n, round(mean, 4) AS mean, round(base, 4) AS base, round(delta, 4) AS delta, round(z, 4) AS z FROM z"


@query("orders_week_series_z", f"WITH {_z_sql('week')} {_Z_OUT}")
def orders_week_series_z(spark, sf_dir):
    return orders_z(spark, sf_dir, "week").select("stream", "metric", "period", "n", *map(_r, ("mean", "base", "delta", "z")))


@query("orders_month_series_z", f"WITH {_z_sql('month')} {_Z_OUT}")
def orders_month_series_z(spark, sf_dir):
    return orders_z(spark, sf_dir, "month").select("stream", "metric", "period", "n", *map(_r, ("mean", "base", "delta", "z")))


_RUNS = """fl AS (SELECT *, sign(z)::INT AS dir FROM z WHERE abs(z) >= 1.5 AND abs(delta) >= 0.01),
isl AS (SELECT *, date_diff('day', DATE '1970-01-05', period) // 7 - row_number() OVER (PARTITION BY stream, dir ORDER BY period) AS island FROM fl),
runs AS (SELECT stream, dir, island, min(period) AS start, max(period) AS "end", count(*) AS n_periods, first(z ORDER BY abs(z) DESC, period) AS z, first(delta ORDER BY abs(z) DESC, period) AS delta, first(period ORDER BY abs(z) DESC, period) AS period FROM isl GROUP BY 1, 2, 3)"""


@query("orders_alert_runs", f"""WITH {_z_sql('week')}, {_RUNS}
SELECT stream, dir, period, start, "end", n_periods, round(z, 4) AS z, round(delta, 4) AS delta,
       CASE WHEN abs(z) >= 4.5 THEN 'strong' WHEN abs(z) >= 3.5 OR n_periods >= 2 THEN 'moderate' ELSE 'weak' END AS tier FROM runs""")
def orders_alert_runs(spark, sf_dir):
    runs = S.merge_runs(S.flagged(orders_z(spark, sf_dir, "week"), 1.5, 0.01), ["stream", "metric"], "week")
    return runs.select("stream", "dir", "period", "start", "end", "n_periods", _r("z"), _r("delta"), S.tier(F.col("z"), F.col("n_periods")).alias("tier"))


@query("orders_tail_check", f"""WITH {_z_sql('week')}
SELECT cut::DOUBLE AS cut, (SELECT count(*) FROM z WHERE abs(z) >= cut) AS seen, (SELECT count(z) FROM z) AS tests, e::DOUBLE AS share_expected
FROM (VALUES (3.0, 0.0026998), (3.5, 0.00046526), (4.0, 0.00006334), (4.5, 0.0000067953)) AS t(cut, e)""")
def orders_tail_check(spark, sf_dir):
    return S.tail_counts(orders_z(spark, sf_dir, "week"))


@query("orders_daily_spikes", f"""WITH {_z_sql('week')},
v AS (SELECT *, greatest(quantile_cont(delta, 0.9) OVER (PARTITION BY stream), 0.02) AS cut, count(*) OVER (PARTITION BY stream) AS valid FROM z WHERE delta IS NOT NULL)
SELECT stream, period, n, round(delta, 4) AS delta, round(z, 4) AS z, round(cut, 4) AS cut FROM v WHERE valid >= 10 AND delta >= cut AND z >= 1.5""")
def orders_daily_spikes(spark, sf_dir):
    return S.spikes(orders_z(spark, sf_dir, "week"), ["stream"]).select("stream", "period", "n", _r("delta"), _r("z"), _r("cut"))


@query("orders_qualifying_z", f"""WITH {_z_sql('month')}, q AS (SELECT * FROM s WHERE n >= 20),
x AS (SELECT stream, period, n, mean, avg(mean) OVER w AS m, stddev_pop(mean) OVER w AS d, count(mean) OVER w AS k FROM q WINDOW w AS (PARTITION BY stream ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT stream, period, n, round(mean, 4) AS mean, round(CASE WHEN k >= 6 AND d > 0 THEN (mean - m) / d END, 4) AS z FROM x""")
def orders_qualifying_z(spark, sf_dir):
    return S.qualifying_z(_orders(spark, sf_dir, "month").filter("n >= 20"), ["stream"], "mean").select("stream", "period", "n", _r("mean"), _r("z"))


@query("orders_region_combine", f"""WITH c AS (
  SELECT r_name AS country, n_name AS stream, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_totalprice / 500000 AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT country, stream, period, count(*) AS n, avg(price) AS mean, coalesce(stddev_samp(price), 0) / sqrt(count(*)) AS se FROM c GROUP BY 1, 2, 3),
wt AS (SELECT stream, sqrt(sum(n)) AS w FROM s GROUP BY 1),
g AS (SELECT country, stream, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT country, stream, min(period) AS lo, max(period) AS hi FROM s GROUP BY 1, 2)),
f AS (SELECT g.*, coalesce(n, 0) AS n, mean, se FROM g LEFT JOIN s USING (country, stream, period)),
b AS (SELECT *, avg(CASE WHEN n >= 3 THEN mean END) OVER w AS m, coalesce(stddev_samp(CASE WHEN n >= 3 THEN mean END) OVER w, 0) AS sb, count(CASE WHEN n >= 3 THEN mean END) OVER w AS k
  FROM f WINDOW w AS (PARTITION BY country, stream ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN n >= 3 AND k >= 6 THEN mean - m END AS delta, CASE WHEN n >= 3 AND k >= 6 THEN (mean - m) / greatest(sqrt(sb * sb + coalesce(se, 0) * coalesce(se, 0)), 0.01) END AS z FROM b)
SELECT country, period, round(sum(w * mean) / sum(w), 4) AS value, round(sum(CASE WHEN delta IS NOT NULL THEN w * delta END) / sum(CASE WHEN delta IS NOT NULL THEN w END), 4) AS adj_delta,
       round(sum(CASE WHEN delta IS NOT NULL THEN w * z END) / sqrt(sum(CASE WHEN delta IS NOT NULL THEN w * w END)), 4) AS z, sum(n)::BIGINT AS n, count(DISTINCT stream) AS n_streams
FROM z JOIN wt USING (stream) WHERE n >= 3 GROUP BY 1, 2""")
def orders_region_combine(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    geo = t("customer").join(F.broadcast(t("nation")), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(t("region")), F.expr("n_regionkey = r_regionkey")).select("c_custkey", F.col("r_name").alias("country"), F.col("n_name").alias("stream"))
    rows = t("orders").join(geo, F.expr("o_custkey = c_custkey")).select("country", "stream", S.period_of(F.col("o_orderdate"), "month").alias("p"), (F.col("o_totalprice") / 500000).alias("price"))
    s = S.stream_series(rows, ["country", "stream"], "p", ["price"])
    w = s.groupBy("stream").agg(F.sqrt(F.sum("n")).alias("w"))
    z = S.rolling_z(S.fill_calendar(s, ["country", "stream", "metric"], "month"), ["country", "stream", "metric"], min_n=3)
    return S.combine(z.join(w, "stream"), ["country", "period"], 3).select("country", "period", _r("value"), _r("adj_delta"), _r("z"), "n", "n_streams")


@query("orders_share_binomial", f"""WITH o AS (SELECT o_orderpriority AS stream, o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders),
t AS (SELECT stream, period, count(*) AS n FROM o GROUP BY 1, 2), h AS (SELECT stream, period, status, count(*) AS k FROM o GROUP BY 1, 2, 3),
v AS (SELECT DISTINCT stream, status FROM h),
s AS (SELECT t.stream, t.period, v.status, t.n, coalesce(h.k, 0) AS k, coalesce(h.k, 0) * 1.0::DOUBLE / t.n AS mean, sqrt(((coalesce(h.k, 0) + 0.5::DOUBLE) / (t.n + 1)) * (1 - (coalesce(h.k, 0) + 0.5::DOUBLE) / (t.n + 1)) / t.n) AS se
  FROM t JOIN v USING (stream) LEFT JOIN h USING (stream, period, status)),
g AS (SELECT stream, status, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT stream, status, min(period) AS lo, max(period) AS hi FROM s GROUP BY 1, 2)),
f AS (SELECT g.*, coalesce(n, 0) AS n, k, mean, se FROM g LEFT JOIN s USING (stream, status, period)),
b AS (SELECT *, avg(CASE WHEN n >= 5 THEN mean END) OVER w AS m, coalesce(stddev_samp(CASE WHEN n >= 5 THEN mean END) OVER w, 0) AS sb, count(CASE WHEN n >= 5 THEN mean END) OVER w AS kk
  FROM f WINDOW w AS (PARTITION BY stream, status ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT stream, status, period, n, k, round(mean, 4) AS mean,
  round(CASE WHEN n >= 5 AND mean IS NOT NULL AND kk >= 6 THEN (mean - m) / greatest(sqrt(sb * sb + pow(greatest(sqrt(greatest(m * (1 - m), 0) / n), coalesce(se, 0)), 2)), 0.01) END, 3) AS z FROM b""")
def orders_share_binomial(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stream"), F.col("o_orderstatus").alias("status"), S.period_of(F.col("o_orderdate"), "month").alias("period"))
    shares = S.share_series(o.groupBy("stream", "period", "status").agg(F.count(F.lit(1)).alias("k")), o.groupBy("stream", "period").agg(F.count(F.lit(1)).alias("n")), ["status"])
    z = S.rolling_z(S.fill_calendar(shares, ["stream", "status"], "month"), ["stream", "status"], min_n=5, binomial=True)
    return z.select("stream", "status", "period", "n", "k", _r("mean"), _r("z", 3))


@query("orders_volume_flags", """WITH m AS (SELECT o_orderpriority AS stream, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN lag(n, 3) OVER w IS NOT NULL THEN list_sort([lag(n, 1) OVER w, lag(n, 2) OVER w, lag(n, 3) OVER w])[2] END AS prior, min(period) OVER (PARTITION BY stream) AS lo, max(period) OVER (PARTITION BY stream) AS hi FROM m WINDOW w AS (PARTITION BY stream ORDER BY period))
SELECT stream, period, n, prior, CASE WHEN period = lo THEN 'start' WHEN period = hi THEN 'end' WHEN n >= 3 * prior THEN 'jump_up' WHEN n * 3 <= prior THEN 'jump_down' END AS flag FROM x""")
def orders_volume_flags(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stream"), S.period_of(F.col("o_orderdate"), "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return S.volume_flags(m, ["stream"])


@query("orders_columnar", """SELECT o_orderpriority AS stream, CAST(to_json(list(p ORDER BY p)) AS VARCHAR) AS period, CAST(to_json(list(n ORDER BY p)) AS VARCHAR) AS n
FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def orders_columnar(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stream"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return S.columnar(m, ["stream"], ["n"], "n").select("stream", F.to_json("period").alias("period"), F.to_json("n").alias("n"))


@query("events_stream_series", """SELECT event_type AS stream, CAST(date_trunc('day', ts) AS DATE) AS period, 'value' AS metric, count(*) AS n, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS sd
FROM events GROUP BY 1, 2""")
def events_stream_series(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), S.period_of(F.col("ts"), "day").alias("p"), "value")
    return S.stream_series(rows, ["stream"], "p", ["value"]).select("stream", "period", "metric", "n", _r("mean", 8), _r("sd", 8))


#: Rows of series: scored, not of an excluded sample (a null sample stays).
_TONE_SQL = f"""WITH {DOCS_SQL}, {SENTS_SQL},
tone AS (SELECT doc_id, count(*) AS nsent, avg(hostility) / 1000 AS hostility, avg(escalation - deescalation) / 1000 AS esc FROM scores GROUP BY 1)"""


def doc_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tone (mean over sentences), their stream and periods; excluded samples are gone."""
    tone = scored_sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nsent"), (F.avg("hostility") / 1000).alias("hostility"), (F.avg(F.col("escalation") - F.col("deescalation")) / 1000).alias("esc"))
    d = docs(spark, sf_dir).filter(~F.coalesce("sample", F.lit("all")).isin("backfill", "seed"))
    stream = S.stream_of(F.col("source"), F.col("lang"), F.col("sample"))
    return d.join(tone, "doc_id").select("doc_id", "country", "source", "lang", "outlet", "date", stream.alias("stream"), S.period_of(F.col("date"), "week").alias("week"), S.period_of(F.col("date"), "month").alias("month"), "nsent", "hostility", "esc")


@query("docs_stream_catalogue", f"""{_TONE_SQL}
SELECT source || '|' || lang || '|' || coalesce(sample, 'all') AS stream, count(*) AS n_docs, round(sqrt(count(*)), 4) AS weight, min(date) AS first, max(date) AS last
FROM docs JOIN tone USING (doc_id) WHERE sample IS NULL GROUP BY 1""")
def docs_stream_catalogue(spark, sf_dir):
    return C.stream_catalogue(doc_frame(spark, sf_dir)).withColumn("weight", F.round("weight", 4))


@query("docs_tone_series", f"""{_TONE_SQL}
SELECT source || '|' || lang || '|all' AS stream, CAST(date_trunc('month', date) AS DATE) AS period, count(*) AS n, round(avg(hostility), 10) AS hostility, round(avg(esc), 10) AS esc
FROM docs JOIN tone USING (doc_id) WHERE sample IS NULL GROUP BY 1, 2""")
def docs_tone_series(spark, sf_dir):
    s = S.stream_series(doc_frame(spark, sf_dir), ["stream"], "month", ["hostility", "esc"])
    return s.groupBy("stream", "period").agg(F.max("n").alias("n"), F.round(F.max(F.when(F.col("metric") == "hostility", F.col("mean"))), 10).alias("hostility"), F.round(F.max(F.when(F.col("metric") == "esc", F.col("mean"))), 10).alias("esc"))


@query("docs_coverage_by_country", f"""{_TONE_SQL}
SELECT country, count(*) AS docs, count(tone.doc_id) AS scored, min(date) AS first, max(date) AS last FROM docs LEFT JOIN tone USING (doc_id) GROUP BY 1""")
def docs_coverage_by_country(spark, sf_dir):
    return C.by_key(docs(spark, sf_dir), "country", {"scored": scored_sentences(spark, sf_dir)})


@query("docs_stale_streams", f"""WITH {DOCS_SQL} SELECT source, lang, max(date) AS last, count(*) AS n FROM docs GROUP BY 1, 2 HAVING max(date) < DATE '2024-06-25' AND count(*) >= 2""")
def docs_stale_streams(spark, sf_dir):
    return C.stale_streams(docs(spark, sf_dir), ["source", "lang"], F.lit("2024-06-25").cast("date"), 2)


@query("docs_window_coverage", f"""WITH {DOCS_SQL} SELECT country, count(*) FILTER (date BETWEEN DATE '2024-05-01' AND DATE '2024-05-31') AS now, count(*) FILTER (date BETWEEN DATE '2024-04-01' AND DATE '2024-04-30') AS prior,
 count(DISTINCT CASE WHEN date BETWEEN DATE '2024-05-01' AND DATE '2024-05-31' THEN source || '|' || lang END) AS streams FROM docs GROUP BY 1""")
def docs_window_coverage(spark, sf_dir):
    now = F.expr("date BETWEEN DATE'2024-05-01' AND DATE'2024-05-31'")
    prior = F.expr("date BETWEEN DATE'2024-04-01' AND DATE'2024-04-30'")
    return C.window_coverage(docs(spark, sf_dir), "country", now, prior, F.concat_ws("|", "source", "lang"))
