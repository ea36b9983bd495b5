"""The queries op1 to op10: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm.decontaminate import contaminated
from lexstrata.llm.exact_dedup import exact_dedup
from lexstrata.llm.language_id import held_out, identify, learn
from lexstrata.llm.license_scan import PHRASES, TEMPLATES, license_scan, words_of
from lexstrata.llm.line_dedup import line_dedup
from lexstrata.llm.near_dedup import near_dedup
from lexstrata.llm.packing import pack_documents
from lexstrata.llm.quality import quality
from lexstrata.llm.url_filter import HOST_RULES, PATTERN_RULES, compile_pattern, filter_urls
from lexstrata.llm.warc import derivatives, responses_of
from lexstrata.sources.shared import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents labelled good and not toxic."""
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return quality(_table(spark, sf_dir, "documents"), trusted)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of whole documents."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs), keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source taken out of its documents."""
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "text", "line_report.n_lines", "line_report.n_dropped")


OP5_SQL = r"""
WITH texts AS (SELECT DISTINCT coalesce(source, '') AS h, text FROM documents),
pages AS (SELECT h, count(*) AS total FROM texts GROUP BY 1),
lines AS (
  SELECT h, unnest(list_distinct([trim(x, E' \t\r') FOR x IN string_split(text, E'\n')])) AS line
  FROM texts),
counts AS (SELECT h, line, count(*) AS pages FROM lines WHERE line <> '' GROUP BY 1, 2),
bad AS (
  SELECT h, list(line) AS bad FROM counts JOIN pages USING (h)
  WHERE counts.pages >= 5 AND counts.pages > total * CAST(0.01 AS DOUBLE) GROUP BY 1),
kept AS (
  SELECT doc_id, source, text, string_split(text, E'\n') AS ls,
         [x FOR x IN string_split(text, E'\n') IF NOT list_contains(coalesce(bad, []), trim(x, E' \t\r'))] AS ks
  FROM documents LEFT JOIN bad ON coalesce(source, '') = h)
SELECT doc_id, source, CASE WHEN len(ks) < len(ls) THEN coalesce(array_to_string(ks, E'\n'), '') ELSE text END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped
FROM kept
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of whole documents."""
    return near_dedup(_table(spark, sf_dir, "documents"))


def tokenizer() -> tuple[str, str]:
    """Rank file and splitting pattern of the public byte-level BPE; the same vocabulary as ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    packed = pack_documents(_table(spark, sf_dir, "documents"), *tokenizer())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return filter_urls(_table(spark, sf_dir, "pages"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op9_sql() -> str:
    hosts = ", ".join(f"({_quoted(r)}, {_quoted(v)}, {_quoted(r.partition('/')[0])}, {_quoted('/' + r.partition('/')[2])})" for v, r in HOST_RULES)
    patterns = ", ".join(f"({i}, {_quoted(p)}, {_quoted(compile_pattern(p).regex)})" for i, p in enumerate(PATTERN_RULES))
    return rf"""
WITH hosts(rule, verdict, host, prefix) AS (VALUES {hosts}),
patterns(no, pattern, regex) AS (VALUES {patterns}),
p AS (
  SELECT page_id, coalesce(url, '') AS u, row_number() OVER () AS r,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS (
  SELECT r, arg_max(hosts.rule, length(hosts.rule)) AS rule, arg_max(hosts.verdict, length(hosts.rule)) AS verdict
  FROM p JOIN hosts ON (p.host = hosts.host OR ends_with(p.host, '.' || hosts.host)) AND starts_with(p.path, prefix) GROUP BY r),
hit AS (SELECT r, arg_min(pattern, no) AS pattern FROM p JOIN patterns ON regexp_matches(lower(u), regex) GROUP BY r)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
FROM p LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("blocks")


def _op10_sql() -> str:
    base = " UNION ALL ".join(
        f"SELECT r, i - 1 AS i, {_quoted(label)} AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE "
        + " AND ".join(f"w[i + {k}] = {_quoted(x)}" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    words = ", ".join(f"({no}, {_quoted(label)}, {_quoted(w.decode())})" for no, (label, text) in enumerate(TEMPLATES) for w in sorted(set(words_of(text))))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS w, string_split({lower}, E'\n') AS lines FROM documents),
base AS ({base}),
b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
t(no, label, word) AS (VALUES {words}),
size AS (SELECT no, label, count(*) AS n FROM t GROUP BY 1, 2),
l AS (SELECT r, unnest(range(len(lines))) AS line, unnest(lines) AS txt FROM d),
lw AS (SELECT DISTINCT r, line, unnest(regexp_extract_all(txt, '{word}')) AS word FROM l),
met AS (
  SELECT r, line, no, size.label, count(*) * 1.0::DOUBLE / any_value(size.n) AS share
  FROM lw JOIN t USING (word) JOIN size USING (no) GROUP BY r, line, no, size.label HAVING count(*) * 10 >= any_value(size.n) * 8),
m AS (SELECT r, max(share) AS share FROM met GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM met UNION ALL SELECT r, label FROM base) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(every.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN every USING (r)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derivatives(responses_of(_table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten queries by name."""
    return {
        "op1_quality": op1_quality,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_line_dedup": op5_line_dedup,
        "op6_near_dedup": op6_near_dedup,
        "op7_warc": op7_warc,
        "op8_packing": op8_packing,
        "op9_url_filter": op9_url_filter,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op2_exact_dedup": OP2_SQL, "op5_line_dedup": OP5_SQL, "op9_url_filter": _op9_sql(), "op10_license_scan": _op10_sql()}
