"""Views of the driver's tables in the shape of the document model.

Missing attributes are derived from keys, in the same way for Spark and DuckDB:
date from ``doc_id``, country from the source's number and the region table, outlet
from the source's number, sample from ``doc_id``, title from the first line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.plans.registry import table

OUTLETS = ("official", "state_media", "media", "commentary")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``id, country, outlet, date, sample, title, present``."""
    number = F.substring("source", 4, 9).cast("int")
    rows = table(spark, sf_dir, "documents").withColumn("no", number)
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("rk"), F.col("r_name").alias("country"))
    outlet = F.element_at(F.array(*map(F.lit, OUTLETS)), F.col("no") % 4 + 1)
    sample = F.when(F.col("doc_id") % 10 == 0, "backfill").when(F.col("doc_id") % 10 == 1, "seed")
    return rows.join(F.broadcast(region), F.col("no") % 5 == F.col("rk")).select(
        "doc_id", F.concat_ws(":", "source", "doc_id").alias("id"), "country", "source", outlet.alias("outlet"), "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 180).cast("int")).alias("date"),
        sample.alias("sample"), F.split("text", "\n")[0].alias("title"), "text", "n_chars",
    )


_INDEXES: dict[tuple, DataFrame] = {}


def docs_index(spark: SparkSession, sf_dir: str, tokens: tuple[str, ...] | None = None) -> DataFrame:
    """The token index of ``docs`` (of these tokens only, if given): built once for a session and the same input files."""
    from lexstrata.operators.search import token_index
    from lexstrata.sources.shared import stamps

    key = (spark.sparkContext.applicationId, sf_dir, stamps(spark.read.parquet(f"{sf_dir}/documents.parquet")), tokens)
    if key not in _INDEXES:
        _INDEXES[key] = token_index(docs(spark, sf_dir), tokens=tokens)
    return _INDEXES[key]


#: The same view for DuckDB, as a WITH item.
DOCS_SQL = """docs AS (
  SELECT doc_id, source || ':' || doc_id AS id, r_name AS country, source,
         ['official', 'state_media', 'media', 'commentary'][CAST(substr(source, 4) AS INT) % 4 + 1] AS outlet, lang,
         CAST(DATE '2024-01-01' + CAST(doc_id % 180 AS INT) AS DATE) AS date,
         CASE doc_id % 10 WHEN 0 THEN 'backfill' WHEN 1 THEN 'seed' END AS sample,
         string_split(text, chr(10))[1] AS title, text, n_chars
  FROM documents JOIN region ON r_regionkey = CAST(substr(source, 4) AS INT) % 5)"""


def scored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document (``doc_id, idx, text``) with six scores of 0 to 1000 from the keys."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("idx", "sent"))
    return rows.select("doc_id", "idx", "sent", *(((F.col("doc_id") * a + F.col("idx") * b + c) % 1001).alias(d) for d, a, b, c in SCORE_RULES))


#: Dimension and the coefficients of its score rule.
SCORE_RULES = (("hostility", 37, 91, 5), ("threat", 53, 17, 11), ("conciliation", 71, 29, 3), ("grievance", 13, 43, 7), ("escalation", 97, 61, 1), ("deescalation", 29, 7, 19))

SENTS_SQL = (
    "sents AS (SELECT doc_id, unnest(range(len(l)))::INT AS idx, unnest(l) AS sent FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)),\n"
    "scores AS (SELECT doc_id, idx, sent, " + ", ".join(f"(doc_id * {a} + idx * {b} + {c}) % 1001 AS {d}" for d, a, b, c in SCORE_RULES) + " FROM sents)"
)
