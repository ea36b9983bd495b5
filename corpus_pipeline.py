"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Part of the subpackage ``lexstrata.llm``. Each stage takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm.common import maybe_broadcast, written
from lexstrata.llm.decontaminate import contaminated
from lexstrata.llm.language_id import UNKNOWN, identify, learn, least_scores
from lexstrata.llm.line_dedup import line_dedup
from lexstrata.llm.near_dedup import near_dedup
from lexstrata.llm.packing import pack_documents
from lexstrata.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The least score of a language that no held-out row has.
LEAST_SCORE = 0.2
#: Near copies are judged by shingles of five words.
SHINGLE = 5


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one column of ``gone``."""
    gone = written(gone.toDF("__gone").distinct(), "gone")
    side = maybe_broadcast(gone, gone.count())
    return docs.join(side, F.col(key) == F.col("__gone"), "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language: without a letter, or farther from every profile than held-out texts of the language are."""
    docs = docs.select(*COLUMNS)
    found = written(identify(docs, learn(docs), keep=COLUMNS, lang_name="__lang", score_name="__score"), "scored")
    least = F.lit(LEAST_SCORE)
    for lang, score in sorted(least_scores(found, "__lang", "__score").items()):
        least = F.when(F.col("__lang") == lang, score).otherwise(least)
    return found.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's boilerplate lines out of the texts; every document stays."""
    return line_dedup(docs.select(*COLUMNS), report=None).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: the id where only one row has it; rows with a null or repeated id get numbers beyond all ids.

    Such rows are rare, so the table is written anew only if there are any.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = written(ids.filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id"), F.lit(True).alias("__odd")), "odd-ids")
    n = odd.count()
    if not n:
        return docs.withColumn("__key", F.col("doc_id"))
    top = docs.agg(F.max("doc_id").alias("m")).first()["m"] or 0
    marked = docs.join(maybe_broadcast(odd, n), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    fresh = F.lit(top + 1) + F.monotonically_increasing_id()
    return written(marked.withColumn("__key", F.when(F.col("__odd"), fresh).otherwise(F.col("doc_id"))).select(*COLUMNS, "__key"), "keyed")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies (five words a shingle). Rows are told apart, whatever their ids."""
    docs = keyed(docs.select(*COLUMNS))
    found = near_dedup(docs, id_col="__key", words_in=SHINGLE)
    return without(docs, "__key", found.filter("NOT kept").select("doc_id")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Texts are told apart by their digest, so ids don't matter."""
    docs = docs.select(*COLUMNS).withColumn("__text", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__text")
    return without(docs, "__text", found.select("doc_id")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    packed = pack_documents(docs, *tokenizer())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenising and the approximate index have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
