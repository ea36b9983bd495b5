"""Exact dedup by skew-safe combining.

Equal texts are combined in three steps, and each compares the full content:

1. every map task combines its own rows (the partial aggregation, keyed by
   digest, salt and text);
2. salted digest groups are merged (the final aggregation of the same keys), so
   a text that fills a third of the table is spread over ``salts`` tasks;
3. the at most ``salts`` winners of a digest are combined globally, again keyed
   by digest and text.

The winners go back to the rows by (digest, salt), so no task sees all copies of
a hot text. Digests only route rows: where two texts share one, their rows are
joined by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import salt_of, written


def sha256_of(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text, 256)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int | None = None,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Nulls and edge cases: a null text counts as empty, so null and empty texts
    are copies of each other. Of equal texts the largest id is kept; a null id is
    smaller than any other, and where all ids of a group are null ``keep_id`` is
    null and every row is kept. Rows that repeat both id and text all carry the
    group's ``keep_id`` and are all marked kept if that is their id. An empty
    table gives an empty result. Other columns of ``df`` are not read.

    ``salts`` defaults to one for every 8 shuffle partitions (16 at least), so the
    share of a hot text that meets in a task shrinks with the cluster. Rows with a
    null id, which have no hash of their own, fetch their winner under salts by
    their place in the table.
    """
    salts = salts or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", digest(F.col("t")).alias("g"), salt_of(F.col("doc_id"), salts).alias("salt"))
    merged = rows.groupBy("g", "salt", "t").agg(F.max("doc_id").alias("w"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("loose"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    dealt = lambda of: of.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.col("salt")))

    def winners(of: DataFrame) -> DataFrame:
        # dealt by the digest alone, so that texts which share one meet in a task
        return of.repartition("g").groupBy("g", "t").agg(F.max("w").alias("keep_id"), F.sum("n").alias("group_size"), F.when(F.sum("loose") > 0, every).otherwise(F.collect_set("salt")).alias("salts"))

    by_digest = (
        winners(merged)
        .groupBy("g")
        .agg(F.count(F.lit(1)).alias("variants"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.flatten(F.collect_list("salts")).alias("salts"))
    )
    lookup = written(by_digest.select("g", "variants", "keep_id", "group_size", F.explode(F.array_distinct("salts")).alias("salt")), "exact-winners")
    shared = lookup.filter("variants > 1").select("g").distinct()
    plain = rows.select("doc_id", "g", "salt", *([] if digest is sha256_of else [F.sha2("t", 256).alias("sha")]))
    found = dealt(plain).join(lookup.filter("variants = 1"), ["g", "salt"])
    if lookup.filter("variants > 1").limit(1).count():
        clash = winners(merged.join(shared, "g", "left_semi")).select("g", "t", "keep_id", "group_size", F.explode("salts").alias("salt"))
        more = dealt(rows).join(clash, ["g", "salt", "t"])
        found = found.unionByName(more.withColumn("sha", F.sha2("t", 256)), allowMissingColumns=True)
    sha = F.col("g") if digest is sha256_of else F.col("sha")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


