"""Static search index: postings, shards, buckets, repeated-sentence removal and delta coding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.arrays import let
from lexstrata.functions.text import bucket_of, index_terms
from lexstrata.sources.shared import saved, small


def first_sentences(sents: DataFrame, source: str, text: str, newest: Sequence[str]) -> DataFrame:
    """Each sentence of a source once, in the row that is the largest by the columns ``newest``; repeats are combined map-side."""
    rest = [c for c in sents.columns if c not in (source, text)]
    best = F.max_by(F.struct(*rest), F.struct(*newest))
    return sents.groupBy(source, text).agg(best.alias("__x")).select(source, text, *(F.col(f"__x.{c}") for c in rest)).select(*sents.columns)


def size_shards(docs: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, limit: int) -> DataFrame:
    """Adds ``shard``: documents in order, a shard ends once it holds ``limit`` bytes or more, and at each key.

    The cut is sequential within a key, so a key (a country's year) is streamed by
    one task with constant memory, and only keys, order and sizes go through it; the
    shard numbers are joined back. ``order`` must tell the documents of a key apart.
    """
    slim = docs.select(*dict.fromkeys((*keys, *order, size))).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = slim.columns
    at, size_at = [names.index(k) for k in keys], names.index(size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, 0, 0
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            for i, (key, own) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in at)), batch.column(size_at).to_pylist())):
                if key != now:
                    now, held, shard = key, 0, 0
                out[i] = shard
                held += int(own or 0)
                if held >= limit:
                    held, shard = 0, shard + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "shard"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    on = list(dict.fromkeys((*keys, *order)))
    cuts = slim.mapInArrow(cut, StructType([*slim.schema.fields, StructField("shard", IntegerType())])).select(*(F.col(c).alias(f"__{c}") for c in on), "shard")
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return docs.join(cuts, same).drop(*(f"__{c}" for c in on))


def token_shards(docs: DataFrame, shard: str, title: str = "title", text: str = "text") -> DataFrame:
    """``token, shards, n``: sorted shard numbers of each token."""
    rows = docs.select(F.col(shard).alias("shard"), F.explode(F.array_distinct(index_terms(F.concat_ws("\n", title, text)))).alias("token")).distinct()
    return rows.groupBy("token").agg(F.array_sort(F.collect_list("shard")).alias("shards"), F.count(F.lit(1)).alias("n"))


def shard_summary(docs: DataFrame, shard: str) -> DataFrame:
    """Documents, dates, sources and languages of each shard."""
    return docs.groupBy(shard).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("lang")).alias("langs"))


def counted(terms: Column) -> Column:
    """``array<struct<token, c>>``: how often each token occurs in an array of them."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("token"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).cast("long").alias("c"))))

    return let(F.sort_array(terms), runs)


def document_postings(docs: DataFrame, key: str, common: float = 0.3, text: str = "text", title: str = "title", block: int | None = None) -> DataFrame:
    """``token, n, posts``: sorted (document, count); a token of more than ``common`` of the documents gets n = -1 and none.

    Texts are read once: a row's tokens are counted in the row, which needs no shuffle of
    every token. Counts are written to the shared folder, and document frequencies and
    lists come from them. Common tokens are taken out
    before lists are gathered. With ``block``, a list is cut into rows of at most
    ``block`` documents (column ``block``, from 0), each made by a task of its own,
    so no list grows with the corpus.
    """
    tf = docs.select(F.col(key).alias("doc"), F.inline(counted(index_terms(F.concat_ws("\n", title, text)))))
    if docs.groupBy(key).count().filter("count > 1").limit(1).count():  # a document in several rows
        tf = tf.groupBy("token", "doc").agg(F.sum("c").alias("c"))
    tf = saved(tf.select("token", "doc", "c"), "postings")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    often = df.filter(F.col("n") > total * common).select("token")
    rare = tf.join(small(often), "token", "left_anti")
    post = F.struct("doc", "c")
    if block is None:
        lists = rare.repartition("token").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(post)).alias("posts"))
    else:
        cuts = df.filter(F.col("n") <= total * common).filter(F.col("n") > block).select("token", "n")
        wide = rare.join(small(cuts), "token", "left").withColumn("__b", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") * 2 / block))))
        lists = wide.groupBy("token", F.col("__b").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(post)).alias("posts"))
    return lists.unionByName(often.select("token", F.lit(-1).cast("long").alias("n")), allowMissingColumns=True)


def delta(ids: Column) -> Column:
    """Sorted numbers as the first and the differences."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def undelta(gaps: Column) -> Column:
    return F.transform(gaps, lambda x, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))


def bucketed(postings: DataFrame, buckets: int) -> DataFrame:
    """Adds the token's ``bucket``; write partitioned by it."""
    return postings.withColumn("bucket", bucket_of(F.col("token"), buckets))


def shards_of_all(postings: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Shards that hold every token."""
    wanted = list(dict.fromkeys(tokens))
    rows = postings.filter(F.col("token").isin(wanted)).select("token", F.explode("shards").alias("shard"))
    return rows.groupBy("shard").agg(F.count_distinct("token").alias("k")).filter(F.col("k") == len(wanted)).select("shard")


def sealed(payload: Column, key: Column, iv: Column) -> Column:
    """AES-GCM with a given 12-byte iv, base 64; equal inputs give equal bytes."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), iv))


def unsealed(data: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(data), key, F.lit("GCM")).cast("string")
