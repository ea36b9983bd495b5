"""Writers that never overwrite, shards and buckets, and manifests with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_buckets(postings: DataFrame, path: str, bucket: str = "bucket") -> None:
    """One folder of gzipped JSON for each bucket, sorted by token; a bucket's rows are spread by token before, so a large one has several files."""
    postings.repartition(bucket, F.pmod(F.xxhash64("token"), F.lit(4))).sortWithinPartitions(bucket, "token").write.mode("errorifexists").partitionBy(bucket).option("compression", "gzip").json(path)


def write_shards(docs: DataFrame, path: str, keys: list[str], shard: str = "shard") -> None:
    """A gzipped JSON file for each shard (of bounded size)."""
    docs.repartition(*keys, shard).sortWithinPartitions(*keys, shard).write.mode("errorifexists").partitionBy(*keys, shard).option("compression", "gzip").json(path)


def materialize(docs: DataFrame, sealed: DataFrame, path: str, keys: tuple[str, ...] = ("country", "source")) -> None:
    """Documents as files by keys; refuses if sealed ids are missing."""
    if sealed.select("id").join(docs.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("sealed ids are missing")
    docs.repartition(*keys, F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("errorifexists").partitionBy(*keys).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of every file under a path, read by the executors."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_replace("path", ".*/(?=[^/]+$)", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sizes_by_prefix(files: DataFrame) -> DataFrame:
    """Bytes by the first part of the path."""
    return files.groupBy(F.split("path", "/")[0].alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def prune(builds: DataFrame, keep: int, current: str, order: str = "name") -> DataFrame:
    """Builds that may go: all but the newest ``keep`` and the current one."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc(order)))
    return builds.withColumn("__r", rank).filter((F.col("__r") > keep) & (F.col(order) != current)).drop("__r")
