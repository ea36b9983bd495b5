"""Tables in the folder that driver and executors share: cut lineage, survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Rows that any broadcast side may have at most; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and the master is local (tests, bench), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="lexstrata-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; ``dropped`` deletes it again."""
    path = f"{folder(df.sparkSession)}/lexstrata-{label}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexstrata_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a table made by ``saved`` that no plan will read any more."""
    path = getattr(df, "_lexstrata_path", None)
    if path is not None:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``most``; else a shuffled side."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def _statuses(df: DataFrame) -> list:
    conf, path = df.sparkSession._jsc.hadoopConfiguration(), df.sparkSession._jvm.org.apache.hadoop.fs.Path
    return [at.getFileSystem(conf).getFileStatus(at) for at in map(path, df.inputFiles())]


def stamps(df: DataFrame) -> tuple:
    """Names, sizes and times of a table's files: equal only while none has changed."""
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in _statuses(df)))


def spread(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """A table of fewer files than cores and at most ``most_bytes`` on disk, dealt over all cores; others as they are.

    Small files often are a single row group, hence a single task; large tables need no such shuffle.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    return df.repartition(cores) if sum(s.getLen() for s in _statuses(df)) <= most_bytes else df
