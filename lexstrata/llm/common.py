"""Helpers of the training-data operators: shared folders, written tables, salting, byte tokenising."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that any broadcast side may have at most; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests, bench), a temporary
    folder takes its place; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="lexstrata-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage and survives lost executors: the table is in the
    shared store, and its rows (partition numbers included) never change.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexstrata-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexstrata_path = path
    return out


def small_table(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of rows that the driver has, made without Python workers on the executors."""
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return spark.createDataFrame(pa.table({name: pa.array(list(c), t) for c, (name, t) in zip(columns, types.items())}))


def discard(df: DataFrame | None) -> None:
    """Delete a table made by ``written`` that no plan will read any more."""
    path = getattr(df, "_lexstrata_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``bound``; else a shuffled side."""
    return F.broadcast(df) if rows <= bound else df.hint("merge")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def salt_of(key: Column, salts: int) -> Column:
    """A salt from 0 to ``salts`` - 1 that is a function of the row, so any re-run gives the same."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of an Arrow string column, without copying; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 1 << 20, most_rows: int = 1 << 16):
    """Cut a batch into row ranges of about ``most_bytes`` of text and at most ``most_rows`` rows; one longer text is a range of its own."""
    pa.default_memory_pool().release_unused()  # the batches before
    offsets, _ = text_buffers(batch.column(text))
    n, start = batch.num_rows, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), start + most_rows, n)
        yield batch.slice(start, stop - start)
        start = stop


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
