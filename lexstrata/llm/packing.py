"""Best-fit packing by minimum bin slack.

Documents become token ids, longer ones are cut, and the pieces are packed into
sequences of ``max_len`` tokens. Which pieces share a sequence depends on their
lengths alone, so the search runs over the histogram of lengths (at most
``max_len`` numbers, whatever the corpus): per bin, the largest length left is
joined by the combination of available lengths that fills the rest best, found by
a subset-sum dynamic program over a bitset. That combination is removed as often
as its lengths last, which is what the same search would do bin by bin.

The layout then gives each rank of a length its bin and offset. Ranks come from
counts by task, so no task sees all pieces of a length.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.common import BROADCAST_ROWS, maybe_broadcast, small_table, written

#: Ids of a document end with this one.
END_ID = 2

#: The vocabulary's added token, which the rank file lacks: wherever its string stands in a text, it is this id.
SPECIAL_TOKENS = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str, special_tokens: tuple[tuple[str, int], ...] = SPECIAL_TOKENS) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special_tokens))


def fullest(counts: Counter, capacity: int) -> Counter:
    """The multiset of available lengths with the largest sum up to ``capacity``; of equal sums one of long lengths."""
    mask = (1 << (capacity + 1)) - 1
    bits, steps = 1, []
    for length in sorted((x for x in counts if counts[x] > 0 and x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0 and not bits >> capacity:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= (bits << (k * length)) & mask
            left, k = left - k, k * 2
        if bits >> capacity:
            break
    total, out = bits.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] += k
            total -= k * length
    return out


def plan_bins(histogram: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, lo, hi, first_bin, per_bin, offset)``: ranks ``lo`` to ``hi`` - 1 of a length, ``per_bin`` in each bin."""
    counts = Counter({k: n for k, n in histogram.items() if n > 0})
    taken: Counter = Counter()
    rows, bins = [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        combo = fullest(counts, max_len - top)
        counts[top] += 1
        combo[top] += 1
        times = min(counts[x] // m for x, m in combo.items())
        offset = 0
        for length in sorted(combo, reverse=True):
            m = combo[length]
            rows.append((length, taken[length], taken[length] + times * m, bins, m, offset))
            offset += m * length
            taken[length] += times * m
            counts[length] -= times * m
            if not counts[length]:
                del counts[length]
        bins += times
    return rows


def token_pieces(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str, text_col: str, max_len: int, special_tokens: tuple[tuple[str, int], ...] = SPECIAL_TOKENS) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian 32-bit) with the task's number and the rank of the piece among its own of that length."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]
    end = np.array([END_ID], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _encoding(tokenizer_path, pattern, special_tokens), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, batch.num_rows, 256):
                ids_of, rows = batch.column(0).slice(i, 256), []
                for row, text in enumerate(batch.column(1).slice(i, 256).to_pylist()):
                    ids = np.append(coder.encode_to_numpy(text, allowed_special="all"), end) if text else end
                    n, at = len(ids), 0
                    piece, size = 0, (n - 1) % max_len + 1
                    while at < n:
                        rows.append((row, piece, at, size, ids[at : at + size].astype("<u4").tobytes(), seen[size]))
                        seen[size] += 1
                        at, piece, size = at + size, piece + 1, max_len
                row, piece, start, length, ids, nth = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                    names=names,
                )

    return docs.mapInArrow(encode, f"doc_id {id_type}, piece int, start long, length long, ids binary, part int, nth long")


def pack_documents(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, special_tokens: tuple[tuple[str, int], ...] = SPECIAL_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``tokenizer_path`` is a rank file of a byte-level BPE and ``pattern`` its
    splitting pattern; ``special_tokens`` are strings that are one id wherever they
    stand in a text; every document's ids end with ``END_ID``. A document of
    more than ``max_len`` ids is cut into pieces of ``max_len`` ids, of which the
    first may be shorter. A sequence's pieces stand without gaps from offset 0.

    Edge cases: a null or empty text is the one id ``END_ID``; special-token
    strings become their ids, as ``tokenizers`` does; repeated rows are packed each; null ids
    stay null; an empty table gives an empty result. Other columns of ``df`` are
    not read. The pieces are written once to the shared folder, so that ranks stay
    as they are if executors are lost.
    """
    spark = df.sparkSession
    pieces = written(token_pieces(df, tokenizer_path, pattern, id_col, text_col, max_len, special_tokens), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a task's bases are one row of ``max_len`` numbers, so the table grows with the tasks alone
    entries = counts.select("part", F.struct("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).alias("e"))
    sparse = entries.groupBy("part").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    bases = written(sparse.select("part", F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: F.try_element_at("m", i.cast("long"))).alias("bases")), "piece-bases")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(histogram, max_len)
    layout = small_table(spark, plan, **dict.fromkeys(("length", "lo", "hi", "first_bin", "per_bin", "at"), pa.int64()))
    placed = pieces.join(maybe_broadcast(bases, bases.count(), BROADCAST_ROWS // max_len), "part").withColumn("rank", F.get("bases", (F.col("length") - 1).cast("int")) + F.col("nth")).drop("bases")
    placed = placed.join(maybe_broadcast(layout, len(plan)), "length").filter("rank >= lo AND rank < hi")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids",
        F.expr("first_bin + (rank - lo) div per_bin").alias("sequence_id"),
        F.expr("at + (rank - lo) % per_bin * length").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids``, a bounded number of pieces in each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
