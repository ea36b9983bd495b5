"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of characters (order 4; digits are one symbol, letters keep their
case, symbols have 12 bits). Counts, continuation counts, contexts and interpolated
probabilities are tables, made by grouping and joining on n-grams, contexts and
suffixes.

Scoring is a join too, sharded by the middle of the n-gram, on which an n-gram, its
context and its suffix agree. A task cuts its documents into blocks and sends each
shard the n-grams of a block that belong to it, packed, with the documents and how
often; the shard streams them past its part of the model and sends back sums by
document, which are added up by block. No task needs the whole model, and no text
is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.common import maybe_broadcast, mix64, slices, written

ORDER, WIDTH = 4, 12
_START = 2
_MASK = (1 << WIDTH) - 1


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The symbol of each code point: itself below 2048, else one of 2048 by a hash; digits are all 0's."""
    points = np.arange(0x110000, dtype=np.uint64)
    out = np.where(points < 2048, points, np.uint64(2048) + mix64(points) % np.uint64(2048))
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, as a number, and the text it is in; texts start with start symbols."""
    pad = chr(_START) * (ORDER - 1)
    own = [(t or "").replace(chr(_START), " ") for t in texts]
    points = np.frombuffer(("".join(pad + t for t in own)).encode("utf-32-le", "replace"), np.uint32)
    symbols = _symbols()[points]
    keys = symbols[ORDER - 1 :].copy() if len(symbols) else symbols
    for k in range(1, ORDER):
        keys |= symbols[ORDER - 1 - k : len(symbols) - k] << np.uint64(WIDTH * k)
    doc = np.repeat(np.arange(len(own)), [len(t) + len(pad) for t in own])[ORDER - 1 :]
    real = points[ORDER - 1 :] != _START
    return keys[real], doc[real]


def _shard(middle: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(middle + np.uint64(0x51ED)) % np.uint64(shards)).astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one size each as compressed bytes, a plane for each byte of an item."""
    head = np.array([x for a in arrays for x in (len(a), a.itemsize)], "<u4").tobytes()
    body = b"".join(np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zlib.compress(len(arrays).to_bytes(4, "little") + head + body, 1)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    head, at, out = np.frombuffer(data, "<u4", 2 * n, 4), 4 + 8 * n, []
    for i, kind in enumerate(types):
        size, item = int(head[2 * i]), int(head[2 * i + 1])
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size * item, at).reshape(item, size).T).reshape(-1).view(kind))
        at += size * item
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``key, c`` over all texts; each task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, loose = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merge():
            new, n = np.unique(np.concatenate(loose), return_counts=True)
            values, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
            return values, np.bincount(at, np.concatenate((counts, n))).astype(np.int64)

        for batch in batches:
            for part in slices(batch, 0):
                loose.append(ngrams(part.column(0).to_pylist())[0])
                if sum(map(len, loose)) > 4_000_000:
                    keys, counts = merge()
                    loose = []
        if loose:
            keys, counts = merge()
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["key", "c"])

    return docs.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams occur 1 to 4 times."""
    n = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n = [0, *(n[f"n{k}"] for k in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) if n[k] else 0.5 * k for k in (1, 2, 3))


def train(docs: DataFrame) -> DataFrame:
    """The model as ``kind, key, value``: kind 1 to 4 the probability of an n-gram of that order, 12 to 14 the weight a context leaves to shorter n-grams, 0 that of a symbol never seen."""
    tables = {ORDER: written(count_ngrams(docs), "ngrams")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols stand before
        mask = (1 << WIDTH * k) - 1
        tables[k] = written(tables[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"grams{k}")
    lower, out = None, None
    for k in range(1, ORDER + 1):
        d = _discounts(tables[k])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = tables[k].withColumn("context", F.shiftright("key", WIDTH))
        contexts = written(rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("left")), f"contexts{k}")
        rows = rows.join(contexts, "context")
        if k == 1:
            below = F.lit(1.0 / (1 << WIDTH))
        else:
            rows = rows.join(lower.select(F.col("key").alias("suffix"), F.col("value").alias("below")), F.col("key").bitwiseAND(F.lit((1 << WIDTH * (k - 1)) - 1)) == F.col("suffix"))
            below = F.col("below")
        value = F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total") + F.col("left") * below
        lower = written(rows.select("key", value.alias("value")), f"probabilities{k}")
        own = lower.select(F.lit(k).alias("kind"), "key", "value")
        leave = contexts.select(F.lit(10 + k).alias("kind"), F.col("context").alias("key"), F.col("left").alias("value"))
        own = own.unionByName(leave if k > 1 else leave.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), (F.col("value") / (1 << WIDTH)).alias("value")))
        out = own if out is None else out.unionByName(own)
    return out


class Shard:
    """Part of a model in memory, for n-grams with a middle of this shard."""

    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray):
        self.tables = {}
        for kind in (0, 1, 2, 3, 4, 12, 13, 14):
            own = np.flatnonzero(kinds == kind)
            own = own[np.argsort(keys[own])]
            self.tables[kind] = keys[own], values[own]

    def find(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, NaN where there is none."""
        have, values = self.tables[kind]
        if not len(have):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, values[at], np.nan)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of each n-gram's last symbol after the others."""
        value = self.find(0, np.zeros(1, np.uint64))[0]
        found = np.full(len(keys), 1.0 / (1 << WIDTH) if np.isnan(value) else value)
        for k in range(1, ORDER + 1):
            own = keys & np.uint64((1 << WIDTH * k) - 1)
            seen = self.find(k, own)
            if k > 1:
                left = self.find(10 + k, own >> np.uint64(WIDTH))
                found = found * np.where(np.isnan(left), 1.0, left)
            found = np.where(np.isnan(seen), found, seen)
        return np.log(found)


#: Model rows of a shard at most, about: what a task's Python worker holds.
SHARD_ROWS = 500_000


def score(docs: DataFrame, model: DataFrame, keep: tuple[str, ...], shards: int | None = None) -> DataFrame:
    """``keep`` columns, ``n`` characters and the sum ``log_p`` of their log probabilities for every row.

    The number of shards follows the counted model (16 at least), so a task's part of
    it does not grow with the corpus.
    """
    spark = docs.sparkSession
    shards = shards or max(16, -(-model.filter("kind % 10 > 2").count() // SHARD_ROWS))
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    shape = docs.select(*keep).schema
    middle = np.uint64((1 << WIDTH * 2) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, len(keep)):
                keys, doc = ngrams(part.column(len(keep)).to_pylist())
                own = pa.RecordBatch.from_arrays(part.columns[: len(keep)], names=list(keep))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                out = [(-1, sink.getvalue().to_pybytes())]
                pairs = np.sort(keys << np.uint64(16) | doc.astype(np.uint64))
                first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
                times, pairs = np.diff(np.append(first, len(pairs))).astype(np.uint32), pairs[first]
                gram, who = pairs >> np.uint64(16), (pairs & np.uint64(0xFFFF)).astype(np.uint16)
                home = _shard(gram >> np.uint64(WIDTH) & middle, shards)
                for s in np.unique(home):
                    mine = home == s
                    g, w, t = gram[mine], who[mine], times[mine]
                    at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    runs, small = np.diff(np.append(at, len(g))).astype(np.uint16), t.max() < 256
                    out.append((int(s), _pack(np.diff(g[at], prepend=np.uint64(0)), runs, w, t.astype(np.uint8) if small else t)))
                for s, data in out:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "data"])
                block += 1

    rows = docs.select(*keep, "text")
    asked = rows.mapInArrow(ask, "shard int, block long, data binary")
    asked = asked.select("shard", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("side"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "block", "data")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(shards, dtype=np.int32)
        for batch in batches:
            kinds, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            mid = np.where(kinds == 4, keys >> np.uint64(WIDTH), np.where(kinds == 3, keys >> np.uint64(WIDTH), keys)) & middle
            alone = kinds % 10 > 2
            home = _shard(mid, shards)
            for s in every:  # orders 1 and 2 go to all shards: their number is bounded by the symbols
                mine = pa.array(np.flatnonzero(~alone | (home == s)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), s, np.int32)), *(c.take(mine) for c in batch.columns)], names=["shard", "kind", "key", "value"])

    placed = model.select("kind", "key", "value").mapInArrow(place, "shard int, kind int, key long, value double")
    placed = placed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "kind", "key", "value", F.lit(0).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, model_part = None, [], None
        for batch in batches:
            shard, salt, side = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(shard))):
                if now != (shard[lo], salt[lo]):
                    now, parts, model_part = (shard[lo], salt[lo]), [], None
                if side[lo] == 0:
                    parts.append([batch.column(i).slice(lo, hi - lo).to_numpy() for i in (3, 4, 5)])
                    continue
                if model_part is None:
                    kinds, keys, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
                    model_part, parts = Shard(kinds, keys.view(np.uint64), values), []
                blocks, data = batch.column(6).slice(lo, hi - lo).to_pylist(), batch.column(7).slice(lo, hi - lo)
                for block, packed in zip(blocks, data):
                    packed = packed.as_py()
                    if shard[lo] >= 0:
                        head = np.frombuffer(zlib.decompressobj().decompress(packed, 36), "<u4")
                        deltas, runs, who, times = _unpack(packed, np.uint64, np.uint16, np.uint16, np.uint8 if head[8] == 1 else np.uint32)
                        logs = np.repeat(model_part.log_probability(np.cumsum(deltas, dtype=np.uint64)), runs)
                        n = np.bincount(who, times)
                        packed = _pack(np.flatnonzero(n).astype(np.uint16), n[n > 0].astype(np.uint32), np.bincount(who, logs * times)[n > 0])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(shard[lo] >= 0)], pa.int32()), pa.array([packed], pa.binary())], names=["block", "part", "data"])

    # a partition for each shard and salt: hashing as many keys as partitions would leave some empty and others with several
    cell = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("block"), F.lit(shards * salts)).cast("int")).otherwise(F.col("shard") * salts + F.col("salt"))
    joined = asked.unionByName(placed).repartitionById(shards * salts, cell).sortWithinPartitions("shard", "salt", "side", "block")
    answers = joined.mapInArrow(answer, "block long, part int, data binary").repartition("block").sortWithinPartitions("block", "part", F.xxhash64("data"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = n = total = None
        done = lambda: pa.RecordBatch.from_arrays([*own.columns, pa.array(n), pa.array(total)], names=[*keep, "n", "log_p"])
        for batch in batches:
            for part, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if part == 0:
                    if own is not None:
                        yield done()
                    own = pa.ipc.open_stream(data).read_next_batch()
                    n, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows)
                else:
                    who, count, sums = _unpack(data, np.uint16, np.uint32, np.float64)
                    n[who] += count
                    total[who] += sums
        if own is not None:
            yield done()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
    return answers.mapInArrow(add, f"{schema}, n long, log_p double")


def calibration(id_column: Column) -> Column:
    """Whether a trusted document sets thresholds (one of four) instead of training the model."""
    return F.pmod(F.xxhash64(id_column), F.lit(4)) == 3


def quality(
    df: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = 0.995,
    weight: int = 50,
) -> DataFrame:
    """One row per input row: ``doc_id, lang, n_symbols, perplexity, threshold, kept, in_training``.

    ``trusted`` has the ids of trusted documents. Three of four train the model, the
    rest are the sample whose perplexities give each language its ``quantile`` as
    the threshold. A language's log quantile is drawn to that of all, which counts as
    ``weight`` documents, so it moves smoothly with the language's number of them.
    Quantiles are exact on log perplexities in steps of 0.001. ``in_training`` marks
    the documents that the model has seen, whose perplexity is too low.

    Edge cases: a null or empty text has no symbols, a null perplexity and is not
    kept; a null language is a language of its own; without trusted documents there
    is no threshold and every text with symbols is kept; rows that share an id are
    scored each (a trusted id trusts all of them); null ids are never trusted;
    empty tables give an empty result. Other columns of ``df`` are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = written(trusted.select(F.col(trusted.columns[0]).alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "trusted")
    n_ids = ids.count()
    model = train(docs.join(maybe_broadcast(ids.filter(~calibration(F.col("doc_id"))), n_ids), "doc_id", "left_semi"))
    scores = written(score(docs, model, ("doc_id", "lang")), "scores")
    held = scores.join(maybe_broadcast(ids.filter(calibration(F.col("doc_id"))), n_ids), "doc_id", "left_semi").filter("n > 0")
    bins = held.select(F.coalesce("lang", F.lit("")).alias("of"), F.ceil(F.col("log_p") / F.col("n") * -1000).alias("bin")).groupBy("of", "bin").agg(F.count(F.lit(1)).alias("k"))
    bins = written(bins, "bins")  # at most some thousand bins of a language

    def cut(rows: DataFrame) -> DataFrame:
        upto = F.sum("k").over(Window.partitionBy("of").orderBy("bin"))
        total = F.sum("k").over(Window.partitionBy("of"))
        return rows.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= F.col("total") * quantile).groupBy("of").agg(F.min("bin").alias("bin"), F.max("total").alias("total"))

    overall = cut(bins.groupBy("bin").agg(F.sum("k").alias("k")).withColumn("of", F.lit(""))).first()
    pooled = overall["bin"] / 1000 if overall else None
    mixed = (F.col("bin") / 1000 * F.col("total") + F.lit(pooled).cast("double") * weight) / (F.col("total") + weight)
    by_lang = written(cut(bins).select("of", F.exp(mixed).alias("own")), "cuts")
    pooled = None if pooled is None else float(np.exp(pooled))
    out = scores.withColumn("of", F.coalesce("lang", F.lit(""))).join(maybe_broadcast(by_lang, by_lang.count()), "of", "left")
    seen = ids.filter(~calibration(F.col("doc_id"))).withColumn("seen", F.lit(True))
    out = out.join(maybe_broadcast(seen, n_ids), "doc_id", "left")
    perplexity = F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n")))
    threshold = F.coalesce("own", F.lit(pooled).cast("double"))
    return out.select("doc_id", "lang", F.col("n").alias("n_symbols"), perplexity.alias("perplexity"), threshold.alias("threshold"), ((F.col("n") > 0) & F.coalesce(perplexity <= threshold, F.lit(True))).alias("kept"), F.coalesce("seen", F.lit(False)).alias("in_training"))
