"""Benchmark decontamination with SimHash windows; SQL functions only.

For every benchmark item of L words, the windows of L words of a document are
fingerprinted and looked up among the items of that length. Blocks of 9 bits of
the 63-bit fingerprint are indexed with all values within 2 bits: by the pigeonhole
principle, two fingerprints that differ in at most 20 bits differ in at most 2 in
one of the 7 blocks, so the index finds each item within that radius. Candidates
are verified by the exact similarity of the weighted shingles (a shingle's weight
is how often it occurs): sum of minima over sum of maxima at least ``percent`` %.

A window without a shingle of an item has similarity 0, and a similar one holds
one of any ``S - need + 1`` of the item's S shingles. Only windows over such an
anchor are fingerprinted. Anchors are found while the words stream through one
hash join; an anchor takes the words around it along, so texts are read once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.common import maybe_broadcast, written

BLOCKS, BITS, NEAR = 7, 9, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
_MASKS = [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(BITS), k)]
#: One bit in each of three lanes of 21 bits: three counters share a number.
_LANES = 1 | 1 << 21 | 1 << 42


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def _shingles(words: Column, k: Column) -> Column:
    """The shingles of ``k`` words in order, as text; none if there are fewer words."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def _numbered(shingles: Column) -> Column:
    """The shingles, each with the number of its occurrence: a multiset as a set."""
    repeated = F.transform(shingles, lambda x, i: F.concat_ws("\n", x, F.size(F.filter(F.slice(shingles, 1, i + 1), lambda y: y == x)).cast("string")))
    plain = F.transform(shingles, lambda x: F.concat(x, F.lit("\n1")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(repeated)


def simhash(hashes: Column) -> Column:
    """The 63-bit fingerprint of an array of 64-bit hashes, repeats counting as weight.

    Bit b is set if more than half of the hashes have it; up to 2^20 hashes.
    """
    n = F.size(hashes)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda g: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", x, g).bitwiseAND(F.lit(_LANES))))
    half = F.struct(lanes.alias("lanes"), n.alias("n"))

    def bits(count: Column, g: Column, n: Column) -> Column:
        out = F.lit(0).cast("long")
        for lane in range(3):
            of = F.call_function("shiftrightunsigned", count, F.lit(21 * lane)).bitwiseAND(F.lit((1 << 21) - 1))
            out = out.bitwiseOR(F.when(of * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), g + 21 * lane)).otherwise(F.lit(0).cast("long")))
        return out

    # a lambda's variable is computed once, an expression as often as it is written
    each = F.transform(F.array(half), lambda h: F.aggregate(F.transform(h["lanes"], lambda c, g: bits(c, g, h["n"])), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x)))
    return F.coalesce(F.get(each, F.lit(0)), F.lit(0).cast("long"))


def _block(fingerprint: Column, j: Column | int) -> Column:
    at = j * BITS if isinstance(j, Column) else F.lit(j * BITS)
    return F.call_function("shiftrightunsigned", fingerprint, at).bitwiseAND(F.lit((1 << BITS) - 1))


def items_of(benchmark: DataFrame, item_col: str, text_col: str, shingle: int) -> DataFrame:
    """``item_id, L, k, m, shingles, fp``: words, shingle length, shingles of every item that has words."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    rows = rows.select("item_id", "words", F.size("words").alias("L"), F.least(F.size("words"), F.lit(shingle)).alias("k"))
    rows = rows.withColumn("shingles", _shingles(F.col("words"), F.col("k")))
    hashes = F.transform("shingles", lambda x: F.xxhash64(x))
    return rows.select("item_id", "L", "k", F.size("shingles").alias("m"), "shingles", simhash(hashes).alias("fp"))


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 80, shingle: int = 5
) -> DataFrame:
    """A row per document and benchmark item found in it: ``doc_id, item_id, n_windows, similarity, first_word, hamming``.

    ``n_windows`` windows of the item's length pass, ``similarity`` is the largest
    and ``hamming`` the smallest distance among them, ``first_word`` the first start
    (words from 0). A document shorter than the item is one window.

    Edge cases: texts and items without words (null, empty, punctuation) match
    nothing; an item of fewer than ``shingle`` words is one shingle of all of them;
    rows that share an id (null is one too) are one document; repeated items are
    each reported by their id; empty tables give an empty result. Other columns are
    not read. Item tables are broadcast if their counted rows are within
    ``BROADCAST_ROWS`` and joined by a shuffle else.
    """
    items = written(items_of(benchmark, item_col, item_text, shingle), "items")
    kinds = sorted((r["k"], r["n"], r["s"]) for r in items.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("s")).collect())
    n_items = sum(n for _, n, _ in kinds)
    need = F.expr(f"CAST((m * {percent} + 99) DIV 100 AS INT)")
    ordered = F.array_sort(F.transform("shingles", lambda x: F.struct((-F.length(x)).alias("short"), x.alias("x"))))  # long ones are rare
    anchors = items.select("L", "k", "m", F.explode(F.slice(ordered, 1, F.col("m") - need + 1)).alias("a"))
    anchors = anchors.select("L", "m", "k", F.split(F.col("a.x"), " ", -1).alias("ws")).distinct()

    docs = df.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    docs = docs.select("doc_id", "words", F.size("words").alias("n"), F.monotonically_increasing_id().alias("row"))
    each = docs.select("doc_id", "row", "n", "words", F.posexplode("words").alias("p", "word"))
    found = None
    for k, _, total in kinds:
        words = [F.get("words", F.col("p") + i) if i else F.col("word") for i in range(k)]
        hashed = each.filter(F.col("p") <= F.col("n") - k).withColumn("h", F.xxhash64(*words))
        keys = anchors.filter(F.col("k") == k).select("L", "m", F.xxhash64(*(F.get("ws", F.lit(i)) for i in range(k))).alias("h")).distinct()
        hit = hashed.join(maybe_broadcast(keys, total), "h")
        low = F.greatest(F.col("p") - F.col("m") + 1, F.lit(0))
        hit = hit.select("doc_id", "row", "n", "L", "m", F.lit(k).alias("k"), "p", low.alias("low"), F.slice("words", low + 1, F.col("p") - low + F.col("L")).alias("around"))
        found = hit if found is None else found.unionByName(hit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    if found is None:
        return df.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, n_windows long, similarity double, first_word int, hamming int")

    # little data but much work follows: a fixed number of partitions is not merged into a few
    found = found.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "L")
    # a window belongs to its first anchor, so it is made once
    before = F.coalesce(F.lag("p").over(Window.partitionBy("row", "L", "k").orderBy("p")), F.lit(-1))
    lo, hi = F.greatest(F.col("low"), before + 1), F.greatest(F.least(F.col("p"), F.col("n") - F.col("L")), F.lit(0))
    spans = found.withColumn("lo", F.when(F.col("n") < F.col("L"), F.when(before < 0, 0).otherwise(1)).otherwise(lo)).withColumn("hi", hi).filter("lo <= hi")
    spans = spans.withColumn("hashes", F.transform(_shingles(F.col("around"), F.col("k")), lambda x: F.xxhash64(x)))
    windows = spans.withColumn("s", F.explode(F.sequence("lo", "hi")))
    size = F.least(F.col("m"), F.col("n") - F.col("k") + 1)
    windows = windows.withColumn("fp", simhash(F.slice("hashes", F.col("s") - F.col("low") + 1, size)))
    windows = windows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("v", _block(F.col("fp"), F.col("j")))
    near = items.select("item_id", "L", "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j"))
    near = near.select("item_id", "L", "j", F.col("fp").alias("item_fp"), F.explode(F.transform(F.lit(_MASKS), lambda m: _block(F.col("fp"), F.col("j")).bitwiseXOR(m.cast("long")))).alias("v"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.get(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.bit_count(_block(apart, b)) <= NEAR), F.lit(0))
    pairs = windows.join(maybe_broadcast(near, n_items * BLOCKS * len(_MASKS)), ["L", "j", "v"]).withColumn("hamming", F.bit_count(apart))
    pairs = pairs.filter((F.col("hamming") <= RADIUS) & (first == F.col("j")))
    own = _shingles(F.slice("around", F.col("s") - F.col("low") + 1, F.col("L")), F.col("k"))
    pairs = pairs.select("doc_id", "item_id", "s", "hamming", own.alias("own"))
    full = items.select("item_id", "fp", F.col("shingles").alias("theirs")).select("item_id", "theirs").distinct()
    both = pairs.join(maybe_broadcast(full, n_items), "item_id")
    common = F.size(F.array_intersect(_numbered(F.col("own")), _numbered(F.col("theirs"))))
    both = both.select("doc_id", "item_id", "s", "hamming", common.alias("lo"), (F.size("own") + F.size("theirs") - common).alias("hi"))
    both = both.filter(F.col("lo") * 100 >= F.col("hi") * percent)
    return both.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max(F.col("lo") / F.col("hi")).alias("similarity"), F.min("s").alias("first_word"), F.min("hamming").cast("int").alias("hamming")
    )
