"""MinHash near-dedup with tensored banding.

Two small collections of sub-keys are made for a document, ``side`` in each, and
every sub-key combines ``width`` minhashes. The keys of the ``side * side`` tables
are all pairs of a sub-key from the first and one from the second, so the minhashes
computed are ``2 * side * width`` instead of ``side * side * 2 * width``. A pair of
similarity s shares a table with probability (1 - (1 - s^width)^side)^2: with 12
sub-keys of 2 minhashes, 0.99999 at s = 0.8 and more above.

Candidates are verified on the full shingle sets. No group emits all its pairs:
documents with equal sets form one class; in a table's bucket each member meets the
smallest; pairs of bucket mates that are in different components after that are
compared unless what they share with the smallest rules out the similarity. So
no link between bucket mates of different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.common import maybe_broadcast, mix64, salt_of, slices, text_buffers, written
from lexstrata.llm.components import components

#: Buckets of more than a task's rows divided by this are hot.
HOT_SHARE = 8
#: 64-bit words of a bitmap.
MARKS = 4
#: Rows of the second round's sides that are broadcast at most.
HELD_ROWS = 400_000
#: Bytes of text that a task turns into arrays at once.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_K1, _K2, _K3 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased (plus one, so that no byte counts as nothing), and which bytes are white space."""
    lower = np.arange(1, 257, dtype=np.uint64)
    lower[0x41:0x5B] += 32
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return lower, white


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse, at least ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (np.uint64(_BASE), np.uint64(inverse))]
    return _POWERS[0], _POWERS[1]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words_in: int = 2) -> list[np.ndarray]:
    """For each text of a buffer the sorted 64-bit hashes of its distinct shingles of ``words_in`` words; of fewer words, that of the whole sequence."""
    lower, white = _tables()
    n_docs = len(offsets) - 1
    solid = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.append(False, ~solid[:-1]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.append(~solid[1:], False) | edge[1:])) + 1 if len(data) else starts
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(lower[data] * up[: len(data)], out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _K3)
    first = np.searchsorted(starts, offsets)
    runs = words[: max(len(words) - words_in + 1, 0)]
    for k in range(1, words_in):
        runs = mix64(runs * _K1 + words[k : k + len(runs)] * _K2)
    out = []
    for i in range(n_docs):
        lo, hi = first[i], first[i + 1]
        own = runs[lo : hi - words_in + 1] if hi - lo >= words_in else _whole(words[lo:hi])
        own = np.sort(own)
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def _whole(words: np.ndarray) -> np.ndarray:
    """One hash of a short sequence of words; none of no words."""
    own = words[:1]
    for k in range(1, len(words)):
        own = mix64(own * _K1 + words[k : k + 1] * _K2)
    return mix64(own + _K3)


def meets(common: str, n: str, m: str, percent: int) -> str:
    """SQL for 100 * intersection >= percent * union, given the intersection's and the sets' sizes."""
    return f"100 * {common} >= {percent} * ({n} + {m} - {common})"


class TensorHash:
    """The two collections of sub-keys of a shingle set."""

    def __init__(self, side: int = 12, width: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.side, self.width = side, width
        n = 2 * side * width
        self.mul = rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 64, n, np.uint64)
        self.salt = rng.integers(0, 1 << 64, 2 * side, np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """``2 * side`` numbers: the first collection's, then the second's."""
        least = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[i : i + 4096, None] * self.mul + self.add).min(axis=0), out=least)
        out = self.salt.copy()
        for part in least.reshape(2 * self.side, self.width).T:
            out = mix64(out * _K1 + part * _K2)
        return out


def signatures(docs: DataFrame, hashes: TensorHash, words_in: int = 2) -> DataFrame:
    """``doc_id, n_shingles, set_key, a, b``: set size, digest of the set and the two collections; of an empty set only its size."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sets = shingle_sets(*text_buffers(part.column(1)), words_in)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.array([hashes.keys(s) for s in sets if len(s)], np.uint64).view(np.int64).reshape(-1, 2, hashes.side)
                at = np.where(sizes > 0, np.cumsum(sizes > 0) - 1, -1)
                rows = pa.array(at, mask=at < 0)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(keys[:, k]).ravel()), hashes.side).cast(pa.list_(pa.int64())).take(rows) for k in (0, 1)]
                digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), digests, *lists], names=["doc_id", "n_shingles", "set_key", "a", "b"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {id_type}, n_shingles long, set_key binary, a array<long>, b array<long>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """``MARKS`` words in which each shingle's hash sets one bit; so a set has at least as many shingles as bits."""
    out = np.zeros(MARKS, np.uint64)
    at = shingles % np.uint64(64 * MARKS)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def bits(word: str, first: int = 0) -> str:
    """SQL for the number of bits of a combination of two bitmaps; ``{k}`` in ``word`` is a word's place."""
    return "(" + " + ".join(f"bit_count({word.format(k=k)})" for k in range(first, first + MARKS)) + ")"


def compared(docs: DataFrame, pairs: DataFrame, n_pairs: int | None = None, spell: bool = False, most: int = 256, words_in: int = 2) -> DataFrame:
    """For distinct candidates ``(a, b)`` the full sets' sizes and intersection: ``a, b, n_a, n_b, common``.

    With ``spell``, also the shingles that only one of the two has (``delta``), with the
    bitmaps of those that only ``a`` has and of those that only ``b`` has (``marks``).
    Rows of a ``b`` come as one sorted run, its own text first, so a task holds one set
    and streams the others past it. A ``b`` of more than ``most`` partners is dealt over
    several runs. If the pairs are counted and few, their ids are broadcast to the
    texts; else both are shuffled by id.
    """
    counted = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.expr(f"if(n > {most}, n div {most} + 1, 1)").alias("runs"))
    hot = written(counted.filter("runs > 1"), "hot")
    dealt = pairs.join(maybe_broadcast(hot, hot.count()), "b", "left")
    dealt = dealt.select("a", "b", F.when(F.col("runs").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), "runs")).alias("run"))
    heads = counted.select("b", F.explode(F.expr("sequence(0L, runs - 1)")).alias("run"))
    roles = dealt.select(F.col("a").alias("doc_id"), "b", F.col("run").cast("long").alias("run"), F.lit(1).alias("part")).unionByName(heads.select(F.col("b").alias("doc_id"), "b", "run", F.lit(0).alias("part")))
    roles = roles.hint("merge") if n_pairs is None else maybe_broadcast(roles, 2 * n_pairs)
    rows = docs.select("doc_id", "text").join(roles, "doc_id").repartition("b", "run").sortWithinPartitions("b", "run", "part").select("doc_id", "b", "run", "part", "text")
    names = ["a", "b", "n_a", "n_b", "common", "delta", "marks"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for piece in slices(batch, 4, SLICE):
                found = []
                ids, bs, runs, parts = (piece.column(i).to_pylist() for i in range(4))
                for i, shingles in enumerate(shingle_sets(*text_buffers(piece.column(4)), words_in)):
                    if now != (bs[i], runs[i]):
                        now, own = (bs[i], runs[i]), np.zeros(0, np.uint64)
                    if parts[i] == 0:
                        own = shingles if not len(own) else own  # rows that share an id are one document
                        continue
                    at = np.minimum(np.searchsorted(own, shingles), max(len(own) - 1, 0))
                    both = own[at] == shingles if len(own) else np.zeros(len(shingles), bool)
                    delta = marks = None
                    if spell:
                        lost = np.ones(len(own), bool)
                        lost[at[both]] = False
                        delta = np.append(shingles[~both], own[lost]).view(np.int64)
                        marks = np.append(bitmap(shingles[~both]), bitmap(own[lost])).view(np.int64)
                    found.append((ids[i], bs[i], len(shingles), len(own), int(both.sum()), delta, marks))
                columns = list(zip(*found)) if found else [()] * 7
                kinds = [piece.schema.field(0).type, piece.schema.field(1).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(compare, f"a {kind}, b {kind}, n_a long, n_b long, common long, delta array<long>, marks array<long>")
    return out if spell else out.drop("delta", "marks")


def left_apart(docs: DataFrame, first: DataFrame, found: DataFrame, percent: int, words_in: int = 2) -> DataFrame:
    """Pairs ``(a, b)`` of bucket mates that are in different components and can still be similar.

    Mates met the same smallest document r; of two in different components, at least
    one (x) is outside the component that most mates of r are in. A mate is told by
    its delta, the shingles that only it or only r has. Two sets of n and m shingles
    are similar if at most (n + m) * (100 - percent) / (100 + percent) are in one of
    them only, so the deltas of x and y have at least half of what their sizes sum to
    over that in common (``shared``). This is at least one shingle, as one of the two is
    not linked with r. So in any order of the shingles that x and y follow alike, one
    of the first |delta| - shared + 1 of either delta is in both: only these meet. The
    order is by rarity among the mates of r, those in one component alone before all
    others. So mates do not meet by what most of them have changed, or by what r has
    changed, and a mate with enough shingles of its own meets none. Sizes of deltas in
    bands are part of the join's key, as the places that count are fewer the larger the
    other delta is. A pair is judged by the smallest r that both met.

    Bitmaps bound the intersection of a pair: x & y & r has at most as many shingles as
    r, less the bits of what x or y miss of r; the rest at most those of x outside r,
    less the bits that y's have not, and the other way round. A pair whose bounds rule
    the similarity out is not made.
    """
    comp = found.select(F.col("node").alias("a"), "component")
    edges = first.select("a", "b").distinct().join(comp, "a", "left").withColumn("comp", F.coalesce("component", "a"))
    sizes = edges.groupBy("b", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.max_by("comp", "k").alias("major"), F.count(F.lit(1)).alias("comps"))
    meet = written(sizes.filter("comps > 1").select("b", "major"), "meet")
    n_meet = meet.count()
    if not n_meet:
        return first.select("a", "b").limit(0)
    around = written(edges.join(maybe_broadcast(meet, n_meet), "b").select("a", "b", "comp", (F.col("comp") != F.col("major")).alias("odd")), "around")
    met = around.groupBy("a").agg(F.collect_set("b").alias("rs"))  # at most one for each table
    spelled = compared(docs, around.select("a", "b"), around.count(), spell=True, words_in=words_in).join(around.join(met, "a"), ["a", "b"])
    spelled = spelled.select(F.col("a").alias("id"), F.col("b").alias("r"), F.col("n_a").alias("n"), F.col("n_b").alias("n_r"), F.col("common").alias("i"), F.expr("n_a + n_b - 2 * common").alias("d"), "comp", "odd", "rs", "marks", "delta", F.xxhash64("delta").alias("text"))
    spelled = written(spelled.dropDuplicates(["id", "r", "text"]), "spelled")  # rows that share an id: each of its sets once

    over, under = 100 + percent, 100 - percent
    # the least that x and any y share, by |y's delta| >= ||y| - |r|| and by the triangle of x, y and r
    least = f"greatest(ceil(({over} * d - {under} * (n + n_r)) / {2 * over}), ceil(d - n * {under} / {percent}), 1)"
    loose = spelled.select("r", "id", "text", "comp", "d", F.expr(f"d - {least} + 1").alias("reach"), F.explode("delta").alias("s"))
    # holders are combined map-side; a shingle that only one component holds links nothing
    held = loose.groupBy("r", "s").agg(F.count(F.lit(1)).alias("holders"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2")
    held = written(held.select("r", "s", "holders"), "held")
    own = Window.partitionBy("r", "id", "text")
    ranked = loose.drop("comp").join(maybe_broadcast(held, held.count(), HELD_ROWS), ["r", "s"])
    ranked = ranked.withColumn("rank", F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("holders", "s")))
    ranked = written(ranked.filter("rank <= reach").select("r", "id", "text", "s", "rank"), "ranked")

    # for each band of the other's |delta| that can be similar, the places that count against it
    wide = f"greatest({under} * n_r div {over}, 1)"
    most = f"least(floor(n * 100 / {percent}), n_r + (k + 1) * {wide} - 1)"
    place = f"d + 1 - greatest(ceil(({over} * (d + k * {wide}) - {under} * (n + {most})) / {2 * over}), 1)"
    bands = f"filter(sequence(greatest(ceil(d - n * {under} / {percent}), 0) div {wide}, floor(d + n * {under} / {percent}) div {wide}), k -> rank <= {place})"
    columns = ("id", "n", "n_r", "i", "d", "comp", "odd", "rs", "marks", "rank")
    members = spelled.drop("delta")
    members = ranked.join(maybe_broadcast(members, members.count(), HELD_ROWS), ["r", "id", "text"])
    side = lambda df, name, band, other: df.select("r", "s", F.expr(f"d div {wide}").alias(band), *(F.col(k).alias(f"{name}_{k}") for k in columns), F.explode(F.expr(bands)).alias(other))
    once = "x_comp <> y_comp AND (NOT y_odd OR x_id < y_id) AND array_min(array_intersect(x_rs, y_rs)) = r"
    shared = f"ceil(({over} * (x_d + y_d) - {under} * (x_n + y_n)) / {2 * over})"
    inside = f"least(x_i, y_i, x_n_r - {bits('x_marks[{k}] | y_marks[{k}]', MARKS)})"
    outside = f"least(x_n - x_i - {bits('x_marks[{k}] & ~y_marks[{k}]')}, y_n - y_i - {bits('y_marks[{k}] & ~x_marks[{k}]')})"
    fits = f"{over} * ({inside} + {outside}) >= {percent} * (x_n + y_n)"
    pairs = side(members.filter("odd"), "x", "x_band", "y_band").join(side(members, "y", "y_band", "x_band"), ["r", "s", "x_band", "y_band"])
    pairs = pairs.filter(f"greatest(x_rank - x_d, y_rank - y_d) <= 1 - {shared} AND {once} AND {fits}")
    pairs = pairs.select(F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b")).distinct()
    return pairs.join(first, ["a", "b"], "left_anti")


def smallest_mates(nodes: DataFrame, least: int = 10_000) -> DataFrame:
    """``a, b``: each node with the smallest node of every bucket that they share, over all tables.

    A bucket is hot if it has more than ``least`` nodes and than a task's mean rows
    divided by ``HOT_SHARE``. Its sub-key is then as frequent, so the sub-keys of the
    first collection are counted (a twelfth of the rows, combined map-side), and
    only the buckets of frequent ones are looked at. Their number is bounded by the
    number of tasks; their smallest nodes are found by a grouping and broadcast. The
    other buckets, none of them large, are sorted by key.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("a") * F.size("b")), F.lit(0)).alias("rows")).first()
    most = max(least, size["rows"] // (HOT_SHARE * tasks))
    rows = nodes.select("doc_id", "b", F.explode("a").alias("x")).select("doc_id", "x", F.explode("b").alias("y")).select("x", F.xxhash64("x", "y").alias("key"), "doc_id")
    cold, found = rows, None
    if size["n"] > most:
        often = written(nodes.select(F.explode("a").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("x"), "sub-keys")
        if often.limit(1).count():
            hot = rows.join(F.broadcast(often), "x").groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
            hot = written(hot.select("key", "low"), "hot-buckets")
            marked = rows.join(F.broadcast(hot), "key", "left")
            cold, found = marked.filter("low IS NULL"), marked.filter("low IS NOT NULL").select("doc_id", "low")
    met = cold.select("doc_id", F.min("doc_id").over(Window.partitionBy("key")).alias("low"))
    met = met if found is None else met.unionByName(found)
    return met.filter("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, hashes: TensorHash | None = None, salts: int = 16, words_in: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than white space, A-Z lower-cased; a document's
    set holds its distinct shingles of ``words_in`` words, or, with fewer words, the
    whole sequence. Documents are linked
    if ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    that links reach, and that document is kept.

    Edge cases: a null or empty text, or one of blanks, has an empty set and is
    linked with nothing; a row with a null id is linked with nothing, has a null
    component and is kept; rows that share an id are one document and share its
    component; equal sets are one class, whose members need no pairs; an empty table
    gives an empty result. Other columns of ``df`` are not read.
    """
    hashes = hashes or TensorHash()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, hashes, words_in), "signatures")
    # classes of equal sets; a hot one is spread over the salts both ways
    keyed = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key", salt_of(F.col("doc_id"), salts).alias("salt"))
    salted = keyed.groupBy("set_key", "salt").agg(F.min("doc_id").alias("low"))
    classes = written(salted.groupBy("set_key").agg(F.min("low").alias("rep"), F.collect_set("salt").alias("salts")), "classes")
    nodes = signed.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").select("doc_id", "a", "b")
    nodes = written(nodes, "nodes")
    first = smallest_mates(nodes)
    first = written(first, "pairs")
    first = written(compared(docs, first, words_in=words_in), "compared")
    linked = F.expr(meets("common", "n_a", "n_b", percent))
    links = first.filter(linked).select("a", "b")
    group = lambda edges: written(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    found = group(links)
    second = written(left_apart(docs, first, found, percent, words_in=words_in), "pairs")
    n_second = second.count()
    if n_second:
        more = written(compared(docs, second, n_second, words_in=words_in).filter(linked).select("a", "b"), "links")
        if more.limit(1).count():
            found = group(links.unionByName(more))
    spread = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), F.explode("salts").alias("salt"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"), salt_of(F.col("doc_id"), salts).alias("salt"))
    out = rows.join(spread, ["set_key", "salt"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


