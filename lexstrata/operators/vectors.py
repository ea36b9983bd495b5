"""Dense vectors: top-k search, similarity join over time windows, components, centroids, topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.arrays import let
from lexstrata.sources.shared import dropped, saved, small

#: Rows of a block of the similarity join; a task multiplies two blocks.
BLOCK = 8192
#: A row's side in such a task: in a block compared with another, or with itself.
_LEFT, _ALONE, _RIGHT = 0, 1, 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays. The length is computed once."""
    return let(F.transform(a, lambda x: x.cast("double")), lambda v: let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def top_k(rows: DataFrame, query: Column, k: int, vector: str = "embedding", group: str | None = None, tie: str = "vec_id") -> DataFrame:
    """The ``k`` rows nearest by cosine, at most one for each ``group``; filters belong on ``rows``."""
    out = rows.withColumn("sim", dot(unit(F.col(vector)), unit(query)))
    if group:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("sim"), tie))).filter("__r = 1").drop("__r")
    return out.orderBy(F.desc("sim"), tie).limit(k)


def echo_edges(rows: DataFrame, threshold: float, window: int = 14, key: str = "vec_id", day: str = "day", group: str = "country", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``i, j, sim`` (i < j): other group, at most ``window`` days apart, cosine at least ``threshold``.

    Every partner of a row is in its bucket of ``window`` days or a neighbouring one.
    Buckets are cut into blocks of about ``block`` rows by hash, and a task is a pair of
    blocks: it holds these two and a tile of their products, whatever the table's size.
    Single-precision matrix products leave out the pairs that are surely below the
    threshold; the others are computed in double precision. Rows with nulls have no
    edge. The driver reads a row for each bucket.
    """
    own = rows.select(F.col(key).alias("i"), F.col(day).cast("double").alias("d"), F.col(group).alias("g"), F.col(vector).alias("v"), F.floor(F.col(day) / window).alias("b"))
    own = own.filter(F.col("i").isNotNull() & F.col("d").isNotNull() & F.col("g").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).withColumn("n", F.size("v"))
    blocks = {(r["n"], r["b"]): -(-r["count"] // block) for r in own.groupBy("n", "b").count().collect()}
    half = lambda k: k * (k + 1) // 2
    begins, tasks = {}, 0
    for (n, b), k in sorted(blocks.items()):
        begins[n, b] = tasks
        tasks += half(k) + k * blocks.get((n, b - 1), 0)
    # per bucket: its blocks, its first task, the blocks before and after it, the first task with the bucket after it
    plan = [(n, b, k, begins[n, b], blocks.get((n, b - 1), 0), blocks.get((n, b + 1), 0), begins.get((n, b + 1), 0) + half(blocks.get((n, b + 1), 0))) for (n, b), k in sorted(blocks.items())]
    plan = rows.sparkSession.createDataFrame(plan, "n int, b long, k long, t long, before long, after long, t_after long")
    own = own.join(small(plan), ["n", "b"]).withColumn("p", F.pmod(F.xxhash64("i", "d", "g", "v"), F.col("k")))
    k, p, t = F.col("k"), F.col("p"), F.col("t")
    at = lambda task, side: F.struct(task.cast("long").alias("task"), side.alias("side"))
    below = lambda end: F.filter(F.sequence(F.lit(0).cast("long"), end), lambda x: x < end)
    pair = lambda a, b: t + F.floor(b * (b + 1) / 2) + a
    places = F.concat(
        F.transform(F.sequence(p, k - 1), lambda q: at(pair(p, q), F.when(q == p, _ALONE).otherwise(_LEFT))), F.transform(below(p), lambda q: at(pair(q, p), F.lit(_RIGHT))),
        F.transform(below(F.col("before")), lambda q: at(t + F.floor(k * (k + 1) / 2) + p * F.col("before") + q, F.lit(_LEFT))),
        F.transform(below(F.col("after")), lambda q: at(F.col("t_after") + q * k + p, F.lit(_RIGHT))),
    )
    parts = max(1, min(tasks, 1000))
    dealt = own.select("i", "d", "g", "v", F.inline(places)).repartitionById(parts, F.pmod(F.col("task"), F.lit(parts)).cast("int")).sortWithinPartitions("task", "side")
    kind = dict(own.dtypes)["i"]
    pairs = dealt.mapInArrow(_near_pairs(threshold, window), f"l {kind}, r {kind}, sim double")
    return pairs.filter("l <> r").select(F.least("l", "r").alias("i"), F.greatest("l", "r").alias("j"), "sim")


def _near_pairs(threshold: float, window: float, tile: int = 1024, piece: int = 1 << 16):
    """Of batches ``i, d, g, v, task, side`` sorted by task and side: ``l, r, sim`` of each task's pairs. A left block is held, right rows pass by."""

    class Rows:
        def __init__(self, parts: list[pa.RecordBatch]):
            of = lambda name: pa.concat_arrays([x.column(name) for x in parts])
            self.ids, self.groups, self.days = of("i"), of("g"), of("d").to_numpy(zero_copy_only=False)
            x = _matrix(of("v"))
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            self.exact = np.divide(x, length, out=x.copy(), where=~(length == 0))
            self.rough = self.exact.astype(np.float32)

    def pairs(a: Rows, b: Rows, alone: bool) -> Iterator[pa.RecordBatch]:
        codes = pa.concat_arrays([a.groups, b.groups]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ga, gb = codes[: len(a.days)], codes[len(a.days) :]
        least = np.float32(threshold - (a.rough.shape[1] + 8) * 2.0**-22)  # a product of unit vectors is that exact in single precision
        for at in range(0, len(a.days), tile):
            x, y = np.nonzero(~(a.rough[at : at + tile] @ b.rough.T < least))  # NaN stays, as in SQL
            x += at
            keep = (ga[x] != gb[y]) & (np.abs(a.days[x] - b.days[y]) <= window)
            if alone:
                keep &= x < y
            x, y = x[keep], y[keep]
            for k in range(0, len(x), piece):
                u, w = x[k : k + piece], y[k : k + piece]
                sims = (a.exact[u] * b.exact[w]).sum(axis=1)
                ok = ~(sims < threshold)
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(u[ok])), b.ids.take(pa.array(w[ok])), pa.array(sims[ok])], names=["l", "r", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, alone, parts, held = None, False, [], None

        def settled() -> Iterator[pa.RecordBatch]:
            """A block that is compared with itself."""
            if alone:
                own = Rows(parts)
                yield from pairs(own, own, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "side")]
            cuts = [0, *(np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if now[0][a] != task:
                    yield from settled()
                    task, alone, parts, held = now[0][a], False, [], None
                if now[1][a] != _RIGHT:
                    alone = now[1][a] == _ALONE
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    held = held or Rows(parts)
                    yield from pairs(held, Rows([batch.slice(a, b - a)]), False)
        yield from settled()

    return run


def components(edges: DataFrame, src: str = "i", dst: str = "j", most_rounds: int = 50) -> DataFrame:
    """``node, component`` (its smallest node) by min-label steps with pointer jumping; each round is a table in the shared folder.

    The edges are written first, so whatever makes them runs once.
    """
    once = saved(edges.select(F.col(src).alias("x"), F.col(dst).alias("y")), "edges")
    both = saved(once.unionByName(once.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    dropped(once)
    labels = saved(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        step = saved(labels.join(near, F.col("node") == F.col("x")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")), "labels")
        roots = step.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = saved(step.join(roots, F.col("component") == F.col("n2"), "left").select("node", "old", F.least("component", F.coalesce("c2", "component")).alias("component")), "labels")
        changed = new.filter("component <> old").limit(1).count()
        dropped(labels)
        dropped(step)
        labels, path = new.drop("old"), new._lexstrata_path
        labels._lexstrata_path = path
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError("the components have not settled")


def cluster_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component: size, countries in first-seen order (by day, then id), first and last day, span, largest similarity."""
    seen = members.groupBy("component", "country").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("day", "node")).alias("at"), F.max("day").alias("last"))
    rows = seen.groupBy("component").agg(
        F.sum("k").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("at", "country"))), lambda x: x["country"]).alias("countries"),
        F.min("at.day").alias("first_day"), F.max("last").alias("last_day"),
    )
    best = edges.join(members.select(F.col("node").alias("i"), "component"), "i").groupBy("component").agg(F.max("sim").alias("max_sim"))
    return rows.join(best, "component").withColumn("span", F.col("last_day") - F.col("first_day"))


def pair_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """How often a country precedes another: ``pair`` is ``A>B`` by day, then by id."""
    m = members.select("node", "day", "country")
    rows = edges.join(m.toDF("i", "d1", "c1"), "i").join(m.toDF("j", "d2", "c2"), "j")
    first = F.col("d1") <= F.col("d2")
    return rows.groupBy(F.concat(F.when(first, F.col("c1")).otherwise(F.col("c2")), F.lit(">"), F.when(first, F.col("c2")).otherwise(F.col("c1"))).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def histogram(edges: DataFrame, low: float, step: float) -> DataFrame:
    """Counts of similarities in steps."""
    return edges.groupBy(F.floor((F.col("sim") - low) / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str = "embedding", normalised: bool = True) -> DataFrame:
    """``keys, n, centroid``: element-wise means, of unit length if ``normalised``. Sums run by (key, position) with map-side combining."""
    long = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = long.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
    return out.withColumn("centroid", unit(F.col("centroid"))) if normalised else out


def centred(rows: DataFrame, lang: str, vector: str = "embedding", least: int = 20) -> DataFrame:
    """Vectors minus their language's mean (of languages with at least ``least`` rows), unit length."""
    means = mean_vectors(rows, [lang], vector, normalised=False).filter(F.col("n") >= least).select(F.col(lang).alias("__l"), F.col("centroid").alias("__m"))
    out = rows.join(small(means), F.col(lang) == F.col("__l"), "left")
    moved = F.when(F.col("__m").isNotNull(), F.zip_with(vector, "__m", lambda x, m: x.cast("double") - m)).otherwise(F.transform(vector, lambda x: x.cast("double")))
    return out.withColumn(vector, unit(moved)).drop("__l", "__m")


def assign(rows: DataFrame, centroids: DataFrame, vector: str = "embedding", key: str = "topic") -> DataFrame:
    """Adds ``topic, sim`` of the nearest centroid (ties: the smaller topic).

    Centroids (``topic, centroid``) are a model's and few: the driver reads them and
    each Arrow batch is one matrix product with them.
    """
    model = sorted(((r[key], r["centroid"]) for r in centroids.select(key, "centroid").collect()), key=lambda x: x[0])
    topics, matrix = [t for t, _ in model], np.array([c for _, c in model], np.float64)
    kind, at = pa.int32() if dict(centroids.dtypes)[key] == "int" else pa.int64(), rows.columns.index(vector)
    names = [*rows.columns, "topic", "sim"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at))
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            sims = np.divide(x, length, out=x.copy(), where=length > 0) @ matrix.T
            best = sims.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([topics[i] for i in best], kind), pa.array(sims[np.arange(len(x)), best])], names=names)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(nearest, f"{schema}, topic {dict(centroids.dtypes)[key]}, sim double")


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of vectors of one length as a matrix."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def exemplars(assigned: DataFrame, k: int = 3, pool: int = 400, key: str = "vec_id") -> DataFrame:
    """Per topic ``k`` rows nearest the centroid from its best ``pool``: the best of distinct countries first, then others."""
    w = Window.partitionBy("topic").orderBy(F.desc("sim"), key)
    rows = assigned.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") <= pool)
    rows = rows.withColumn("__c", F.row_number().over(Window.partitionBy("topic", "country").orderBy("__p")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.when(F.col("__c") == 1, 0).otherwise(1), "__p")))
    return rows.filter(F.col("place") <= k).drop("__p", "__c")


def fit_topics(rows: DataFrame, ks: Sequence[int], vector: str = "embedding", seed: int = 7, sample: float = 1.0) -> tuple[int, DataFrame]:
    """The number of clusters with the best cosine silhouette, and the centroids ``topic, centroid``."""
    data = rows.select(array_to_vector(unit(F.col(vector))).alias("features"))
    data = (data.sample(sample, seed) if sample < 1 else data).persist()
    best = None
    for k in ks:
        model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(data)
        score = ClusteringEvaluator(distanceMeasure="cosine").evaluate(model.transform(data))
        if best is None or score > best[0]:
            best = (score, k, model)
    data.unpersist()
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(best[2].clusterCenters())]
    return best[1], rows.sparkSession.createDataFrame(centres, "topic int, centroid array<double>").withColumn("centroid", unit(F.col("centroid")))


def topic_terms(docs: DataFrame, tokens: Column, k: int = 8, least: int = 3, topic_least: int = 50) -> DataFrame:
    """c-TF-IDF per language: ``lang, topic, terms``, the ``k`` words of the highest weight.

    Weight of a word in a topic: its documents' share of the topic's, times the log of
    1 + (mean words of a topic) / (documents of the word over all topics).
    """
    df = docs.select("lang", "topic", F.explode(F.array_distinct(tokens)).alias("word")).groupBy("lang", "topic", "word").agg(F.count(F.lit(1)).alias("v"))
    of_word, of_topic = Window.partitionBy("lang", "word"), Window.partitionBy("lang", "topic")
    rows = df.withColumn("f", F.sum("v").over(of_word)).withColumn("total", F.sum("v").over(of_topic))
    mean = rows.groupBy("lang").agg((F.sum("v") / F.count_distinct("topic")).alias("mean"))
    rows = rows.filter((F.col("v") >= least) & (F.col("total") >= topic_least)).join(small(mean), "lang")
    rows = rows.withColumn("weight", F.col("v") / F.col("total") * F.log(1 + F.col("mean") / F.col("f")))
    rows = rows.withColumn("r", F.row_number().over(of_topic.orderBy(F.desc(F.round("weight", 9)), "word"))).filter(F.col("r") <= k)
    return rows.groupBy("lang", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("terms"))


def prevalence(docs: DataFrame, stream: str = "stream", least: int = 5) -> DataFrame:
    """``country, period, topic, n, share, balanced``: the raw share, and the mean of stream shares weighted by the streams' documents, over stream periods of at least ``least``."""
    cell = docs.groupBy("country", stream, "period", "topic").agg(F.count(F.lit(1)).alias("k"))
    total = docs.groupBy("country", stream, "period").agg(F.count(F.lit(1)).alias("n"))
    weight = docs.groupBy(stream).agg(F.count(F.lit(1)).alias("w"))
    big = total.filter(F.col("n") >= least).join(weight, stream)
    bottom = big.groupBy("country", "period").agg(F.sum("w").alias("bottom"))
    top = cell.join(big, ["country", stream, "period"]).groupBy("country", "period", "topic").agg(F.sum(F.col("w") * F.col("k") / F.col("n")).alias("top"))
    raw = cell.groupBy("country", "period", "topic").agg(F.sum("k").alias("n")).join(total.groupBy("country", "period").agg(F.sum("n").alias("all")), ["country", "period"])
    out = raw.join(top, ["country", "period", "topic"], "left").join(bottom, ["country", "period"], "left")
    return out.select("country", "period", "topic", "n", (F.col("n") / F.col("all")).alias("share"), (F.coalesce("top", F.lit(0.0)) / F.col("bottom")).alias("balanced"))


def template_titles(passages: DataFrame, title_key: Column, least: int = 3) -> DataFrame:
    """Adds ``template``: whether a title passage's normalised title occurs at least ``least`` times among its source's title passages."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source", "__k"))
    return passages.withColumn("__k", title_key).withColumn("template", n >= least).drop("__k")


def echo_candidates(passages: DataFrame, title_key: Column, least: int = 60, least_cjk: int = 24, framing: Sequence[str] = ("article", "headline")) -> DataFrame:
    """Passages worth comparing: long enough for their script, dated, no template title; titles only of articles and headlines.

    Columns read: ``source, lang, date, kind, text, is_title``.
    """
    long = F.length("text") >= F.when(F.col("lang").isin("zh", "ko", "ja"), least_cjk).otherwise(least)
    titles = template_titles(passages.filter("is_title"), title_key).filter("NOT template").drop("template")
    rows = passages.filter("NOT is_title").unionByName(titles.filter(F.col("kind").isin(list(framing))))
    return rows.filter(long & F.col("date").isNotNull())


def top_clusters(members: DataFrame, most: int = 500, shown: int = 12) -> DataFrame:
    """The widest clusters with their first members: ``place, component, n_countries, n_members, countries, official, first_day, members``.

    Order: more countries, more official countries, more members, the later first day,
    then the smaller component. ``members`` has ``component, node, day, country, outlet``;
    of each cluster only the first ``shown`` by day are gathered, whatever its size.
    """
    first = Window.partitionBy("component").orderBy("day", "node")
    heads = members.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= shown).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "node"))), lambda x: x["node"]).alias("members"))
    seen = members.groupBy("component", "country").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("day", "node")).alias("at"), F.min(F.when(F.col("outlet") == "official", F.struct("day", "node"))).alias("off"))
    names = lambda at: F.transform(F.array_sort(F.filter(F.collect_list(F.struct(F.col(at).alias("at"), "country")), lambda x: x["at"].isNotNull())), lambda x: x["country"])
    sizes = seen.groupBy("component").agg(F.sum("k").alias("n_members"), names("at").alias("countries"), names("off").alias("official"), F.min("at.day").alias("first_day"))
    rows = sizes.withColumn("n_countries", F.size("countries"))
    best = rows.orderBy(F.desc("n_countries"), F.desc(F.size("official")), F.desc("n_members"), F.desc("first_day"), "component").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("n_countries"), F.desc(F.size("official")), F.desc("n_members"), F.desc("first_day"), "component"))  # of at most ``most`` rows
    return best.withColumn("place", place).join(heads, "component")


def cluster_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``component, a, b, sim``: edges by the members' places in their cluster (by day, then id; from 0)."""
    placed = members.select("component", "node", (F.row_number().over(Window.partitionBy("component").orderBy("day", "node")) - 1).alias("p"))
    rows = edges.join(placed.select("component", F.col("node").alias("i"), F.col("p").alias("pi")), "i").join(placed.select(F.col("node").alias("j"), F.col("p").alias("pj")), "j")
    return rows.select("component", F.least("pi", "pj").alias("a"), F.greatest("pi", "pj").alias("b"), F.round("sim", 4).alias("sim")).distinct()


def counters(rows: DataFrame, key: str, value: str, missing: str = "?") -> DataFrame:
    """``key, counts``: how often each value occurs, commonest first (ties by name), as ``struct<value, n>``."""
    n = rows.groupBy(key, F.coalesce(F.col(value), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "value")))
    return n.groupBy(key).agg(F.transform(order, lambda x: F.struct(x["value"].alias("value"), (-x["neg"]).alias("n"))).alias("counts"))
