"""Deterministic samples, splits, quotas and orders, and agreement between coders."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.sources.shared import small


def held_out(key: Column, share: float = 0.2) -> Column:
    """Whether a key belongs to the hold-out: its CRC-32 modulo 1000."""
    return F.crc32(key.cast("string").cast("binary")) % 1000 < int(share * 1000)


def hash_rank(seed: str, key: Column) -> Column:
    """A uniform number from a seed and a key: the first 16 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), key.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def scattered(key: Column) -> Column:
    """A pseudo-random order of numbers: times a constant modulo 2^32."""
    product = F.crc32(key.cast("string").cast("binary")).cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)")  # beyond 64 bits
    return F.pmod(product, F.lit(4294967296).cast("decimal(10,0)")).cast("long")


def bit_reversed(i: Column, bits: int) -> Column:
    """The van der Corput order of numbers below 2^bits."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def quotas(sizes: DataFrame, total: int, low: int, high: int) -> DataFrame:
    """``quota`` of each stratum (column ``n``): in proportion to the root of its size, between ``low`` and ``high``, never over n."""
    share = F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy())
    return sizes.withColumn("quota", F.least(F.greatest(F.round(share * total), F.lit(low)), F.lit(high), F.col("n")).cast("long"))


def allocate(sizes: DataFrame, total: int, key: str) -> DataFrame:
    """``seats`` by roots of sizes and largest remainders; they add up to ``total``. Strata are few."""
    exact = F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy()) * total
    rows = sizes.withColumn("__e", exact).withColumn("__f", F.floor("__e"))
    left = F.lit(total) - F.sum("__f").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__e") - F.col("__f"), 9)), key))
    return rows.withColumn("seats", (F.col("__f") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("__e", "__f")


def stratified(rows: DataFrame, strata: Sequence[str], limit: str, seed: str, key: str) -> DataFrame:
    """The first ``limit`` (a column) rows of each stratum by seeded hash."""
    w = Window.partitionBy(*strata).orderBy(hash_rank(seed, F.col(key)), key)
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.col(limit))


def band(rows: DataFrame, strata: Sequence[str], seed: str, key: str, lo: int, hi: int) -> DataFrame:
    """Rows with a hash rank from ``lo`` (exclusive) to ``hi`` in their stratum: passes over a capped sample."""
    w = Window.partitionBy(*strata).orderBy(hash_rank(seed, F.col(key)), key)
    return rows.withColumn("pos", F.row_number().over(w)).filter(f"pos > {lo} AND pos <= {hi}")


def active_pool(rows: DataFrame, dims: Sequence[str], per_dim: int, key: str) -> DataFrame:
    """The ``per_dim`` highest rows of each dimension in turn, none twice: ``key, dim``."""
    out = None
    for d in dims:
        left = rows if out is None else rows.join(small(out.select(key)), key, "left_anti")
        top = left.orderBy(F.desc(d), key).limit(per_dim).select(key, F.lit(d).alias("dim"))
        out = top if out is None else out.unionByName(top)
    return out


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where a side is constant (the builtin raises in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement of two 0/1 codes: ``n, accuracy, kappa, f1, pearson, rate_a, rate_b``; nulls don't count."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("accuracy"), F.avg(x).alias("rate_a"), F.avg(y).alias("rate_b"),
        F.sum(x * y).alias("__both"), F.sum(x + y).alias("__any"), correlation(x, y).alias("pearson"),
    )
    chance = F.col("rate_a") * F.col("rate_b") + (1 - F.col("rate_a")) * (1 - F.col("rate_b"))
    kappa = F.when(chance < 1, (F.col("accuracy") - chance) / (1 - chance))
    return g.select(*keys, "n", "accuracy", kappa.alias("kappa"), F.when(F.col("__any") > 0, 2 * F.col("__both") / F.col("__any")).alias("f1"), "pearson", "rate_a", "rate_b")


def average_rank(of: Column, keys: Sequence[str] = ()) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(of)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, of)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Correlation of average ranks within each key."""
    rows = df.withColumn("__a", average_rank(F.col(a), keys)).withColumn("__b", average_rank(F.col(b), keys))
    return rows.groupBy(*keys).agg(correlation(F.col("__a"), F.col("__b")).alias("spearman"))


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve by rank sums within each key; null without both classes."""
    rows = df.withColumn("__r", average_rank(F.col(score), keys))
    g = rows.groupBy(*keys).agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("s"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def krippendorff(codes: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """Nominal alpha of a long table of codes; units with one code don't count; null if all values are equal."""
    by_value = codes.filter(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("k"))
    rows = by_value.withColumn("m", F.sum("k").over(Window.partitionBy(unit))).filter("m >= 2")
    observed = rows.agg(F.sum(F.col("k") * (F.col("m") - F.col("k")) / (F.col("m") - 1)).alias("do"))
    margins = rows.groupBy(value).agg(F.sum("k").alias("nv"))
    expected = margins.agg(F.sum("nv").alias("n"), F.sum(F.col("nv") * F.col("nv")).alias("sq"))
    both = observed.crossJoin(expected)
    bottom = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)
    return both.select(F.when(bottom > 0, 1 - F.col("do") / bottom).alias("alpha"), F.col("n").cast("long").alias("n"))


def fit_soft(df: DataFrame, features: str, target: str, keys: str, regs: Sequence[float] = (0.01, 0.1, 1.0)):
    """Logistic regression on soft labels: each row twice, with weights p and 1 - p; the strength by 3-fold log loss over CRC folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    p = F.col(target).cast("double")
    two = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), p.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - p).alias("weight"))))
    rows = df.select(features, target, (F.crc32(F.col(keys).cast("string").cast("binary")) % 3).alias("fold"), two.alias("x")).select(features, target, "fold", "x.*").filter("weight > 0").persist()
    best = None
    for reg in regs:
        loss = 0.0
        for fold in range(3):
            model = LogisticRegression(featuresCol=features, weightCol="weight", regParam=reg).fit(rows.filter(F.col("fold") != fold))
            prob = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-6)), F.lit(1 - 1e-6))
            r = model.transform(rows.filter(F.col("fold") == fold)).agg(F.sum(-F.col("weight") * F.when(F.col("label") == 1, F.log(prob)).otherwise(F.log(1 - prob)))).first()[0]
            loss += r or 0.0
        if best is None or loss < best[0]:
            best = (loss, reg)
    model = LogisticRegression(featuresCol=features, weightCol="weight", regParam=best[1]).fit(rows)
    rows.unpersist()
    return model, best[1]


def calibrate_intercept(z: DataFrame, column: str, mean: float, bins: float = 0.01, tolerance: float = 1e-9) -> float:
    """The shift that gives a logistic score the mean ``mean``, within ``tolerance``, by Newton steps over a histogram of ``column`` (bounded by its range)."""
    rows = z.groupBy(F.round(F.col(column) / bins).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    values, n = np.array([r["b"] * bins for r in rows]), np.array([r["n"] for r in rows], np.float64)
    target = min(max(mean, 1e-6), 1 - 1e-6)
    shift = math.log(target / (1 - target)) - float(values @ n / n.sum())
    for _ in range(200):
        p = 0.5 * (1 + np.tanh((values + shift) / 2))
        gap, slope = float(p @ n / n.sum()) - target, float((p * (1 - p)) @ n / n.sum())
        if abs(gap) <= tolerance:
            break
        shift -= max(-2.0, min(2.0, gap / max(slope, 1e-12)))  # a long step would leave the range where the slope says anything
    return shift


def coder_agreement(coded: DataFrame, key: DataFrame, dims: Sequence[str], sample: str = "sample_id", coder: str = "coder", cut: float = 0.5) -> DataFrame:
    """Agreement of each coder's 0/1 codes with a scorer: ``coder, dim, n, accuracy, kappa, f1, pearson, ...``.

    ``coded`` and ``key`` meet on the sample's id; codes of unknown samples don't count.
    """
    both = coded.join(key.select(sample, *(F.col(d).alias(f"__{d}") for d in dims)), sample)
    long = both.select(coder, F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("int").alias("code"), (F.col(f"__{d}") >= cut).cast("int").alias("scored")) for d in dims))).alias("x")).select(coder, "x.*")
    return agreement(long, "code", "scored", [coder, "dim"])


def balanced(rows: DataFrame, strata: Sequence[str], most: int, key: str) -> DataFrame:
    """At most ``most`` rows of each stratum, chosen by a hash."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.col(key)), key)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def round_robin(rows: DataFrame, stratum: str, date: str, key: str) -> DataFrame:
    """Rows in turns: the newest of every stratum first, then the second newest of each."""
    w = Window.partitionBy(stratum).orderBy(F.desc(date), key)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", F.desc(date), key)


def id_gaps(rows: DataFrame, key: str, group: str, least: int = 2) -> DataFrame:
    """``group, after, missing``: holes in a sequence of numbers."""
    after = F.lead(key).over(Window.partitionBy(group).orderBy(key)) - F.col(key) - 1
    return rows.select(group, F.col(key).alias("after"), after.alias("missing")).filter(F.col("missing") >= least - 1)


def packet_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows for human coders in an order that says nothing about them."""
    return rows.orderBy(F.crc32(F.concat(F.lit("packet:"), F.col(key).cast("string")).cast("binary")), key)


def language_deficits(have: DataFrame, want: DataFrame, key: str = "lang") -> DataFrame:
    """``lang, missing``: how many more rows each language needs."""
    rows = want.select(key, F.col("n").alias("want")).join(have.select(key, F.col("n").alias("have")), key, "left")
    return rows.select(key, F.greatest(F.col("want") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("missing")).filter("missing > 0")
