"""Within-stream series: aggregation, calendar filling, rolling baselines, flags, runs and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def period_of(date: Column, period: str) -> Column:
    """The period's first day (weeks start on Monday); null for an unreadable date."""
    return F.date_trunc(period, date).cast("date")


def stream_of(source: Column, lang: Column, sample: Column) -> Column:
    """The unit within which every series is computed."""
    return F.concat_ws("|", source, F.coalesce(lang, F.lit("?")), F.coalesce(sample, F.lit("all")))


def stream_series(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str]) -> DataFrame:
    """``keys, period, metric, n, mean, sd, se``: sample deviation, 0 for a single row; null values don't count."""
    long = df.select(*keys, period, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(*keys, period, "x.*")
    out = long.groupBy(*keys, F.col(period).alias("period"), "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return out.withColumn("se", F.col("sd") / F.sqrt(F.greatest("n", F.lit(1))))


def share_series(hits: DataFrame, totals: DataFrame, keys: Sequence[str], streams: Sequence[str] = ("stream",)) -> DataFrame:
    """Share of ``n`` documents of a stream's period that have a key value: k = 0 where none has.

    ``hits`` has ``streams, period, keys, k``; ``totals`` has ``streams, period, n``. Every
    key value a stream has (few) meets all periods of the stream.
    """
    values = hits.select(*streams, *keys).distinct()
    grid = totals.join(values, list(streams))
    rows = grid.join(hits, [*streams, "period", *keys], "left").fillna({"k": 0})
    p, soft = F.col("k") / F.col("n"), (F.col("k") + 0.5) / (F.col("n") + 1)
    return rows.select(*streams, "period", *keys, "n", "k", p.alias("mean"), F.sqrt(p * (1 - p)).alias("sd"), F.sqrt(soft * (1 - soft) / F.col("n")).alias("se"))


def fill_calendar(series: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Every period from a series' first to its last; added ones have n = 0 and nulls."""
    span = series.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    grid = span.select(*keys, F.explode(F.expr(f"sequence(lo, hi, {STEP[period]})")).alias("period"))
    return grid.join(series, [*keys, "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rolling_z(series: DataFrame, keys: Sequence[str], window: int = 12, min_base: int = 6, min_n: int = 8, floor: float = 0.01, binomial: bool = False) -> DataFrame:
    """Adds ``base, delta, z`` against the valid ones of the previous ``window`` calendar periods.

    A period is valid with n >= ``min_n``; null where it is not, or where fewer than
    ``min_base`` before it are. The series must have a row for every period.
    """
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-window, -1)
    valid = (F.col("n") >= min_n) & F.col("mean").isNotNull()
    good = F.when(valid, F.col("mean"))
    out = series.withColumn("__m", F.avg(good).over(w)).withColumn("__s", F.coalesce(F.stddev_samp(good).over(w), F.lit(0.0))).withColumn("__k", F.count(good).over(w))
    se = F.coalesce("se", F.lit(0.0))
    if binomial:
        se = F.greatest(F.sqrt(F.col("__m") * (1 - F.col("__m")) / F.col("n")), se)
    ok = valid & (F.col("__k") >= min_base)
    delta = F.col("mean") - F.col("__m")
    z = delta / F.greatest(F.sqrt(F.pow("__s", 2) + F.pow(se, 2)), F.lit(floor))
    return out.select(*series.columns, F.when(ok, F.col("__m")).alias("base"), F.when(ok, delta).alias("delta"), F.when(ok, z).alias("z"))


def combine(series: DataFrame, group: Sequence[str], min_n: int, stream: str = "stream") -> DataFrame:
    """Streams of a group by fixed weights (column ``w``): value, adjusted delta, Stouffer z, n, streams.

    All streams with n >= ``min_n`` give the value; only those with a delta give delta and z.
    """
    s = series.filter(F.col("n") >= min_n)
    has = F.col("delta").isNotNull()
    out = s.groupBy(*group).agg(
        (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("value"), F.sum("n").alias("n"), F.count_distinct(stream).alias("n_streams"),
        F.sum(F.when(has, F.col("w") * F.col("delta"))).alias("wd"), F.sum(F.when(has, F.col("w"))).alias("wdw"),
        F.sum(F.when(has, F.col("w") * F.col("z"))).alias("wz"), F.sum(F.when(has, F.pow("w", 2))).alias("w2"),
    )
    return out.select(*group, "value", (F.col("wd") / F.nullif("wdw", F.lit(0))).alias("adj_delta"), (F.col("wz") / F.sqrt(F.nullif("w2", F.lit(0)))).alias("z"), "n", "n_streams")


def flagged(df: DataFrame, z_min: float = 3.0, min_effect: float = 0.03) -> DataFrame:
    """Rows with \\|z\\| and \\|delta\\| of at least these; nulls never pass."""
    return df.filter((F.abs("z") >= z_min) & (F.abs("delta") >= min_effect))


def period_index(period: Column, unit: str) -> Column:
    """Consecutive numbers for consecutive periods."""
    if unit == "month":
        return F.year(period) * 12 + F.month(period)
    return F.floor(F.datediff(period, F.lit("1970-01-05").cast("date")) / (7 if unit == "week" else 1))


def merge_runs(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Consecutive flagged periods of a series and sign as one run: the peak row (largest \\|z\\|, earliest of equal), ``start, end, n_periods``."""
    sign = F.signum("z").cast("int")
    order = F.row_number().over(Window.partitionBy(*keys, "dir").orderBy("period"))
    rows = df.withColumn("dir", sign).withColumn("island", period_index(F.col("period"), unit) - order)
    others = [c for c in df.columns if c not in keys]
    peak = F.max_by(F.struct(*others), F.struct(F.abs("z"), -F.datediff("period", F.lit("1970-01-01"))))
    out = rows.groupBy(*keys, "dir", "island").agg(peak.alias("p"), F.min("period").alias("start"), F.max("period").alias("end"), F.count(F.lit(1)).alias("n_periods"))
    return out.select(*keys, *(F.col(f"p.{c}") for c in others), "dir", "start", "end", "n_periods")


def tier(z: Column, n_periods: Column) -> Column:
    """Strength of an alert."""
    return F.when(F.abs(z) >= 4.5, "strong").when((F.abs(z) >= 3.5) | (n_periods >= 2), "moderate").otherwise("weak")


def tail_counts(df: DataFrame) -> DataFrame:
    """Observed share of \\|z\\| beyond fixed cuts and what a normal distribution expects."""
    #: 2 * (1 - Phi(cut)).
    expected = {3.0: 0.0026998, 3.5: 0.00046526, 4.0: 0.00006334, 4.5: 0.0000067953}
    n = F.count("z")
    parts = [F.struct(F.lit(c).alias("cut"), F.count_if(F.abs("z") >= c).alias("seen"), n.alias("tests"), F.lit(e).alias("share_expected")) for c, e in expected.items()]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def qualifying_z(df: DataFrame, keys: Sequence[str], value: str, window: int = 12, least: int = 6) -> DataFrame:
    """z of each qualifying row against up to ``window`` qualifying rows before it (not calendar periods), population deviation."""
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-window, -1)
    m, s, k = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)
    return df.withColumn("z", F.when((k >= least) & (s > 0), (F.col(value) - m) / s))


def spikes(df: DataFrame, keys: Sequence[str], q: float = 0.9, min_delta: float = 0.02, z_min: float = 1.5, least: int = 10) -> DataFrame:
    """Rows whose delta reaches the series' quantile ``q`` (and ``min_delta``) with z >= ``z_min``, in series of at least ``least`` valid rows."""
    w = Window.partitionBy(*keys)
    rows = df.filter("delta IS NOT NULL").withColumn("cut", F.greatest(F.percentile("delta", F.lit(q)).over(w), F.lit(min_delta))).withColumn("valid", F.count(F.lit(1)).over(w))
    return rows.filter((F.col("valid") >= least) & (F.col("delta") >= F.col("cut")) & (F.col("z") >= z_min))


def volume_flags(df: DataFrame, keys: Sequence[str], unit: str = "month") -> DataFrame:
    """First and last period of a series, and jumps: n at least 3 times or at most a third of the median of the 3 before."""
    w, whole = Window.partitionBy(*keys).orderBy("period"), Window.partitionBy(*keys)
    lags = F.sort_array(F.array(*(F.lag("n", i).over(w) for i in (1, 2, 3))))
    median = F.when(F.lag("n", 3).over(w).isNotNull(), lags[1])
    rows = df.withColumn("prior", median).withColumn("first", F.min("period").over(whole)).withColumn("last", F.max("period").over(whole))
    kind = F.when(F.col("period") == F.col("first"), "start").when(F.col("period") == F.col("last"), "end").when(F.col("n") >= 3 * F.col("prior"), "jump_up").when(F.col("n") * 3 <= F.col("prior"), "jump_down")
    return rows.withColumn("flag", kind).drop("first", "last")


def columnar(df: DataFrame, keys: Sequence[str], fields: Sequence[str], drop_empty: str | None = None) -> DataFrame:
    """One row per series with aligned arrays, ordered by period; series with a zero sum of ``drop_empty`` are dropped."""
    rows = F.array_sort(F.collect_list(F.struct("period", *fields)))
    aggs = [rows.alias("r")] + ([F.sum(drop_empty).alias("__sum")] if drop_empty else [])
    out = df.groupBy(*keys).agg(*aggs)
    if drop_empty:
        out = out.filter("__sum > 0")
    return out.select(*keys, *(F.col(f"r.{c}").alias(c) for c in ("period", *fields)))
