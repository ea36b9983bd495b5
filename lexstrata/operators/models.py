"""Injectable encoders and scorers, with deterministic built-in ones that need no model files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.math import linear, per_mille, sigmoid
from lexstrata.functions.text import clean, crc31, index_terms


class Encoder(Protocol):
    """Anything that adds a unit vector ``embedding`` for a text column."""

    def encode(self, df: DataFrame, text: str) -> DataFrame: ...


class HashingEncoder:
    """Hashed bags of index terms of unit length. A neural encoder has the same interface (see ``predict_batch_udf``)."""

    def __init__(self, size: int = 256):
        self.size = size

    def encode(self, df: DataFrame, text: str) -> DataFrame:
        rows = df.withColumn("__w", index_terms(clean(F.col(text))))
        rows = HashingTF(numFeatures=self.size, inputCol="__w", outputCol="__f").transform(rows)
        rows = Normalizer(inputCol="__f", outputCol="__u").transform(rows)
        return rows.withColumn("embedding", vector_to_array("__u", "float32")).drop("__w", "__f", "__u")


class Teacher(Protocol):
    """Anything that adds a probability for each dimension."""

    def label(self, df: DataFrame, text: str) -> DataFrame: ...


class PatternTeacher:
    """Probabilities from pattern counts: 1 - 2^-hits. Stands in for a zero-shot model."""

    def __init__(self, patterns: dict[str, str]):
        self.patterns = patterns

    def label(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumns({d: 1 - F.pow(F.lit(2.0), -F.regexp_count(F.col(text), F.lit(f"(?iU){p}"))) for d, p in self.patterns.items()})


def relabel(labels: DataFrame, fresh: DataFrame, dims: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Labels with only ``dims`` taken from a new run."""
    new = fresh.select(*key, *(F.col(d).alias(f"__{d}") for d in dims))
    return labels.join(new, list(key), "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in dims else F.col(c) for c in labels.columns))


def score_sentences(sents: DataFrame, weights: dict[str, tuple[list[float], float]], vector: str = "embedding", text: str = "sent") -> DataFrame:
    """``doc_id, idx, crc`` and each dimension from 0 to 1000 by a linear student model."""
    return sents.select("doc_id", "idx", crc31(F.col(text)).alias("crc"), *(per_mille(sigmoid(linear(F.col(vector), w, b))).alias(d) for d, (w, b) in weights.items()))


def doc_tone(docs: DataFrame, scores: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``doc_id, nsent`` and means from 0 to 1; null for documents without a scored sentence."""
    means = scores.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), *((F.avg(d) / 1000).alias(d) for d in dims))
    return docs.select("doc_id").join(means, "doc_id", "left").select("doc_id", F.coalesce("__n", F.lit(0)).alias("nsent"), *dims)


def current(scores: DataFrame, sents: DataFrame, text: str = "sent") -> DataFrame:
    """Scores whose sentence is still the one that was scored."""
    now = sents.select("doc_id", "idx", F.col(text), crc31(F.col(text)).alias("crc"))
    return scores.join(now, ["doc_id", "idx", "crc"])


def needs_refit(n_now: int, n_fitted: int, growth: float) -> bool:
    """Whether a corpus or label set has grown enough for another fit."""
    return n_fitted == 0 or n_now >= n_fitted * (1 + growth)


def weights_of(model) -> tuple[list[float], float]:
    """Literal weights of a fitted logistic regression."""
    return [float(x) for x in model.coefficients], float(model.intercept)


def newest_first(rows: DataFrame, date: Column, most: int) -> DataFrame:
    """A bounded work queue."""
    return rows.orderBy(F.desc(date)).limit(most)


def esc_balance(escalation: Column, deescalation: Column) -> Column:
    """How much escalation outweighs de-escalation; null if either is."""
    return escalation - deescalation
