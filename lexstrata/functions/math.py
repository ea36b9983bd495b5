"""Numbers: logistic scores, log loss, ranks of alerts, the normal distribution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def linear(vector: Column, weights: list[float], bias: float) -> Column:
    """w.x + b with weights that are few and literal."""
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, weights)), lambda x, w: x.cast("double") * w), F.lit(float(bias)), lambda s, v: s + v)


def per_mille(p: Column) -> Column:
    """0 to 1000, halves to the even number."""
    return F.bround(p * 1000).cast("int")


def soft_log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def alert_score(z: Column, n: Column) -> Column:
    return F.abs(z) * F.log10(n + 10)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else 0.5 * (1 + math.erf(v / math.sqrt(2))))
