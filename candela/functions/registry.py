"""Features by name, and the functions that SQL may call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES: dict[str, Callable[[DataFrame], DataFrame]] = {}
PROVIDERS: dict[str, object] = {}


def _register(table: dict, name: str):
    def decorate(value):
        if name in table:
            raise ValueError(f"registered already: {name}")
        table[name] = value
        return value

    return decorate


def register_feature(name: str):
    """A decorator that puts a function from bars to bars with more columns under a name."""
    return _register(FEATURES, name)


def register_provider(name: str):
    """A decorator that puts a source of bars under a name."""
    return _register(PROVIDERS, name)


def with_features(bars: DataFrame, *names: str) -> DataFrame:
    """Bars with the columns of several features, in the order given."""
    for name in names:
        bars = FEATURES[name](bars)
    return bars


def register_functions(spark: SparkSession) -> None:
    """Make ``score_range(value, ideal_low, ideal_high, low, high)`` and ``warp(a, b)`` callable from SQL."""
    from candela.operators.similarity import warp

    @F.pandas_udf("double")
    def score_range(v: pd.Series, a: pd.Series, b: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        below = np.where(a > lo, (v - lo) / np.where(a > lo, a - lo, 1), 0)
        above = np.where(hi > b, (hi - v) / np.where(hi > b, hi - b, 1), 0)
        out = np.where(v.between(a, b), 1.0, np.maximum(np.where(v < a, below, above), 0))
        return pd.Series(np.where(v.isna(), 0.0, out))

    @F.pandas_udf("double")
    def warped(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else warp(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)])

    spark.udf.register("score_range", score_range)
    spark.udf.register("warp", warped)
