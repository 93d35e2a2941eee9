"""Window and scoring expressions that operators share."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = "symbol") -> WindowSpec:
    """The last n rows, the current one included."""
    return by_symbol(key).rowsBetween(-(n - 1), 0)


def prior(n: int, key: str = "symbol") -> WindowSpec:
    """The n rows before the current one."""
    return by_symbol(key).rowsBetween(-n, -1)


def full(n: int, value: Column, window: WindowSpec, over: str) -> Column:
    """``value`` over the window where ``over`` has n values in it, else null."""
    return F.when(F.count(over).over(window) == n, value.over(window))


def sliding_extremes(frame: DataFrame, wanted: dict[str, tuple[str, Callable, int]]) -> DataFrame:
    """``frame`` with the extremes of each symbol's last n rows: name -> (column, ``F.greatest`` or ``F.least``, n).

    A frame of 2p rows is two frames of p, and one of n rows two that overlap; so a row costs a few steps back instead of
    the n comparisons of a sliding frame.  Rows before the first do not count.
    """
    w, made = by_symbol(), {}
    kinds = {(column, pick): max(n for c, f, n in wanted.values() if (c, f) == (column, pick)) for column, pick, _ in wanted.values()}
    for i, (kind, most) in enumerate(kinds.items()):
        made[kind] = f"_x{i}"
        frame = frame.withColumn(f"_x{i}_1", F.col(kind[0]))
    p = 1
    while any(2 * p <= most for most in kinds.values()):
        frame = frame.withColumns({f"{made[k]}_{2 * p}": k[1](F.col(f"{made[k]}_{p}"), F.lag(f"{made[k]}_{p}", p).over(w)) for k, most in kinds.items() if 2 * p <= most})
        p *= 2
    out = {}
    for name, (column, pick, n) in wanted.items():
        half = f"{made[column, pick]}_{1 << (n.bit_length() - 1)}"
        rest = n - (1 << (n.bit_length() - 1))
        out[name] = pick(F.col(half), F.lag(half, rest).over(w)) if rest else F.col(half)
    kept = frame.columns
    return frame.withColumns(out).select(*[c for c in kept if not c.startswith("_x")], *out)


def lit(x: float) -> Column:
    """A double literal; decimals would change the arithmetic."""
    return F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, lit(0))


def score_range(v: Column, ideal_low: float, ideal_high: float, low: float, high: float) -> Column:
    """1 in the ideal range, falling in a line to 0 at the tolerated limits; null scores 0."""
    below = (v - lit(low)) / lit(ideal_low - low) if ideal_low > low else lit(0)
    above = (lit(high) - v) / lit(high - ideal_high) if high > ideal_high else lit(0)
    inside = v.between(ideal_low, ideal_high)
    return F.coalesce(F.when(inside, lit(1)).when(v < ideal_low, F.greatest(below, lit(0))).otherwise(F.greatest(above, lit(0))), lit(0))


def rounded(columns: list[str], digits: int = 6) -> list[Column]:
    """Rounded columns; adding zero makes a negative zero positive."""
    return [(F.round(c, digits) + lit(0)).alias(c) for c in columns]


def round_product(x: Column, digits: int) -> Column:
    """x rounded by way of its product with a power of ten, as SQL engines in C do; ``F.round`` rounds the decimal that x is written as."""
    power = lit(10**digits)
    return F.round(x * power) / power


def typed(rows: list[dict], schema: str) -> pd.DataFrame:
    """Records as a frame of a flat schema's columns; missing values are nulls, and no record at all is an empty frame."""
    kinds = {"long": "Int64", "int": "Int32", "double": "Float64"}
    fields = [x.split() for x in schema.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=kinds.get(kind, object)) for c, kind in fields})
