"""What winning and losing events have in common: fixed bins, favourable factors, combinations and the profile of losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.series import lit

#: Edges of half-open bins.
BINS = {"RSI14": (0, 30, 40, 50, 60, 70, 100), "boll_pos": (-10, 0.2, 0.4, 0.6, 0.8, 1, 10), "vol_ratio": (0, 0.8, 1.2, 2, 5, 100), "score": (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 1.01)}
#: What makes each of six factors favourable.
FAVOURABLE = {"rsi": "RSI14 >= 40 AND RSI14 <= 65", "boll": "boll_pos >= 0.3D AND boll_pos <= 0.8D", "ma_bull": "ma_bull = 1", "dif": "DIF > 0", "trend": "trend = 'up'", "score": "score >= 0.85D"}
#: Combinations, by the conditions that they need.
COMBINATIONS = {"trend_bull_dif": "trend = 'up' AND ma_bull = 1 AND DIF > 0", "trend_rsi_score": "trend = 'up' AND RSI14 >= 40 AND RSI14 <= 65 AND score >= 0.85D",
    "neckline_trend_dif": "pattern = 'm_neckline' AND trend = 'up' AND DIF > 0", "box_trend_volume": "pattern = 'box_breakout' AND trend = 'up' AND vol_ratio > 1.5D"}
#: Conditions that go with losses.
RISKS = {"rsi_over_75": "RSI14 > 75", "above_upper_band": "boll_pos > 1", "trend_down": "trend = 'down'"}
PROFILE, LOSS = ("RSI14", "boll_pos", "KDJ_J", "vol_ratio", "BIAS60", "score"), -0.05


def _holds(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def _rates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ret_10") > 0).cast("double")).alias("win_10"), F.avg("ret_10").alias("avg_10"))


def bin_rates(events: DataFrame, bins: dict[str, tuple[float, ...]] = BINS, more_than: int = 10) -> DataFrame:
    """(field, bin, low, high, n, win_10, avg_10): outcomes by half-open bin of each field, where a bin has enough events; values outside all bins are left out."""
    each = []
    for field, edges in bins.items():
        ends = F.array(*map(lit, edges))
        value = F.col(field)
        at = F.aggregate(ends, F.lit(0), lambda n, e: n + (e <= value).cast("int"))  # noqa: B023  evaluated at once
        each.append(F.when(F.col(field).isNotNull() & (at > 0) & (at < len(edges)), F.struct(F.lit(field).alias("field"), at.alias("bin"), F.try_element_at(ends, at).alias("low"),
            F.try_element_at(ends, at + 1).alias("high"))))
    rows = events.where("ret_10 is not null").select("ret_10", F.explode(F.array_compact(F.array(*each))).alias("b")).select("ret_10", "b.*")
    return _rates(rows, "field", "bin", "low", "high").where(F.col("n") > more_than)


def resonance(events: DataFrame) -> DataFrame:
    """(part, item, n, win_10, avg_10) by the number of favourable factors (five events at least), by each factor on and off (eleven) and by combination (ten)."""
    def item(part: str, name: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), name.alias("item"))

    number = sum((_holds(c).cast("int") for c in FAVOURABLE.values()), F.lit(0))
    each = [item("count", number.cast("string"))]
    each += [item("factor", F.concat(F.lit(f"{k}:"), F.when(_holds(c), "on").otherwise("off"))) for k, c in FAVOURABLE.items()]
    each += [F.when(_holds(c), item("combination", F.lit(k))) for k, c in COMBINATIONS.items()]
    rows = events.where("ret_10 is not null").select("ret_10", F.explode(F.array_compact(F.array(*each))).alias("i")).select("ret_10", "i.*")
    least = F.when(F.col("part") == "count", 5).when(F.col("part") == "factor", 11).otherwise(10)
    return _rates(rows, "part", "item").where(F.col("n") >= least)


def loser_profile(events: DataFrame) -> DataFrame:
    """(part, item, n, value, avg_10): the share of events that lost over 5 %, the means of their indicators, their trends, and win rates under each risk with six events or more."""
    lost, won = F.col("ret_10") < LOSS, (F.col("ret_10") > 0).cast("double")

    def item(part: str, name: Column, x: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), name.alias("item"), x.cast("double").alias("x"))

    each = [item("losers", F.lit("share"), lost), F.when(lost & F.col("trend").isNotNull(), item("trend", F.col("trend"), F.lit(None)))]
    each += [F.when(lost & F.col(c).isNotNull(), item("mean", F.lit(c), F.col(c))) for c in PROFILE]
    each += [F.when(_holds(c), item("risk", F.lit(k), won)) for k, c in RISKS.items()]
    rows = events.where("ret_10 is not null").select("ret_10", F.explode(F.array_compact(F.array(*each))).alias("i")).select("ret_10", "i.*")
    out = rows.groupBy("part", "item").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("value"), F.avg("ret_10").alias("avg_10"))
    return out.where((F.col("part") != "risk") | (F.col("n") > 5))
