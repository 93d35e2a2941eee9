"""Technical indicators and factors of bars.

Everything that looks at a fixed number of rows is a native window column over one shared partitioning.  Exponential
averages depend on all rows before, so they run once per symbol in one grouped map, for all series together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from candela.functions.series import by_symbol, full, lit, prior, ratio, trailing

MA_WINDOWS = (5, 10, 20, 30, 60, 100, 120, 200, 250)
RSI_PERIODS = (6, 14, 24)
RETURN_WINDOWS = (5, 10, 20, 60)
EXTREME_WINDOWS = (20, 60, 120)


def sma(n: int, of: str = "close") -> Column:
    return full(n, F.avg(of), trailing(n), of)


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def moving_averages(bars: DataFrame) -> DataFrame:
    return bars.select("*", *[sma(n).alias(f"MA{n}") for n in MA_WINDOWS], *[sma(n, "volume").alias(f"VOL_MA{n}") for n in (5, 10, 20)])


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid, dev = sma(n), full(n, F.stddev_samp("close"), trailing(n), "close")
    return bars.select("*", mid.alias("BOLL_MID"), (mid + dev * lit(width)).alias("BOLL_UPPER"), (mid - dev * lit(width)).alias("BOLL_LOWER"))


def atr(bars: DataFrame, n: int = 14, complete: bool = True) -> DataFrame:
    """Simple mean of the true range; ``complete``: null until there are n ranges."""
    ranged = bars.withColumn("TR", true_range())
    value = full(n, F.avg("TR"), trailing(n), "TR") if complete else F.avg("TR").over(trailing(n))
    return ranged.withColumn("ATR14", value)


def derived(frame: DataFrame) -> DataFrame:
    """Ratios, biases, returns and extremes on top of averages and ATR."""
    out = [ratio(F.col("volume"), F.col(f"VOL_MA{n}")).alias(f"VOL_RATIO{n}") for n in (5, 20)]
    out += [ratio(F.col("ATR14"), F.col("close")).alias("ATR_PCT")]
    out += [(ratio(F.col("close"), F.col(f"MA{n}")) - lit(1)).alias(f"BIAS{n}") for n in (20, 60, 250)]
    out += [(ratio(F.col("close"), F.lag("close", n).over(by_symbol())) - lit(1)).alias(f"RETURN_{n}") for n in RETURN_WINDOWS]
    for n in EXTREME_WINDOWS:
        out += [full(n, F.max("high"), trailing(n), "high").alias(f"HIGH_{n}"), full(n, F.min("low"), trailing(n), "low").alias(f"LOW_{n}")]
    return frame.select("*", *out)


def native_indicators(bars: DataFrame) -> DataFrame:
    return derived(atr(bollinger(moving_averages(bars))))


def ewm(values: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    """Recursive exponential average over possibly missing values.

    The weight of what is known decays on missing rows too, and the average repeats there; results start with the
    ``least``-th value.
    """
    return pd.Series(values).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def wilder_rsi(frame: DataFrame, n: int = 14) -> DataFrame:
    """``frame`` with WILDER_RSI: gains and losses start with their simple means over n changes and are smoothed by 1/n."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", ignore_index=True)
        change = np.diff(rows["close"].to_numpy(float))
        out = np.full(len(rows), np.nan)
        if len(change) >= n:
            sides = []
            for side in (np.maximum(change, 0), np.maximum(-change, 0)):
                seeded = np.concatenate([[side[:n].mean()], side[n:]])
                sides.append(ewm(seeded, 1 / n))
            up, down = sides
            with np.errstate(divide="ignore", invalid="ignore"):
                out[n:] = np.where(down > 0, 100 - 100 / (1 + up / down), 100.0)
        return rows.assign(WILDER_RSI=pd.array(np.where(np.isnan(out), None, out), "Float64"))

    kept = frame.select("symbol", "date", "close")
    told = kept.groupBy("symbol").applyInPandas(run, "symbol long, date date, close double, WILDER_RSI double").drop("close")
    return frame.join(told, ["symbol", "date"])


EWM_COLUMNS = (*[f"RSI{p}" for p in RSI_PERIODS], "DIF", "DEA", "MACD", "KDJ_K", "KDJ_D", "KDJ_J")


def exponential_columns(close: np.ndarray, high9: np.ndarray, low9: np.ndarray) -> dict[str, np.ndarray]:
    """RSI, MACD and KDJ of one symbol; ``high9`` and ``low9`` are the nine-bar extremes."""
    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        change = np.diff(close, prepend=np.nan)
        gain, loss = np.where(change > 0, change, 0.0), np.where(change < 0, -change, 0.0)
        for p in RSI_PERIODS:
            up, down = ewm(gain, 1 / p, p), ewm(loss, 1 / p, p)
            out[f"RSI{p}"] = np.where(down > 0, 100 - 100 / (1 + up / down), np.nan)
        out["DIF"] = ewm(close, 2 / 13) - ewm(close, 2 / 27)
        out["DEA"] = ewm(out["DIF"], 2 / 10)
        out["MACD"] = 2 * (out["DIF"] - out["DEA"])
        raw = np.where(high9 > low9, (close - low9) / (high9 - low9) * 100, np.nan)
        out["KDJ_K"] = ewm(raw, 1 / 3, 3)
        out["KDJ_D"] = ewm(out["KDJ_K"], 1 / 3, 3)
        out["KDJ_J"] = 3 * out["KDJ_K"] - 2 * out["KDJ_D"]
    return out


def exponential_indicators(frame: DataFrame) -> DataFrame:
    """``frame`` with the columns of ``EWM_COLUMNS``."""
    extremes = frame.select("*", full(9, F.max("high"), trailing(9), "high").alias("_h9"), full(9, F.min("low"), trailing(9), "low").alias("_l9"))
    schema = StructType(list(frame.schema.fields))
    for name in EWM_COLUMNS:
        schema = schema.add(name, DoubleType())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        found = exponential_columns(*(table.column(c).to_numpy().astype(float) for c in ("close", "_h9", "_l9")))
        table = table.drop_columns(["_h9", "_l9"])
        for name, values in found.items():
            table = table.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return table

    return extremes.groupBy("symbol").applyInArrow(run, schema)


def all_indicators(bars: DataFrame) -> DataFrame:
    """The grouped map comes first, while rows are narrow; what it does not need never passes through Python."""
    return native_indicators(exponential_indicators(bars))


def simple_factors(frame: DataFrame) -> DataFrame:
    """Factors that need no exponential average; ``frame`` has native indicators, change_rate and turnover."""
    frame = frame.withColumn("_rose", F.coalesce(F.col("close") > F.lag("close").over(by_symbol()), F.lit(False)).cast("double"))
    up, rose = F.col("close") > F.col("open"), F.col("_rose")
    yang, yin = F.sum(up.cast("int")).over(trailing(20)), F.sum((F.col("close") < F.col("open")).cast("int")).over(trailing(20))
    whole = F.count("close").over(trailing(20)) == 20
    out = [
        F.when(whole, ratio(yang.cast("double"), yin.cast("double"))).alias("updown_ratio_20"),
        F.when(whole, F.avg(rose).over(trailing(20))).alias("up_days_ratio_20"),
        full(20, F.avg("turnover"), trailing(20), "turnover").alias("turnover_ma20"),
        ratio(F.col("volume"), F.col("VOL_MA5")).alias("vol_ratio"),
        F.coalesce((F.col("MA5") > F.col("MA10")) & (F.col("MA10") > F.col("MA20")), F.lit(False)).cast("int").alias("ma_bull"),
        ratio(F.col("close") - F.col("BOLL_LOWER"), F.col("BOLL_UPPER") - F.col("BOLL_LOWER")).alias("boll_pos"),
        ratio(F.col("BOLL_UPPER") - F.col("BOLL_LOWER"), F.col("BOLL_MID")).alias("boll_width"),
        up.alias("is_yang"),
        F.coalesce(F.col("close") > F.col("MA5"), F.lit(False)).alias("above_ma5"),
        F.coalesce(F.col("close") > full(5, F.max("high"), prior(5), "high"), F.lit(False)).alias("break_high5"),
        F.coalesce(F.col("close") > full(10, F.max("high"), prior(10), "high"), F.lit(False)).alias("break_high10"),
        F.coalesce(F.col("close") > full(40, F.max("close"), prior(40), "close"), F.lit(False)).alias("break_close40"),
    ]
    return frame.select("*", *out).drop("_rose")


def crosses(frame: DataFrame) -> DataFrame:
    """Golden crosses of MACD and KDJ, each also within the last three bars, and the sign of DIF."""
    w = by_symbol()
    macd = (F.col("DIF") > F.col("DEA")) & (F.lag("DIF").over(w) <= F.lag("DEA").over(w))
    kdj = (F.col("KDJ_K") > F.col("KDJ_D")) & (F.lag("KDJ_K").over(w) <= F.lag("KDJ_D").over(w))
    out = frame.select("*", F.coalesce(macd, F.lit(False)).cast("int").alias("macd_gold"), F.coalesce(kdj, F.lit(False)).cast("int").alias("kdj_gold"))
    return out.select(
        "*",
        F.max("macd_gold").over(trailing(3)).alias("macd_gold3"),
        F.max("kdj_gold").over(trailing(3)).alias("kdj_gold3"),
        F.coalesce(F.col("DIF") < 0, F.lit(False)).cast("int").alias("dif_below0"),
        F.coalesce(F.col("DIF") > 0, F.lit(False)).cast("int").alias("dif_above_zero"),
    )


def factors(bars_with_change: DataFrame) -> DataFrame:
    """All indicators and factors."""
    return crosses(simple_factors(all_indicators(bars_with_change)))
