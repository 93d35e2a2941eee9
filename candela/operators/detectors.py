"""Chart patterns found without looking ahead.

Three steps.  Bars get what each detector needs from a fixed number of rows as window columns.  One grouped map folds a
symbol's pivots into a zigzag and hands every bar that passes a cheap gate the zigzag as it stood there.  All rules are
then columns over these rows.  Only what a detector remembers - structures it has used, and how long it rests after a
signal - is a second fold, over the few bars on which a rule holds.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import by_symbol, full, lit, prior, ratio, score_range, sliding_extremes, trailing
from candela.operators.pivots import Pivot, extend

#: The tables and limits below, and those in the detectors, are fixed values.
MIN_BARS = 260
#: Bars that a trend looks back on, its least span, and the span that needs no further sign.
LOOKBACK, SPAN, WIDE = 250, 0.20, 0.30
#: Bars a pattern rests after a signal.
COOLDOWN = {"trend_pullback": 10, "ma_rebound": 20, "w_bottom": 15, "m_neckline": 15, "box_breakout": 15}
#: Limits of a field by pattern; both ends count and a missing value fails.
NORMAL = {
    "trend_pullback": {"change_rate": (None, 1.8), "potential_gain": (0, 0.028)}, "w_bottom": {"change_rate": (None, 1.75), "turnover_ma20": (0.02, 0.6)},
    "m_neckline": {"BIAS60": (None, 0.04), "up_days_ratio_20": (0.6, None)}, "box_breakout": {"vol_ratio": (1, 1.75), "change_rate": (None, 2.1)},
    "ma_rebound": {"up_days_ratio_20": (0.6, None), "BIAS60": (0.045, None)},
}
STRICT = {
    "trend_pullback": {"change_rate": (None, 1.81), "fib": ("fib_618",)}, "w_bottom": {"BIAS60": (None, -0.07), "vol_ratio": (0.4, 1.87)},
    "m_neckline": {"BIAS60": (None, 0.024), "change_rate": (None, 1.24)}, "box_breakout": {"BIAS60": (None, 0.074), "turnover": (0.05, 1.16)},
    "ma_rebound": {"variant": ("MA250_hold",), "potential_gain": (0.01, 0.151)},
}
CARRIED = ("change_rate", "turnover", "turnover_ma20", "updown_ratio_20", "up_days_ratio_20", "vol_ratio", "RSI14", "BIAS60", "KDJ_J", "boll_pos", "boll_width", "RSI6")
FLAGS = ("ma_bull", "dif_above_zero", "macd_gold3", "dif_below0", "kdj_gold3")
PATTERNS = ("trend_pullback", "ma_rebound", "w_bottom", "m_neckline", "box_breakout")
#: Pivots that a bar's zigzag carries: those of so many bars, and so many at least.
CARRIED_BARS, CARRIED_PIVOTS = 400, 24
#: Bars of which closes, lows and volumes are carried.
PATH = 59
LINE = pa.list_(pa.struct([("idx", pa.int32()), ("typ", pa.string()), ("price", pa.float64()), ("close", pa.float64()), ("dif", pa.float64()), ("upto", pa.float64()),
    ("volume", pa.float64())]))
SIGNAL = ("symbol", "date", "pattern", "variant", "close", "score", "trend", "hit_levels", "fib_level", "resonance", "wave_phase", "break_days", "break_depth", "potential_gain",
    "pullback_vol_shrink", "macd_div", "key_level_name", "key_level_value", "pullback_pct", "left_idx", "right_idx", "neckline_value", "deviation_pct", "right_bottom_price",
    "box_high")


class Turn(NamedTuple):
    """A pivot with the number of the row it comes from."""

    idx: int
    typ: str
    price: float
    confirm: int
    row: int


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def gated(factors: DataFrame) -> DataFrame:
    """Bars with an index, what the rules need of earlier bars, whether they are pivots, and whether any rule is worth trying.

    Symbols that are too short or have no such bar are left out.
    """
    w, whole = by_symbol(), Window.partitionBy("symbol")
    rows = factors.withColumn("idx", F.row_number().over(w) - 1).withColumn("placed", F.struct("close", -F.col("idx")))
    most, least = F.greatest, F.least
    rows = sliding_extremes(rows, {
        "year_high": ("close", most, 121), "wave_high": ("close", most, 251), "high_120": ("close", most, 120), "high_60": ("close", most, 60), "max_10": ("close", most, 10),
        "max_40": ("close", most, 40), "min_10": ("close", least, 10), "min_50": ("close", least, 50), "min_40": ("close", least, 40), "close_15": ("close", least, 15),
        "low_15": ("low", least, 15), "top_11": ("high", most, 11), "bottom_11": ("low", least, 11), "latest": ("placed", most, 30),
    })
    complete = (F.lead("idx", 5).over(w).isNotNull()) & (F.col("idx") >= 5)
    rebound = _flag(F.col("is_yang") & F.col("above_ma5") & F.col("break_high5"))
    strong = _flag(F.col("is_yang") & (F.col("vol_ratio") >= 1.5))
    locked = (F.col("high") == F.col("low")) & _flag(F.col("change_rate") >= 9.5)
    eligible = (F.col("volume") > 0) & (F.col("close") >= 1.5) & F.col("MA5").isNotNull() & F.col("VOL_MA5").isNotNull() & ~locked & (F.col("idx") >= MIN_BARS)
    rows = rows.select(
        "*", rebound.alias("rebound"), strong.alias("strong"), _flag(F.col("is_yang") & F.col("break_close40") & (F.col("vol_ratio") >= 1.5)).alias("box"),
        (complete & (F.col("high") == F.lead("top_11", 5).over(w))).alias("is_top"), (complete & (F.col("low") == F.lead("bottom_11", 5).over(w))).alias("is_bottom"),
        F.lag("close", 120).over(w).alias("year_ago"), F.lag("min_50", 10).over(w).alias("earlier_min"), F.lag("MA60", 10).over(w).alias("ma60_before"),
        F.lag("close").over(w).alias("close_before"), F.lag("max_40").over(w).alias("box_top"), F.lag("min_40").over(w).alias("box_bottom"),
        F.lag("high_120").over(w).alias("top_before"), (-F.col("latest.col2")).alias("peak"), F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    ).drop("placed", "latest")
    # only bars before a possible pullback are carried as its path
    pulls = F.expr("rebound and MA20 > MA60 and close > MA60 and year_ago > 0 and year_high >= 1.14D * year_ago and idx - peak >= 2")
    rows = sliding_extremes(rows.withColumn("pulls", _flag(pulls)), {"pulled": ("pulls", F.greatest, PATH)})
    near = F.coalesce(F.lead("pulled", PATH - 1).over(w), F.lit(True))
    rows = rows.withColumn("near", near).withColumn("path", F.collect_list(F.when(F.col("near"), F.struct("close", "low", "volume"))).over(trailing(PATH)))
    rows = rows.withColumn("path", F.when(F.col("pulls"), F.col("path"))).drop("pulled", "near", "pulls")
    rows = rows.withColumn("worth", eligible & (F.col("rebound") | F.col("strong")))
    counted = rows.withColumn("_any", F.max("worth").over(whole))
    return counted.where(F.col("_any") & (F.col("worth") | F.col("is_top") | F.col("is_bottom"))).drop("_any")


def with_zigzag(rows: DataFrame, swing: float = 0.03) -> DataFrame:
    """The bars of ``rows`` that are worth a try, with ``line``: the zigzag of the pivots that were confirmed by then."""
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.pandas.types import from_arrow_type

    schema = StructType([*rows.schema.fields, StructField("line", from_arrow_type(LINE))])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        facts = {c: table.column(c).to_numpy()[order] for c in ("idx", "is_top", "is_bottom", "worth", "high", "low", "close", "DIF", "upto", "volume")}
        turns = [Turn(int(facts["idx"][i]), typ, float(facts[edge][i]), int(facts["idx"][i]) + 5, i)
            for i in np.flatnonzero(facts["is_top"] | facts["is_bottom"]) for typ, flag, edge in (("H", "is_top", "high"), ("L", "is_bottom", "low")) if facts[flag][i]]
        line, at, kept, offsets = [], 0, [], [0]
        wanted = np.flatnonzero(facts["worth"])
        for row in wanted:
            now = int(facts["idx"][row])
            while at < len(turns) and turns[at].confirm <= now:
                extend(line, turns[at], swing)
                at += 1
            kept += line[max(0, min(bisect_left(line, now - CARRIED_BARS, key=lambda p: p.idx), len(line) - CARRIED_PIVOTS)) :]
            offsets.append(len(kept))
        of = np.array([p.row for p in kept], np.int64)
        fields = [pa.array([p.idx for p in kept], pa.int32()), pa.array([p.typ for p in kept], pa.string()), pa.array([p.price for p in kept], pa.float64()),
            *[pa.array(facts[c][of], pa.float64()) for c in ("close", "DIF", "upto", "volume")]]
        column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [f.name for f in LINE.value_type]))
        return table.take(pa.array(order[wanted])).append_column("line", column)

    return rows.groupBy("symbol").applyInArrow(run, schema)


def _recent(line: Column, since: Column, typ: str) -> Column:
    return F.filter(line, lambda p: (p["idx"] >= since) & (p["typ"] == typ))


def trend(line: Column, idx: Column, close: Column, average: Column) -> dict[str, Column]:
    """``top`` and ``bottom``, the highest and lowest pivots of the recent zigzag as (price, idx), and ``trend``: up, down or range."""
    highs, lows = (_recent(line, idx - LOOKBACK, t) for t in "HL")
    first_high = F.array_max(F.transform(highs, lambda p: F.struct(p["price"].alias("price"), (-p["idx"]).alias("idx"))))
    low = F.array_min(F.transform(lows, lambda p: F.struct(p["price"].alias("price"), p["idx"].alias("idx"))))
    top = F.when(first_high.isNotNull(), F.struct(first_high["price"].alias("price"), (-first_high["idx"]).alias("idx")))
    return {"top": top, "bottom": low, **{f"{n}_{k}": F.try_element_at(x, F.lit(-k))["price"] for n, x in (("high", highs), ("low", lows)) for k in (1, 2)},
        "n_highs": F.size(highs)}


def trend_of() -> Column:
    """The trend from the columns of ``trend``, close and MA120."""
    span = F.col("top.price") / F.col("bottom.price") - lit(1)
    rising = _flag((F.col("high_1") > F.col("high_2")) & (F.col("low_1") > F.col("low_2")))
    falling = _flag((F.col("high_1") < F.col("high_2")) & (F.col("low_1") < F.col("low_2")))
    wide = span >= lit(WIDE)
    up = (F.col("bottom.idx") < F.col("top.idx")) & ~_flag(F.col("close") <= F.col("MA120")) & (rising | wide)
    down = (F.col("top.idx") < F.col("bottom.idx")) & ~_flag(F.col("close") >= F.col("MA120")) & (falling | wide)
    return F.when(_flag((span >= lit(SPAN)) & up), "up").when(_flag((span >= lit(SPAN)) & down), "down").otherwise("range")


def fib_levels(top: Column, bottom: Column, peak: Column) -> Column:
    """(name, value) of the retracements of a rise below its top (the peak if higher), or of the rebounds of a fall above its bottom."""
    high = F.greatest(top["price"], peak)
    back = F.array(*[F.struct(F.lit(f"fib_{int(x * 1000)}").alias("name"), (high - lit(x) * (high - bottom["price"])).alias("value")) for x in (0.382, 0.5, 0.618, 0.786)])
    rebound = F.array(*[F.struct(F.lit(f"retr_{int(x * 1000)}").alias("name"), (bottom["price"] + lit(x) * (top["price"] - bottom["price"])).alias("value"))
        for x in (0.382, 0.5, 0.618)])
    sound = top.isNotNull() & bottom.isNotNull() & (top["price"] > 0) & (bottom["price"] > 0)
    return F.when(_flag(sound), F.when(bottom["idx"] < top["idx"], back).otherwise(rebound))


def phase() -> Column:
    return F.when(F.col("close") >= lit(0.995) * F.col("wave_high"), "breakout_new_high").when(F.col("n_highs") == 1, "first_pullback").when(F.col("n_highs") == 2,
        "second_pullback").otherwise("later_pullback")


def _mean(values: Column) -> Column:
    return ratio(F.aggregate(values, lit(0), lambda a, x: a + x), F.size(values).cast("double"))


def trend_pullbacks(rows: DataFrame, tolerance: float) -> tuple[DataFrame, Column, dict]:
    """A pullback within a rise that holds at an average, a retracement or an earlier high."""
    age = F.col("idx") - F.col("peak")
    rows = rows.withColumns({"p_age": age, "p_high": F.try_element_at("path", -(age + 1))["close"], "p_path": F.slice("path", -(age + 1), age + 1)["close"],
        "p_low": F.array_min(F.slice("path", -(age + 1), age + 1)["low"]), "p_first": _mean(F.slice("path", -(2 * age + 1), age)["volume"]),
        "p_second": _mean(F.slice("path", -(age + 1), age + 1)["volume"])})
    age, low, high = F.col("p_age"), F.col("p_low"), F.col("p_high")
    rows = rows.withColumn("p_worst", F.array_min("p_path")).withColumn("p_fall", ratio(high - F.col("p_worst"), high))
    averages = F.array(*[F.struct(F.lit(f"MA{w}").alias("name"), F.col(f"MA{w}").alias("value")) for w in (20, 60, 120, 250)])
    earlier = F.try_element_at(F.filter("line", lambda p: (p["typ"] == "H") & (p["idx"] < F.col("peak") - 5)), F.lit(-1))["price"]
    levels = F.concat(averages, fib_levels(F.col("top"), F.col("bottom"), high), F.array(F.struct(F.lit("prev_high").alias("name"), earlier.alias("value"))))
    rows = rows.withColumn("p_levels", F.filter(levels, lambda x: x["value"] > 0))

    def apart(v: Column) -> Column:
        return F.abs(low - v) / v

    held = F.filter("p_levels", lambda x: (high >= x["value"] * lit(0.99)) & (low <= x["value"] * lit(1.04)) & (apart(x["value"]) <= lit(0.04)))
    best = F.array_max(F.transform(held, lambda x, i: F.struct(x["value"].alias("value"), (-i).alias("back"), x["name"].alias("name"))))
    hits = F.transform(F.filter("p_levels", lambda x: (apart(x["value"]) <= lit(tolerance)) & (high >= x["value"] * lit(1 + tolerance))), lambda x: x["name"])
    rows = rows.withColumns({"p_key": best, "p_hits": hits})
    level = F.col("p_key.value")
    rows = rows.withColumns({"p_away": apart(level), "p_under": F.size(F.filter("p_path", lambda x: x < level * lit(0.999)))})
    away, under = F.col("p_away"), F.col("p_under")
    variant = F.when((under == 0) & (away <= lit(tolerance)), "strong_hold").when((under <= 3) & (F.col("close") >= level), "fake_break").when(away > lit(tolerance),
        "near_level").otherwise("soft_pullback")
    touch = F.when(away <= lit(tolerance), lit(1)).otherwise(F.greatest(lit(0), (lit(0.04) - away) / lit(0.04 - tolerance)))
    score = lit(0.30) * score_range(F.col("p_fall"), 0.04, 0.13, 0.02, 0.20) + lit(0.20) * score_range(age.cast("double"), 4, 20, 2, 35) + lit(0.35) * touch \
        + lit(0.15) * score_range(ratio(F.col("top.price"), F.col("bottom.price")) - lit(1), 0.30, 2.0, 0.15, 5.0)
    fibs = F.filter("p_hits", lambda h: h.startswith("fib_"))
    ok = F.expr("rebound and MA20 > MA60 and close > MA60 and trend = 'up' and year_ago > 0 and p_age between 2 and 35 and p_fall between 0.02D and 0.2D and p_key is not null") \
        & (ratio(F.col("year_high"), F.col("year_ago")) >= lit(1.15))
    return rows, ok, {
        "variant": variant, "score": score, "trend": F.col("trend"), "hit_levels": F.when(F.size("p_hits") > 0, F.array_join("p_hits", ",")).otherwise(F.col("p_key.name")),
        "fib_level": F.coalesce(F.get(fibs, F.lit(0)), F.lit("")), "resonance": F.greatest(F.lit(1), F.size("p_hits")), "wave_phase": phase(), "break_days": under,
        "break_depth": F.greatest(lit(0), ratio(level - F.col("p_worst"), level)), "pullback_vol_shrink": F.when(F.col("p_first") > 0, ratio(F.col("p_second"), F.col("p_first"))),
        "potential_gain": ratio(F.col("year_high"), F.col("close")) - lit(1), "key_level_name": F.col("p_key.name"), "key_level_value": level, "pullback_pct": F.col("p_fall"),
        "left_idx": F.col("bottom.idx"), "right_idx": F.col("peak"),
    }


def ma_rebounds(rows: DataFrame) -> tuple[DataFrame, Column, dict]:
    """A fall that stops at a long average: touched, held, without new lows and calm or on volume."""

    def at(w: int) -> Column:
        average = F.col(f"MA{w}")
        return F.struct(F.lit(f"MA{w}").alias("name"), average.alias("value"), (ratio(F.col("low_15"), average) - lit(1)).alias("touch"),
            (ratio(F.col("close_15"), average) - lit(1)).alias("hold"))

    found = F.get(F.filter(F.array(*map(at, (60, 120, 250))), lambda x: (x["value"] > 0) & (x["touch"] <= lit(0.05)) & (x["hold"] >= lit(-0.07))), F.lit(0))
    rows = rows.withColumns({"r_fall": ratio(F.col("high_60") - F.col("close"), F.col("high_60")), "r_spread": ratio(F.col("max_10") - F.col("min_10"), F.col("min_10")), "r_key": found})
    score = lit(0.25) * score_range(F.col("r_fall"), 0.20, 0.70, 0.10, 1.00) + lit(0.30) * score_range(F.col("r_key.touch"), -0.05, 0.0, -0.08, 0.05) \
        + lit(0.30) * score_range(F.col("r_key.hold"), 0.0, 0.20, -0.07, 0.30) + lit(0.15) * score_range(F.col("r_spread"), 0.03, 0.10, 0.0, 0.18)
    ok = F.expr("rebound and high_60 > 0 and (close < MA60 or MA60 < ma60_before) and min_10 > earlier_min * 0.999D and r_fall >= 0.1D "
        "and (r_spread <= 0.18D or vol_ratio >= 1.5D) and r_key is not null")
    return rows, ok, {
        "variant": F.concat(F.col("r_key.name"), F.lit("_hold")), "score": score, "trend": F.lit("down"), "hit_levels": F.col("r_key.name"), "resonance": F.lit(1),
        "wave_phase": F.lit("downtrend_ma_support"), "potential_gain": ratio(F.col("high_120"), F.col("close")) - lit(1), "key_level_name": F.col("r_key.name"),
        "key_level_value": F.col("r_key.value"), "pullback_pct": F.col("r_fall"),
    }


def last_three(rows: DataFrame) -> DataFrame:
    """``rows`` with the last three pivots as one, neck and two, their ``kinds``, and the extremes of the 250 bars before them."""
    rows = rows.withColumns({n: F.try_element_at("line", F.lit(-k)) for n, k in (("one", 3), ("neck", 2), ("two", 1))})

    def before(typ: str, best) -> Column:
        earlier = F.filter("line", lambda p: (p["typ"] == typ) & (p["idx"] >= F.col("one.idx") - LOOKBACK) & (p["idx"] < F.col("one.idx")))
        return best(F.transform(earlier, lambda p: p["price"]))

    apart = ratio(F.abs(F.col("two.price") - F.col("one.price")), F.col("one.price"))
    near = (F.col("two.idx") - F.col("one.idx")).between(8, 90)
    return rows.withColumns({"kinds": F.when(near, F.concat("one.typ", "neck.typ", "two.typ")), "high_earlier": before("H", F.array_max),
        "low_earlier": before("L", F.array_min), "apart": apart, "alike": score_range(apart, 0.0, 0.03, 0.0, 0.08)})


def w_bottoms(rows: DataFrame) -> tuple[DataFrame, Column, dict]:
    """Two like lows after a fall: the break of the high between them (``first_key``), or the rebound from the second (``second_key``)."""
    one, neck, two, close = F.col("one.price"), F.col("neck.price"), F.col("two.price"), F.col("close")
    base = F.least(one, two)
    rows = rows.withColumns({"w_height": ratio(neck, base) - lit(1), "w_drop": ratio(F.col("high_earlier") - one, F.col("high_earlier"))})
    score = lit(0.35) * F.col("alike") + lit(0.30) * score_range(F.col("w_height"), 0.10, 0.80, 0.05, 1.50) \
        + lit(0.15) * score_range((F.col("two.idx") - F.col("one.idx")).cast("double"), 15, 50, 8, 90) + lit(0.20) * score_range(F.col("w_drop"), 0.30, 0.80, 0.20, 1.50)
    broke = (F.col("idx") - F.col("neck.idx") <= 60) & (close > neck) & (F.col("close_before") <= neck) & F.col("strong")
    rose = (F.col("idx") - F.col("two.idx")).between(1, 25) & F.col("rebound") & (close >= lit(1.02) * F.col("two.close")) & (close <= lit(0.97) * neck)
    diverges = (two <= lit(1.02) * one) & (F.col("two.dif") > F.col("one.dif"))
    ok = (F.col("kinds") == "LHL") & (one > 0) & (two >= lit(0.92) * one) & (F.col("w_height") >= lit(0.05)) & (F.col("w_drop") >= lit(0.20)) & (F.col("alike") > 0) & (broke | rose)
    return rows, ok, {
        "score": score, "trend": F.lit("down"), "resonance": F.lit(1), "macd_div": _flag(diverges).cast("int"), "left_idx": F.col("one.idx"), "right_idx": F.col("two.idx"),
        "neckline_value": neck, "deviation_pct": F.abs(ratio(two, one) - lit(1)) * lit(100), "right_bottom_price": two, "first_key": F.when(broke, F.col("neck.idx")),
        "second_key": F.when(rose, F.col("two.idx")), "first_gain": ratio(lit(2) * neck - base, close) - lit(1), "potential_gain": ratio(neck, close) - lit(1),
    }


def m_necklines(rows: DataFrame) -> tuple[DataFrame, Column, dict]:
    """Two like highs after a rise whose low between them holds."""
    one, neck, two = F.col("one.price"), F.col("neck.price"), F.col("two.price")
    first = ratio(F.col("two.upto") - F.col("neck.upto") + F.col("neck.volume"), (F.col("two.idx") - F.col("neck.idx") + 1).cast("double"))
    second = ratio(F.col("upto") - F.col("two.upto") + F.col("two.volume"), (F.col("idx") - F.col("two.idx") + 1).cast("double"))
    rows = rows.withColumns({"m_hold": ratio(F.col("close_15"), neck) - lit(1), "m_rise": ratio(one, F.col("low_earlier")) - lit(1), "m_first": first, "m_second": second})
    score = lit(0.35) * F.col("alike") + lit(0.20) * score_range(F.col("m_rise"), 0.40, 2.00, 0.25, 4.00) \
        + lit(0.15) * score_range((F.col("two.idx") - F.col("one.idx")).cast("double"), 15, 50, 8, 90) + lit(0.30) * score_range(F.col("m_hold"), 0.0, 0.15, -0.02, 0.30)
    diverges = (two >= lit(0.98) * one) & (F.col("two.dif") < F.col("one.dif"))
    ok = F.col("rebound") & (F.col("kinds") == "HLH") & (F.col("apart") <= lit(0.08)) & (neck < F.least(one, two)) & (F.col("low_earlier") > 0) & (F.col("m_rise") >= lit(0.25)) \
        & (F.col("idx") - F.col("two.idx") <= 25) & (F.col("low_15") <= lit(1.08) * neck) & (F.col("m_hold") >= lit(-0.02)) & (F.col("close") > neck)
    return rows, ok, {
        "variant": F.lit("neckline_hold"), "score": F.when(F.col("alike") > 0, score).otherwise(lit(0)), "trend": F.lit("up"), "hit_levels": F.lit("neckline"),
        "resonance": F.lit(1), "wave_phase": phase(), "macd_div": -_flag(diverges).cast("int"),
        "pullback_vol_shrink": F.when(F.col("m_first") > 0, ratio(F.col("m_second"), F.col("m_first"))), "potential_gain": ratio(F.greatest(one, two), F.col("close")) - lit(1),
        "left_idx": F.col("one.idx"), "right_idx": F.col("two.idx"), "neckline_value": neck, "deviation_pct": F.col("apart") * lit(100), "first_key": F.col("two.idx"),
    }


def box_breakouts(rows: DataFrame) -> tuple[DataFrame, Column, dict]:
    """A close on volume out of a narrow box and above most of the last half year."""
    rows = rows.withColumns({"b_width": ratio(F.col("box_top") - F.col("box_bottom"), F.col("box_bottom")), "b_out": ratio(F.col("close"), F.col("box_top")) - lit(1)})
    narrow = score_range(F.col("b_width"), 0.05, 0.12, 0.02, 0.25)
    score = lit(0.40) * narrow + lit(0.35) * score_range(F.col("vol_ratio"), 2.0, 8.0, 1.5, 20.0) + lit(0.25) * score_range(F.col("b_out"), 0.005, 0.05, 0.003, 0.099)
    ok = F.expr("box and close > 0.999D * top_before and b_width <= 0.25D and b_out >= 0.003D") & (narrow > 0)
    return rows, ok, {
        "variant": F.lit("box_breakout"), "score": score, "trend": F.lit("range"), "hit_levels": F.lit("box_high"), "resonance": F.lit(1), "wave_phase": F.lit("box_breakout"),
        "potential_gain": ratio(lit(2) * F.col("box_top") - F.col("box_bottom"), F.col("close")) - lit(1), "left_idx": F.col("idx") - 40, "right_idx": F.col("idx") - 1,
        "box_high": F.col("box_top"),
    }


#: Type of each column that only some rules fill.
_OWN = {"variant": "string", "trend": "string", "hit_levels": "string", "fib_level": "string", "resonance": "int", "wave_phase": "string", "break_days": "int", "break_depth": "double",
    "potential_gain": "double", "pullback_vol_shrink": "double", "macd_div": "int", "key_level_name": "string", "key_level_value": "double", "pullback_pct": "double",
    "left_idx": "int", "right_idx": "int", "neckline_value": "double", "deviation_pct": "double", "right_bottom_price": "double", "box_high": "double", "first_key": "int",
    "second_key": "int", "first_gain": "double"}
_DEFAULTS = {"fib_level": "", "break_days": 0, "break_depth": 0.0, "macd_div": 0}
_RULES = {"ma_rebound": ma_rebounds, "w_bottom": w_bottoms, "m_neckline": m_necklines, "box_breakout": box_breakouts}


def _hits(rows: DataFrame, patterns: tuple[str, ...], tolerance: float) -> DataFrame:
    """A row for each bar and rule that holds there, all rules in the same columns."""
    rows, found = last_three(rows), []
    for pattern in patterns:
        rows, ok, told = trend_pullbacks(rows, tolerance) if pattern == "trend_pullback" else _RULES[pattern](rows)
        own = [told.get(c, F.lit(_DEFAULTS.get(c))).cast(kind).alias(c) for c, kind in _OWN.items()]
        found.append(F.when(_flag(ok), F.struct(F.lit(pattern).alias("pattern"), F.round(told["score"], 3).alias("score"), *own)))
    hits = rows.select("symbol", "date", "idx", "close", *CARRIED, *FLAGS, F.explode(F.array_compact(F.array(*found))).alias("hit"))
    return hits.select("symbol", "date", "idx", "close", "hit.*", *CARRIED, *FLAGS)


def _settle(min_score: float):
    """Which of a symbol's hits become signals: those whose structure is not used and whose pattern does not rest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["idx", "pattern"], ignore_index=True)
        rests, used, pick, kept = {}, set(), [], []
        for row in rows[["idx", "pattern", "score", "first_key", "second_key"]].itertuples():
            if row.idx - rests.get(row.pattern, -MIN_BARS) < COOLDOWN[row.pattern]:
                continue
            mine = 0
            if row.pattern in ("w_bottom", "m_neckline"):
                keys = [(row.pattern, k, v) for k, v in (("first", row.first_key), ("second", row.second_key)) if v == v and v is not None]
                key = next((k for k in keys if k not in used), None)
                if key is None:
                    continue
                used.add(key)
                mine = 1 if key[1] == "first" else 2
            if row.score >= min_score:
                rests[row.pattern] = row.idx
                kept.append(row.Index)
                pick.append(mine)
        return pd.DataFrame({"symbol": rows["symbol"].iloc[kept], "idx": rows["idx"].iloc[kept], "pattern": rows["pattern"].iloc[kept], "pick": pick})

    return run


def detect(factors: DataFrame, patterns: tuple[str, ...] = PATTERNS, min_score: float = 0.6, tolerance: float = 0.015) -> DataFrame:
    """Signals of all symbols; ``factors`` has all indicators and factors."""
    needed = dict.fromkeys(["symbol", "date", "open", "high", "low", "close", "volume", "MA5", "MA20", "MA60", "MA120", "MA250", "VOL_MA5", "DIF", "is_yang", "above_ma5",
        "break_high5", "break_close40", *CARRIED, *FLAGS])
    rows = with_zigzag(gated(factors.select(*needed)))
    told = trend(F.col("line"), F.col("idx"), F.col("close"), F.col("MA120"))
    rows = rows.select("*", *[c.alias(k) for k, c in told.items()]).withColumn("trend", trend_of())
    hits = _hits(rows, tuple(patterns), tolerance)
    narrow = hits.groupBy("symbol").applyInArrow(_arrow(_settle(min_score), hits.schema), _settled_schema(hits.schema))
    first = F.col("pick") == 1
    is_w = F.col("pattern") == "w_bottom"
    out = narrow.withColumns({
        "variant": F.when(is_w, F.when(first, "neckline_breakout").otherwise("right_bottom")).otherwise(F.col("variant")),
        "hit_levels": F.when(is_w, F.when(first, "neckline").otherwise("second_bottom")).otherwise(F.col("hit_levels")),
        "wave_phase": F.when(is_w, F.when(first, "base_breakout").otherwise("base_rebound")).otherwise(F.col("wave_phase")),
        "potential_gain": F.when(is_w & first, F.col("first_gain")).otherwise(F.col("potential_gain")), "close": F.round("close", 3),
    })
    return out.select(*SIGNAL, *CARRIED, *FLAGS)


def _settled_schema(schema):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([*schema.fields, StructField("pick", IntegerType())])


def _arrow(settle, schema):
    """The fold over hits as a map of tables: only the columns that decide become pandas."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("idx", "ascending"), ("pattern", "ascending")])
        found = settle(table.select(["symbol", "idx", "pattern", "score", "first_key", "second_key"]).to_pandas())
        out = table.take(pa.array(found.index.to_numpy(np.int64)))
        return out.append_column("pick", pa.array(found["pick"].to_numpy(np.int32)))

    return run


def local_extremes(high: np.ndarray, low: np.ndarray, left: int = 5, right: int = 5) -> list[Pivot]:
    """Pivots in the order of confirmation, highs before lows of one bar."""
    width = left + right + 1
    if len(high) < width:
        return []
    tops, bottoms = np.lib.stride_tricks.sliding_window_view(high, width).max(1), np.lib.stride_tricks.sliding_window_view(low, width).min(1)
    found = [Pivot(int(i) + left, "H", float(high[i + left]), int(i) + width - 1) for i in np.flatnonzero(high[left : len(high) - right] == tops)]
    found += [Pivot(int(i) + left, "L", float(low[i + left]), int(i) + width - 1) for i in np.flatnonzero(low[left : len(low) - right] == bottoms)]
    return sorted(found, key=lambda p: (p.confirm, p.typ))


def box_breakout_raw(factors: DataFrame) -> DataFrame:
    """Every bar that meets the box breakout's gates, with its score; no cooldown."""
    w = prior(40)
    seen = factors.select("*", full(40, F.max("close"), w, "close").alias("box_high"), full(40, F.min("close"), w, "close").alias("box_low"),
        F.max("close").over(prior(120)).alias("high120"))
    seen = seen.where(F.expr("is_yang and break_close40 and vol_ratio >= 1.5D") & F.col("box_low").isNotNull())
    seen = seen.withColumn("width", (F.col("box_high") - F.col("box_low")) / F.col("box_low")).withColumn("breakout", F.col("close") / F.col("box_high") - lit(1))
    narrow = score_range(F.col("width"), 0.05, 0.12, 0.02, 0.25)
    score = lit(0.40) * narrow + lit(0.35) * score_range(F.col("vol_ratio"), 2.0, 8.0, 1.5, 20.0) + lit(0.25) * score_range(F.col("breakout"), 0.005, 0.05, 0.003, 0.099)
    gates = (F.col("close") > F.col("high120") * lit(0.999)) & (F.col("width") <= lit(0.25)) & (F.col("breakout") >= lit(0.003)) & (narrow > 0)
    return seen.where(gates).withColumn("score", score)


def passes(limits: dict[str, dict], compat: bool = True) -> Column:
    """Whether a signal is within its pattern's limits.  ``compat`` keeps the retracement condition on a field that signals lack, so that it never holds."""
    out = F.lit(False)
    for pattern, fields in limits.items():
        ok = F.lit(True)
        for field, limit in fields.items():
            if isinstance(limit[0], str):
                ok &= F.lit(False) if field == "fib" and compat else F.col("fib_level" if field == "fib" else field).isin(*limit)
            else:
                ok &= (F.lit(True) if limit[0] is None else F.col(field) >= limit[0]) & (F.lit(True) if limit[1] is None else F.col(field) <= limit[1]) & F.col(field).isNotNull()
        out = F.when(F.col("pattern") == pattern, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def with_filters(signals: DataFrame, compat: bool = True) -> DataFrame:
    return signals.select("*", passes(NORMAL, compat).alias("filter_pass"), passes(STRICT, compat).alias("strict_pass"))
