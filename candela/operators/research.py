"""Scores, labels and reports over signals, indicators and sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, ratio, round_product, trailing

#: Names of patterns in answers; they are taken as arguments too.
ALIASES = {"m_neckline": "neckline_reclaim", "ma_rebound": "major_ma_rebound"}
#: Asks for candidates with a known retracement, whatever their pattern.
FIB = "fibonacci_confluence"


def stage(variant: str = "variant", pattern: str = "pattern") -> Column:
    """Where in its life a signal is; any hold, and each hold of a neckline, counts as a retest."""
    v = F.coalesce(F.col(variant), F.lit(""))
    return F.when(v.contains("retest") | v.contains("hold") | (F.col(pattern) == "m_neckline"), "retesting").when(v.contains("breakout"), "confirmed").when(v == "right_bottom",
        "candidate").otherwise("triggered")


def enrich(signals: DataFrame, higher: DataFrame, sector_scores: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """A hundred-point score of each signal: pattern, daily and higher trend, volume, sector, confluence, less penalties.

    ``higher(symbol, higher_score)``, ``sector_scores(symbol, sector_score)`` and ``levels(symbol, level_trend, near_support,
    near_resistance)`` may lack symbols; without ``levels`` none is near any symbol.  The trend is the signal's own, else that of the levels.  ``invalid_level`` is
    where the signal would be wrong: a little under a bottom or neckline, the top of a box, else its support.
    """
    joined = signals.join(higher.select("symbol", "higher_score"), "symbol", "left").join(sector_scores.select("symbol", "sector_score"), "symbol", "left")
    if levels is None:
        joined = joined.withColumns({"level_trend": F.lit(None).cast("string"), "near_support": F.lit(None).cast("double"), "near_resistance": F.lit(None).cast("double")})
    else:
        joined = joined.join(levels.select("symbol", "level_trend", "near_support", "near_resistance"), "symbol", "left")
    way = F.coalesce(F.nullif(F.col("trend"), F.lit("")), "level_trend", F.lit("range"))
    told = joined.withColumns({"stage": stage(), "trend_state": way, "raw_score": F.coalesce("score", lit(0))})
    told = told.withColumn("confirmed", F.col("stage").isin("retesting", "confirmed"))
    weak = F.coalesce(F.col("confirmed") & (F.col("vol_ratio") < 1), F.lit(False))
    down = F.col("trend_state") == "down"
    parts = {
        "pattern_part": F.least(lit(30), lit(30) * F.col("raw_score")), "daily_part": F.when(F.col("trend_state") == "up", lit(20)).when(F.col("trend_state") == "range",
            lit(10)).otherwise(lit(3)), "higher_part": F.coalesce("higher_score", lit(7.5)), "volume_part": F.least(lit(15), F.greatest(lit(0), F.coalesce("vol_ratio", lit(0)) * lit(7.5))),
        "sector_part": F.least(lit(10), F.coalesce("sector_score", lit(0))),
        "confluence_part": F.least(lit(10), F.coalesce("resonance", F.lit(0)) * lit(3.5) + F.when(F.col("fib_level") != "", lit(2)).otherwise(lit(0))),
        "penalty": F.when(down, lit(15)).otherwise(lit(0)) + F.when(weak, lit(10)).otherwise(lit(0)),
    }
    told = told.withColumns(parts)
    total = sum((F.col(c) for c in list(parts)[:-1]), lit(0)) - F.col("penalty")
    support = F.coalesce(F.nullif(F.col("key_level_value"), lit(0)), "near_support")
    invalid = F.coalesce(F.when(F.col("pattern") == "w_bottom", round_product(F.nullif(F.col("right_bottom_price"), lit(0)) * lit(0.98), 3)).when(F.col("pattern") == "m_neckline",
        round_product(F.nullif(F.col("neckline_value"), lit(0)) * lit(0.98), 3)).when(F.col("pattern") == "box_breakout", F.nullif(F.col("box_high"), lit(0))), support)
    alias = F.coalesce(F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])[F.col("pattern")], F.col("pattern"))
    said = F.array(F.format_string("pattern score %.2f", "raw_score"), F.concat(F.lit("daily trend "), "trend_state"),
        F.format_string("levels that meet %d", F.coalesce("resonance", F.lit(0))), F.when(F.col("vol_ratio").isNotNull(), F.format_string("volume ratio %.2f", "vol_ratio")),
        F.when(F.col("hit_levels") != "", F.concat(F.lit("touches "), "hit_levels")))
    warned = F.array(F.when(down, "the daily trend is weak"), F.when(weak, "too little volume to confirm"))
    return told.select("*", round_product(F.greatest(lit(0), F.least(lit(100), total)), 2).alias("total_score"), alias.alias("alias"),
        F.when(F.col("confirmed"), "actionable").otherwise("wait_confirmation").alias("entry_status"), support.alias("support"), F.col("near_resistance").alias("resistance"),
        invalid.alias("invalid_level"), F.array_compact(said).alias("evidence"), F.array_compact(warned).alias("warnings"))


def best_signal(signals: DataFrame) -> DataFrame:
    """Each symbol's latest signal, the highest score first on one day."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("score"), "pattern")
    return signals.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rising_candidates(signals: DataFrame, as_of: DataFrame, higher: DataFrame, sector_scores: DataFrame, levels: DataFrame, lookback: int = 20, n: int = 20,
    patterns: list[str] | None = None, strict: bool = True, fib: DataFrame | None = None) -> DataFrame:
    """The best of the symbols' latest signals of the last weeks, by their enriched score.

    ``as_of`` has one row with the day ``as_of``; ``signals`` those of all patterns with ``strict_pass``.  ``patterns`` may name
    patterns by their own names or those of answers; ``fibonacci_confluence`` alone asks for symbols of ``fib(symbol)``.
    """
    asked = [{v: k for k, v in ALIASES.items()}.get(p, p) for p in patterns or [] if p != FIB]
    recent = signals.crossJoin(F.broadcast(as_of)).where(F.col("date") >= F.date_sub("as_of", max(2 * lookback, 30))).drop("as_of")  # one row
    recent = recent.where(F.col("pattern").isin(asked)) if asked else recent
    recent = recent.where("strict_pass") if strict else recent
    if patterns == [FIB] and fib is not None:
        recent = recent.join(fib.select("symbol").distinct(), "symbol", "left_semi")
    return enrich(best_signal(recent), higher, sector_scores, levels).orderBy(F.desc("total_score"), F.desc("date"), "symbol").limit(max(1, min(100, n)))


def sector_scores(members: DataFrame, sector_change: DataFrame) -> DataFrame:
    """Two points for each rising sector of a symbol, ten at most."""
    return members.join(sector_change.where("change > 0").select("sector_code"),
        "sector_code").groupBy("symbol").agg(F.least(lit(10), F.count(F.lit(1)) * lit(2)).alias("sector_score"))


def alignment(frame: DataFrame) -> DataFrame:
    """Score and label of how a symbol's trend goes with its sector's; columns stock_trend, sector_trend, sector_type, net_pct, breadth."""
    a, b = F.col("stock_trend"), F.col("sector_trend")
    same, opposite = (a == b) & a.isin("up", "down"), ((a == "up") & (b == "down")) | ((a == "down") & (b == "up"))
    score = F.when(same, lit(0.45)).when((a == "range") | (b == "range"), lit(0.15)).otherwise(lit(-0.25)) + F.when(F.col("sector_type") == "industry",
        lit(0.15)).otherwise(lit(0))
    score += F.when(F.col("net_pct").isNull(), lit(0)).otherwise(F.greatest(lit(-0.15), F.least(lit(0.15), F.col("net_pct") / lit(10))))
    score += F.when(F.col("breadth").isNull(), lit(0)).otherwise(F.greatest(lit(-0.2), F.least(lit(0.2), (F.col("breadth") - lit(50)) / lit(100))))
    out = frame.withColumn("alignment", F.round(F.greatest(lit(-1), F.least(lit(1), score)), 4))
    return out.withColumn("label", F.when(same & (F.col("alignment") >= lit(0.35)), "aligned").when(opposite | (F.col("alignment") < 0),
        "conflicting").otherwise("mixed"))


def trend_by_average(frame: DataFrame, key: str) -> DataFrame:
    """(key, date, close, bars, trend): each key's last bar and its trend by MA20 and the average's move over four bars; unknown below twenty bars."""
    w = by_symbol(key)
    numbered = frame.select(key, "date", "close", F.avg("close").over(trailing(20, key)).alias("ma20"), F.row_number().over(w).alias("bars"))
    moved = numbered.withColumn("before", F.lag("ma20", 4).over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.desc("date")))).where("_back = 1")
    grown = F.col("bars") >= 24
    trend = F.when(F.col("bars") < 20, "unknown").when((F.col("close") > F.col("ma20")) & grown & (F.col("ma20") > F.col("before")),
        "up").when((F.col("close") < F.col("ma20")) & grown & (F.col("ma20") < F.col("before")), "down").otherwise("range")
    return moved.select(key, "date", "close", "bars", trend.alias("trend"))


def sector_context(stock_trends: DataFrame, members: DataFrame, sectors: DataFrame, changes: DataFrame, flows: DataFrame, most: int = 6, long_history: int = 260) -> DataFrame:
    """A row for each symbol and each of its first ``most`` sectors: trends, members' breadth and median change, money flow, alignment.

    ``stock_trends(symbol, trend)``, ``sectors`` the sectors' bars, ``changes(symbol, change_rate)`` and ``flows(symbol, net_inflow, amount)``
    of the last day.  Industries come first, then sectors with more bars, fewer members and smaller codes.  A sector
    without bars has data_status missing and no alignment, one with few is a short history.
    """
    told = members.select("sector_code", "symbol", "sector_type")
    up = (F.col("change_rate") > 0).cast("double")
    inside = told.join(changes, "symbol", "left").join(flows, "symbol", "left").groupBy("sector_code").agg(F.count(F.lit(1)).alias("member_count"),
        F.round(F.avg(up) * 100, 2).alias("breadth"), F.round(F.percentile("change_rate", 0.5), 4).alias("median_change"),  # a sector's members on one day
        (ratio(F.sum("net_inflow"), F.sum("amount")) * lit(100)).alias("net_pct"))
    shape = trend_by_average(sectors, "sector_code").select("sector_code", "bars", F.col("trend").alias("sector_trend"))
    joined = told.join(stock_trends.select("symbol", F.col("trend").alias("stock_trend")), "symbol").join(inside, "sector_code").join(shape, "sector_code", "left")
    first = Window.partitionBy("symbol").orderBy(F.col("sector_type") != "industry", F.desc(F.coalesce("bars", F.lit(0))), "member_count", "sector_code")
    chosen = alignment(joined.withColumn("position", F.row_number().over(first)).where(F.col("position") <= most))
    state = F.when(F.col("bars").isNull(), "missing").when(F.col("bars") >= long_history, "ready").otherwise("short_history")
    there = F.col("bars").isNotNull()
    return chosen.select("symbol", "position", "sector_code", "sector_type", "member_count", F.coalesce("bars", F.lit(0)).alias("bars"), "stock_trend",
        F.coalesce("sector_trend", F.lit("unknown")).alias("sector_trend"), "breadth", "median_change", "net_pct", F.when(there, F.col("alignment")).alias("alignment"),
        F.when(there, F.col("label")).alias("label"), state.alias("data_status"))


def last_rows(frame: DataFrame) -> DataFrame:
    """The last row of each symbol with its number of bars, the DIF and DEA before it and its returns in per cent, to one digit."""
    w = by_symbol()
    before = [F.lag(c).over(w).alias(f"{c}_before") for c in ("DIF", "DEA") if c in frame.columns]
    out = frame.select("*", *[F.round((ratio(F.col("close"), F.lag("close", n).over(w)) - lit(1)) * lit(100), 1).alias(f"pct_{n}") for n in (5, 10, 20, 60)],
        F.row_number().over(w).alias("n_bars"), F.row_number().over(w.orderBy(F.desc("date"))).alias("_rn"), *before)
    return out.where("_rn = 1").drop("_rn")


#: Levels that support or resist, and what they weigh.
LEVELS = (("MA20", "strong"), ("MA60", "medium"), ("MA100", "reference"), ("MA200", "reference"), ("BOLL_UPPER", "medium"), ("BOLL_MID", "medium"), ("BOLL_LOWER", "medium"))


def _sides() -> dict[str, Column]:
    """The five nearest supports and resistances by level; bands keep their side, the middle band and averages are where they stand to the close."""
    side = {"BOLL_UPPER": F.lit(False), "BOLL_LOWER": F.lit(True), "BOLL_MID": F.col("BOLL_MID") <= F.col("close")}
    found = F.filter(F.array(*[F.struct(F.round(c, 2).alias("level"), F.lit(i).alias("place"), F.lit(c).alias("type"), F.lit(s).alias("strength"),
        side.get(c, F.col(c) < F.col("close")).alias("under"), (F.col(c) > 0).alias("there")) for i, (c, s) in enumerate(LEVELS)]), lambda x: x["there"])

    def nearest(under: bool) -> Column:
        sign = lit(-1 if under else 1)
        mine = F.filter(found, lambda x: x["under"] if under else ~x["under"])
        ordered = F.array_sort(F.transform(mine, lambda x: F.struct((sign * x["level"]).alias("key"), x["place"].alias("place"), x["level"].alias("level"),
            x["type"].alias("type"), x["strength"].alias("strength"))))
        return F.transform(F.slice(ordered, 1, 5), lambda x: F.struct(x["level"].alias("level"), x["type"].alias("type"), x["strength"].alias("strength")))

    return {"supports": nearest(True), "resistances": nearest(False)}


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _risk() -> dict[str, Column]:
    """Level and items: momentum and losses make a risk high, volatility and valuation only raise a low one; the rest is told and raises nothing."""
    r, j, swing, pe = F.col("RSI14"), F.col("KDJ_J"), F.col("ATR14") / F.col("close") * lit(100), F.col("pe_dynamic")
    listed = _yes(F.col("listed"))
    loss, dear = listed & ~_yes(pe > 0), listed & _yes(pe > 100)
    hot = F.when(_yes(r > 80), 2).when(_yes(r > 70), 1).otherwise(0)
    hot = F.when(_yes(j > 100), 2).otherwise(hot)
    moved = F.when((hot == 0) & _yes(swing > 8), 2).when((hot == 0) & _yes(swing > 5), 1).otherwise(hot)
    valued = F.when(loss, 2).when((moved == 0) & dear, 1).otherwise(moved)
    items = {"rsi_extreme": r > 80, "rsi_overbought": (r > 70) & (r <= 80), "kdj_overbought": j > 100, "swing_extreme": swing > 8, "swing_high": (swing > 5) & (swing <= 8),
        "loss": loss, "dear": dear, "price_to_book": listed & (F.col("pb") > 10), "illiquid": listed & (F.col("turnover_rate") < 1),
        "below_ma60": (F.col("n_bars") >= 60) & (F.col("close") < F.col("MA60"))}
    return {"risk": F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), valued + 1), "risk_items": F.array_compact(F.array(*[F.when(_yes(c), k) for k, c in items.items()]))}


def _advice() -> dict[str, Column]:
    """What to do and how much of a position, by reward to risk, trend and RSI."""
    rr, above = F.col("reward_risk"), _yes(F.col("close") > F.col("MA20"))
    calm = above & _yes(F.col("MA20") > F.col("MA60")) & ~_yes(F.col("RSI14") >= 70)
    ladder = ((rr >= 3) & calm, "enter", "30-50%"), ((rr >= 3) & above, "join", "15-30%"), (rr >= 3, "probe", "5-15%"), ((rr >= 2) & above, "join", "10-20%"), (rr >= 2,
        "wait_or_tiny", "<10%"), (rr > 0, "poor_reward", None)
    what, how_much = F, F
    for holds, a, b in ladder:
        what, how_much = what.when(holds, a), how_much.when(holds, b)
    return {"advice": what.otherwise("no_chance"), "position_pct": how_much.otherwise(None)}


def report(last: DataFrame, spot: DataFrame | None = None) -> DataFrame:
    """Status labels of the indicators, arrangement, direction, levels, risk, stop, reward and advice of each symbol's last row.

    ``spot(symbol, pe_dynamic, pb, turnover_rate)`` adds valuation and liquidity; symbols it lacks have neither risk.  The
    reward is null without a resistance, and -1 where there is none left to the next one.
    """
    r, j, k, d = F.col("RSI14"), F.col("KDJ_J"), F.col("KDJ_K"), F.col("KDJ_D")
    rsi = F.when(r.isNull(), "unknown").when(r > 80, "extreme_overbought").when(r > 70, "overbought").when(r < 20, "extreme_oversold").when(r < 30,
        "oversold").when(r.between(40, 60), "neutral").when(r > 60, "strong").otherwise("weak")
    kdj = F.when(j.isNull(), "unknown").when(j > 100, "overheated").when(j < 0, "exhausted").when((k > 80) & (d > 80),
        "overbought").when((k < 20) & (d < 20), "oversold").when(k > d, "rising").otherwise("falling")
    above, crossed = F.col("DIF") > F.col("DEA"), F.col("DIF_before") <= F.col("DEA_before")
    macd = F.when(above.isNull(), "unknown").when(above & _yes(crossed), "golden_cross").when(above, "bullish").when(_yes(F.col("DIF_before") >= F.col("DEA_before")),
        "death_cross").otherwise("bearish")
    place = ratio(F.col("close") - F.col("BOLL_LOWER"), F.col("BOLL_UPPER") - F.col("BOLL_LOWER")) * lit(100)
    boll = F.when(place.isNull(), "unknown").when(place > 90, "at_upper").when(place > 70, "upper_part").when(place < 10, "at_lower").when(place < 30,
        "lower_part").otherwise("middle")
    arrangement = F.when((F.col("MA5") > F.col("MA10")) & (F.col("MA10") > F.col("MA20")) & (F.col("MA20") > F.col("MA60")),
        "bullish").when((F.col("MA5") < F.col("MA10")) & (F.col("MA10") < F.col("MA20")), "bearish").when(F.col("MA5") > F.col("MA20"), "leaning_up").otherwise("tangled")
    direction = F.when(F.col("pct_5").isNull(), "unknown").when((F.col("pct_5") > 3) & (F.col("pct_20") > 0),
        "strong_rise").when((F.col("pct_5") < -3) & (F.col("pct_20") < 0), "steady_fall").when(F.col("pct_5") > 0, "recovering").when(F.col("pct_5") < 0,
        "pulling_back").otherwise("sideways")
    told = last
    if spot is None:
        told = told.withColumns({"pe_dynamic": F.lit(None).cast("double"), "pb": F.lit(None).cast("double"), "turnover_rate": F.lit(None).cast("double"), "listed": F.lit(False)})
    else:
        told = told.join(spot.select("symbol", "pe_dynamic", "pb", "turnover_rate", F.lit(True).alias("listed")), "symbol", "left")
    told = told.withColumns(_sides()).withColumns({"support": F.try_element_at("supports", F.lit(1))["level"], "resistance": F.try_element_at("resistances", F.lit(1))["level"]})
    atr, near = F.nullif(F.col("ATR14"), lit(0)), F.round(F.col("support") - F.col("ATR14"), 2)
    stop = F.when(atr.isNotNull() & near.isNotNull(), F.when((F.col("close") - near) / F.col("close") * lit(100) > lit(15), F.round(F.col("close") * lit(0.93),
        2)).otherwise(near)).when(atr.isNotNull(), F.round(F.col("close") - lit(2) * F.col("ATR14"), 2)).otherwise(F.round(F.col("close") * lit(0.95), 2))
    told = told.withColumn("stop", stop)
    risk, reward = F.col("close") - F.col("stop"), F.col("resistance") - F.col("close")
    told = told.withColumn("reward_risk", F.when((risk > 0) & (reward > 0), F.round(reward / risk, 2)).when((risk > 0) & reward.isNotNull(), lit(-1)))
    return told.select("symbol", "date", "close", rsi.alias("rsi_status"), macd.alias("macd_status"), kdj.alias("kdj_status"), boll.alias("boll_status"),
        _yes(F.col("close") > F.col("BOLL_MID")).alias("above_mid"), arrangement.alias("arrangement"), direction.alias("direction"), "pct_5", "pct_10", "pct_20", "pct_60",
        "supports", "resistances", "support", "resistance", F.col("ATR14").alias("atr"), *[c.alias(n) for n, c in _risk().items()], "stop", "reward_risk",
        *[c.alias(n) for n, c in _advice().items()])


def sector_cohort(members: DataFrame, frame: DataFrame, least: int = 20, most: int = 10) -> DataFrame:
    """Of each sector's first members with enough bars, how many stand above a rising MA20.

    ``frame``: bars with MA20; ``most`` members of a sector are looked at, in the order of their symbols.
    """
    w = by_symbol()
    seen = frame.select("symbol", "date", "close", "MA20", F.lag("MA20", 5).over(w).alias("before"), F.count(F.lit(1)).over(w).alias("n"),
        F.row_number().over(w.orderBy(F.desc("date"))).alias("rn")).where("rn = 1").where(F.col("n") >= least)
    good = F.coalesce((F.col("close") > F.col("MA20")) & (F.col("MA20") > F.col("before")), F.lit(False))
    joined = members.select("sector_code", "symbol").join(seen.select("symbol", good.alias("good")), "symbol")
    chosen = joined.withColumn("position", F.row_number().over(Window.partitionBy("sector_code").orderBy("symbol"))).where(F.col("position") <= most)
    return chosen.groupBy("sector_code").agg(F.count(F.lit(1)).alias("analysed"), F.count_if("good").alias("good_trend"))


def write_report(frame: DataFrame, path: str, kind: str = "csv", most: int = 10_000) -> str:
    """A small result as one csv, json or markdown file on the driver; larger results are tables, not reports."""
    rows = frame.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    if kind == "csv":
        rows.to_csv(path, index=False)
    elif kind == "json":
        rows.to_json(path, orient="records", date_format="iso")
    else:
        lines = [rows.columns, ["-"] * len(rows.columns), *rows.astype(str).values.tolist()]
        with open(path, "w") as out:
            out.writelines("|" + "|".join(map(str, line)) + "|\n" for line in lines)
    return path
