"""Filters, rankings and screens over market snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Condition name -> (column, whether it is a lower limit).
CONDITIONS = {
    "min_price": ("latest_price", True), "max_price": ("latest_price", False), "min_change": ("change_rate", True), "max_change": ("change_rate", False),
    "min_volume_ratio": ("volume_ratio", True), "max_volume_ratio": ("volume_ratio", False), "min_turnover": ("turnover_rate", True),
    "max_turnover": ("turnover_rate", False),
    "min_pe": ("pe_dynamic", True), "max_pe": ("pe_dynamic", False), "min_pb": ("pb", True), "max_pb": ("pb", False),
    "min_market_cap": ("total_market_cap", True), "max_market_cap": ("total_market_cap", False), "min_float_cap": ("float_market_cap", True),
    "min_change_60d": ("change_60d", True),
    "min_change_ytd": ("change_ytd", True), "max_amplitude": ("amplitude", False),
}
SORTS = ("latest_price", "change_rate", "volume", "amount", "volume_ratio", "turnover_rate", "total_market_cap", "change_60d", "change_ytd", "amplitude")


def conditions(wanted: dict[str, float | None]) -> Column:
    """All known limits that have a value; unknown names and missing values say nothing."""
    found = [(F.col(c) >= v if lower else F.col(c) <= v) for k, v in wanted.items() if v is not None and k in CONDITIONS for c, lower in [CONDITIONS[k]]]
    return reduce(lambda a, b: a & b, found, F.lit(True))


def keyword(text: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).cast("string").contains(text.strip()) for c in columns])


def without_st(basics: DataFrame) -> DataFrame:
    return basics.where(~F.col("name").contains("ST"))


def top(frame: DataFrame, by: str, n: int, ascending: bool = False, tie: str = "symbol") -> DataFrame:
    """The n rows that lead by a column, missing values last, ties by key."""
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return frame.orderBy(order, tie).limit(n)


def top_per_group(frame: DataFrame, group: str, by: str, n: int, tie: str = "symbol") -> DataFrame:
    window = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), tie)
    return frame.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)


def latest_ranks(ranks: DataFrame) -> DataFrame:
    """Ranks of the latest date, through a one-row aggregate."""
    last = ranks.agg(F.max("rank_date").alias("rank_date"))
    return ranks.join(F.broadcast(last), "rank_date")


def screen(spot: DataFrame, ranks: DataFrame, wanted: dict[str, float | None], sort: str = "change_rate", n: int = 20, members: DataFrame | None = None,
    name: str | None = None) -> DataFrame:
    """Snapshot rows under all conditions, the members' and the name's included, with their latest rank, best first."""
    out = spot.where(conditions(wanted))
    if name:
        out = out.where(keyword(name, "name", "symbol"))
    if members is not None:
        out = out.join(members.select("symbol").distinct(), "symbol", "left_semi")
    out = out.join(latest_ranks(ranks).select("symbol", F.col("rank").alias("popularity_rank")), "symbol", "left")
    return top(out, "popularity_rank", n, ascending=True) if sort == "popularity_rank" else top(out, sort if sort in SORTS else "change_rate", n)


def golden_cross(frame: DataFrame) -> DataFrame:
    """Rows where MA5 rises above MA20."""
    w = Window.partitionBy("symbol").orderBy("date")
    return frame.where(F.col("MA20").isNotNull()).withColumn("p5", F.lag("MA5").over(w)).withColumn("p20", F.lag("MA20").over(w)).where("MA5 > MA20 and p5 <= p20")


def latest(frame: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    return frame.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


SCREENS: dict[str, tuple[Column | str, str, bool]] = {
    "volume_surge": ("volume_ratio >= 2 and change_rate > 0", "volume_ratio", False),
    "strong_breakout": ("change_rate >= 1.5 and turnover_rate >= 0.15", "change_rate", False),
    "low_pe_growth": ("pe_dynamic > 0 and pe_dynamic < 20 and volume_ratio > 1 and change_rate > 0", "pe_dynamic", True),
    "ma_bullish": ("change_rate > 0 and volume_ratio > 1 and change_60d > 0", "change_60d", False),
}


def sample_symbols(frame: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n symbols drawn by a hash of seed and symbol: the same ones each time."""
    return frame.select("symbol").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("symbol").cast("string")).cast("binary"))).limit(n)


def search(basics: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The first n symbols whose name or code has the text in it, whatever its case."""
    wanted = text.strip().lower()
    return basics.where(F.lower("name").contains(wanted) | F.lower(F.col("symbol").cast("string")).contains(wanted)).orderBy("symbol").limit(n)


def sector_overview(members: DataFrame, spot: DataFrame) -> DataFrame:
    """Members, gainers and losers of each sector; a member without change counts as neither, nor does a change of zero."""
    change = F.col("change_rate")
    joined = members.join(spot.select("symbol", "change_rate"), "symbol", "left")
    return joined.groupBy("sector_code", "sector_name", "sector_type").agg(F.count(F.lit(1)).alias("member_count"),
        F.count_if(change > 0).alias("gainer_count"), F.count_if(change < 0).alias("loser_count"))


def sector_members(members: DataFrame, spot: DataFrame, ranks: DataFrame, sort: str = "change_rate", n: int = 50) -> DataFrame:
    """Each sector's first n members by a snapshot column, missing values last, with their latest popularity rank."""
    key = sort if sort in ("change_rate", "turnover_rate", "volume_ratio", "latest_price", "volume") else "change_rate"
    joined = members.select("sector_code", "symbol").join(spot, "symbol", "left").withColumn("_key", F.coalesce(F.col(key), F.lit(-9999.0)))
    best = top_per_group(joined, "sector_code", "_key", n).drop("_key")
    return best.join(latest_ranks(ranks).select("symbol", F.col("rank").alias("popularity_rank")), "symbol", "left")


def quick_signals(averaged: DataFrame, rsi: str = "WILDER_RSI", key: str = "symbol") -> DataFrame:
    """Five signals of each bar - cross of MA5 over MA20, four averages in order, volume above twice the five bars before, RSI beyond 30 or 70 - and its changes over 5 and 20 bars."""
    w = Window.partitionBy(key).orderBy("date")
    five = w.rowsBetween(-5, -1)
    surge = F.when(F.count("volume").over(five) == 5, F.avg("volume").over(five))
    no = F.lit(False)
    seen = averaged.select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in ("MA5", "MA20")], surge.alias("_v5"),
        *[((F.col("close") / F.lag("close", n).over(w) - F.lit(1.0)) * 100).alias(f"pct_{n}") for n in (5, 20)])
    flags = {
        "golden_cross": (F.col("MA5") > F.col("MA20")) & (F.col("_MA5") <= F.col("_MA20")),
        "aligned": (F.col("MA5") > F.col("MA10")) & (F.col("MA10") > F.col("MA20")) & (F.col("MA20") > F.col("MA60")),
        "surge": (F.col("_v5") > 0) & (F.col("volume") > F.col("_v5") * 2), "oversold": F.col(rsi) < 30, "overbought": F.col(rsi) > 70,
    }
    return seen.select(key, "date", *[F.coalesce(c, no).alias(k) for k, c in flags.items()], "pct_5", "pct_20")


def candidate_universe(basics: DataFrame, covered: DataFrame, least: int = 260, most: int = 0) -> DataFrame:
    """(symbol, name, row_count) of symbols with enough bars and without ST in their names, longest histories first; ``most`` of them, 0 for all."""
    out = basics.where(~F.coalesce(F.col("name").contains("ST"), F.lit(True))).join(covered.where(F.col("row_count") >= least).select("symbol", "row_count"), "symbol")
    out = out.select("symbol", "name", "row_count").orderBy(F.desc("row_count"), "symbol")
    return out.limit(most) if most > 0 else out
