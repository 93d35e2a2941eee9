"""Queries over bars, indicators, screens and tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, rounded, trailing
from candela.operators import indicators as ta
from candela.operators import research, resample, screens, store
from candela.plans.oracle import W, full, with_ctes
from candela.plans.oracle import rounded as r
from candela.plans.registry import query
from candela.sources import bars as src

BAR = "open high low close volume amount"


def _select(frame, columns: str, *keys: str):
    return frame.select(*(keys or ("symbol", "date")), *rounded(columns.split()))


def _ind(spark, d):
    return ta.native_indicators(src.with_change(src.bars(spark, d)))


@query(with_ctes(f"SELECT symbol, date, {r(BAR)} FROM bars", "bars"))
def bars_daily(spark, d):
    return _select(src.bars(spark, d), BAR)


@query(with_ctes(f"SELECT symbol, date, {r(BAR)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS rn FROM (SELECT *, 1 "
    f"AS seq FROM bars UNION ALL SELECT symbol, date, open, CASE WHEN day(date) = 1 THEN 0 ELSE high END, low, close * 1.01::DOUBLE, volume, amount, 2 "
    f"FROM bars WHERE day(date) <= 2)) WHERE rn = 1 AND high > 0 AND low > 0 AND close > 0 AND high >= low", "bars"))
def bars_clean(spark, d):
    """Corrections replace bars; bars without positive prices go."""
    frame = src.bars(spark, d)
    fixes = frame.where(F.day("date") <= 2).withColumn("high", F.when(F.day("date") == 1, lit(0)).otherwise(F.col("high"))).withColumn("close",
        F.col("close") * lit(1.01))
    kept = store.upsert(frame, fixes, ["symbol", "date"])
    return _select(kept.where("high > 0 and low > 0 and close > 0 and high >= low"), BAR)


@query(with_ctes(f"SELECT symbol, date, source_date, {r(BAR)} FROM weekly", "weekly"))
def bars_weekly(spark, d):
    return _select(resample.weekly(src.bars(spark, d)), BAR, "symbol", "date", "source_date")


@query(with_ctes(f"SELECT symbol, date, source_date, {r(BAR)} FROM monthly", "monthly"))
def bars_monthly(spark, d):
    return _select(resample.monthly(src.bars(spark, d)), BAR, "symbol", "date", "source_date")


@query(with_ctes("SELECT symbol, date, source_date, date > source_date AS incomplete FROM weekly", "weekly"))
def incomplete_flag(spark, d):
    return resample.with_incomplete(resample.weekly(src.bars(spark, d))).select("symbol", "date", "source_date", "incomplete")


@query("SELECT max(l_shipdate::DATE) AS latest FROM lineitem")
def latest_trade_date(spark, d):
    return src.table(spark, d, "lineitem").agg(F.max(F.col("l_shipdate").cast("date")).alias("latest"))


@query("WITH c AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem) SELECT date, lag(date) OVER (ORDER BY date) AS previous FROM c")
def trade_calendar_prev(spark, d):
    """Trading days with the trading day before: a few thousand dates, whatever the number of bars."""
    days = src.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return days.select("date", F.lag("date").over(Window.orderBy("date")).alias("previous"))


@query(with_ctes("SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS row_count, CASE WHEN count(*) >= 260 THEN 'ready' ELSE "
    "'partial' END AS status FROM bars GROUP BY symbol", "bars"))
def coverage(spark, d):
    return store.coverage(src.bars(spark, d))


@query(with_ctes("SELECT count(DISTINCT symbol) AS total, count(DISTINCT CASE WHEN n > 0 THEN symbol END) AS covered, sum(CASE WHEN n >= 260 THEN 1 ELSE 0 "
    "END)::BIGINT AS ready, max(latest) AS latest, sum(CASE WHEN n >= 260 THEN 1 ELSE 0 END) / count(DISTINCT symbol)::DOUBLE AS ratio, sum(CASE WHEN n >= "
    "260 THEN 1 ELSE 0 END) / count(DISTINCT symbol)::DOUBLE >= 0.95::DOUBLE AS full_market_ready FROM basics LEFT JOIN (SELECT symbol, count(*) AS n, "
    "max(date) AS latest FROM bars GROUP BY symbol) USING (symbol)", "basics", "bars"))
def db_status(spark, d):
    return store.status(src.basics(spark, d), store.coverage(src.bars(spark, d)))


_MA = " ".join(f"MA{n}" for n in ta.MA_WINDOWS)


@query(with_ctes(f"SELECT symbol, date, {r(_MA)} FROM ind", "ind"))
def sma_all(spark, d):
    return _select(ta.moving_averages(src.bars(spark, d)), _MA)


@query(with_ctes(f"SELECT symbol, date, {r('BOLL_MID BOLL_UPPER BOLL_LOWER')} FROM ind", "ind"))
def boll(spark, d):
    return _select(ta.bollinger(src.bars(spark, d)), "BOLL_MID BOLL_UPPER BOLL_LOWER")


@query(with_ctes(f"SELECT symbol, date, {r('TR ATR14')} FROM ind", "ind"))
def atr14(spark, d):
    return _select(ta.atr(src.bars(spark, d)), "TR ATR14")


@query(with_ctes(f"SELECT symbol, date, round(avg(TR) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING), 6) AS ATR14 FROM (SELECT *, "
    f"greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS TR FROM bars)", "bars"))
def atr_min1(spark, d):
    return _select(ta.atr(src.bars(spark, d), complete=False), "ATR14")


@query(with_ctes(f"SELECT symbol, date, {r('VOL_MA5 VOL_MA10 VOL_MA20 VOL_RATIO5 VOL_RATIO20')} FROM ind", "ind"))
def vol_ratios(spark, d):
    return _select(_ind(spark, d), "VOL_MA5 VOL_MA10 VOL_MA20 VOL_RATIO5 VOL_RATIO20")


@query(with_ctes(f"SELECT symbol, date, {r('ATR_PCT BIAS20 BIAS60 BIAS250')} FROM ind", "ind"))
def bias_atrpct(spark, d):
    return _select(_ind(spark, d), "ATR_PCT BIAS20 BIAS60 BIAS250")


@query(with_ctes(f"SELECT symbol, date, {r('RETURN_5 RETURN_10 RETURN_20 RETURN_60')} FROM ind", "ind"))
def returns(spark, d):
    return _select(_ind(spark, d), "RETURN_5 RETURN_10 RETURN_20 RETURN_60")


_EXT = " ".join(f"HIGH_{n} LOW_{n}" for n in ta.EXTREME_WINDOWS)


@query(with_ctes(f"SELECT symbol, date, {r(_EXT)} FROM ind", "ind"))
def rolling_extremes(spark, d):
    return _select(_ind(spark, d), _EXT)


_FAC = "updown_ratio_20 up_days_ratio_20 turnover_ma20 vol_ratio BIAS60 boll_pos boll_width"


@query(with_ctes(f"SELECT symbol, date, {r(_FAC)}, ma_bull FROM fac", "fac"))
def factors20(spark, d):
    return ta.simple_factors(_ind(spark, d)).select("symbol", "date", *rounded(_FAC.split()), "ma_bull")


@query(with_ctes("SELECT symbol, date, is_yang, above_ma5, break_high5, break_high10, break_close40, is_yang AND above_ma5 AND break_high5 AS rebound, "
    "coalesce(is_yang AND vol_ratio >= 1.5, false) AS yang_vol15, coalesce(is_yang AND break_close40 AND vol_ratio >= 1.5, false) AS box FROM fac", "fac"))
def breakout_flags(spark, d):
    """Breakouts and the cheap gates of the detectors."""
    yes = [F.coalesce(c, F.lit(False)).alias(n) for n, c in (("yang_vol15", F.expr("is_yang and vol_ratio >= 1.5D")),
        ("box", F.expr("is_yang and break_close40 and vol_ratio >= 1.5D")))]
    return ta.simple_factors(_ind(spark, d)).select("symbol", "date", "is_yang", "above_ma5", "break_high5", "break_high10", "break_close40",
        F.expr("is_yang and above_ma5 and break_high5").alias("rebound"), *yes)


@query(with_ctes("SELECT symbol, date, round(peak, 6) AS peak, round(close / peak - 1, 6) AS drawdown FROM (SELECT *, max(close) OVER (PARTITION BY symbol "
    "ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM bars)", "bars"))
def drawdown(spark, d):
    peak = F.max("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return src.bars(spark, d).select("symbol", "date", "close", peak.alias("peak")).select("symbol", "date", F.round("peak", 6).alias("peak"),
        F.round(F.col("close") / F.col("peak") - 1, 6).alias("drawdown"))


_RSI_REC = "e(symbol, rn, {cols}) AS (SELECT symbol, rn, {first} FROM d WHERE rn = 1 UNION ALL SELECT d.symbol, d.rn, {step} FROM e JOIN d ON d.symbol = e.symbol AND d.rn = e.rn + 1)"


def _ema(cols: dict[str, tuple[str, str]]) -> str:
    """A recursive relation of exponential averages: name -> (value in d, alpha); an average that equals the value stays as it is."""
    first = ", ".join(f"{v}::DOUBLE" for v, _ in cols.values())
    step = ", ".join(f"CASE WHEN e.{n} = d.{v} THEN e.{n} ELSE e.{n} * (1 - ({a})::DOUBLE) + d.{v} * ({a})::DOUBLE END" for n, (v, a) in cols.items())
    return _RSI_REC.format(cols=", ".join(cols), first=first, step=step)


_GAINS = f"d AS (SELECT symbol, date, rn, greatest(coalesce(x, 0), 0) AS g, greatest(coalesce(-x, 0), 0) AS l FROM (SELECT *, close - lag(close) {W} AS x, row_number() {W} AS rn FROM bars))"
_RSI = {f"{k}{p}": (k, f"1.0::DOUBLE / {p}") for p in (6, 14, 24) for k in "gl"}


@query(with_ctes("SELECT symbol, date, " + ", ".join(f"CASE WHEN rn >= {p} THEN round(100 - 100 / (1 + g{p} / nullif(l{p}, 0)), 6) END AS "
    f"RSI{p}" for p in (6, 14, 24)) + " FROM e JOIN d USING (symbol, rn)", "bars", recursive=f"{_GAINS}, {_ema(_RSI)}"))
def rsi(spark, d):
    return _select(ta.exponential_indicators(src.bars(spark, d)), "RSI6 RSI14 RSI24")


_CLOSES = f"d AS (SELECT symbol, date, close, row_number() {W} AS rn FROM bars)"
_MACD = _CLOSES + ", " + _ema({"a": ("close", "2.0::DOUBLE / 13"), "b": ("close",
    "2.0::DOUBLE "
    "/ 27")}) + ", d2 AS (SELECT symbol, rn, a - b AS dif FROM e), e2(symbol, rn, dea) AS (SELECT symbol, rn, dif FROM d2 WHERE rn = 1 UNION ALL SELECT d2.symbol, d2.rn, CASE WHEN e2.dea = d2.dif THEN e2.dea ELSE e2.dea * (1 - 2.0::DOUBLE / 10) + d2.dif * (2.0::DOUBLE / 10) END FROM e2 JOIN d2 ON d2.symbol = e2.symbol AND d2.rn = e2.rn + 1)"


@query(with_ctes("SELECT symbol, date, round(dif, 6) AS DIF, round(dea, 6) AS DEA, round(2 * (dif - dea), 6) AS MACD FROM d JOIN d2 USING (symbol, rn) "
    "JOIN e2 USING (symbol, rn)", "bars", recursive=_MACD))
def macd(spark, d):
    return _select(ta.exponential_indicators(src.bars(spark, d)), "DIF DEA MACD")


_KDJ = f"""d AS (SELECT symbol, date, rn - 8 AS rn, (close - l9) / nullif(h9 - l9, 0) * 100 AS raw FROM (SELECT *, row_number() {W} AS rn, {full(9, 'max(high)', 'high')} AS h9, {full(9, 'min(low)', 'low')} AS l9 FROM bars) WHERE rn >= 9),
 e(symbol, rn, k) AS (SELECT symbol, rn, raw FROM d WHERE rn = 1 UNION ALL SELECT d.symbol, d.rn, e.k * (1 - 1.0::DOUBLE / 3) + d.raw * (1.0::DOUBLE / 3) FROM e JOIN d ON d.symbol = e.symbol AND d.rn = e.rn + 1),
 e2(symbol, rn, dd) AS (SELECT symbol, rn, k FROM e WHERE rn = 3 UNION ALL SELECT e.symbol, e.rn, e2.dd * (1 - 1.0::DOUBLE / 3) + e.k * (1.0::DOUBLE / 3) FROM e2 JOIN e ON e.symbol = e2.symbol AND e.rn = e2.rn + 1)"""


@query(with_ctes("SELECT b.symbol, b.date, round(k, 6) AS KDJ_K, round(dd, 6) AS KDJ_D, round(3 * k - 2 * dd, 6) AS KDJ_J FROM bars b LEFT JOIN (SELECT "
    "symbol, date, CASE WHEN rn >= 3 THEN k END AS k, CASE WHEN rn >= 5 THEN dd END AS dd FROM d JOIN e USING (symbol, rn) LEFT JOIN e2 USING (symbol, "
    "rn)) USING (symbol, date)", "bars", recursive=_KDJ))
def kdj(spark, d):
    return _select(ta.exponential_indicators(src.bars(spark, d)), "KDJ_K KDJ_D KDJ_J")


@query(with_ctes("SELECT symbol, date, gold AS macd_gold, max(gold) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING) AS macd_gold3, (dif < "
    "0)::INT AS dif_below0, (dif > 0)::INT AS dif_above_zero FROM (SELECT symbol, date, dif, coalesce(dif > dea AND lag(dif) OVER (PARTITION BY symbol "
    "ORDER BY date) <= lag(dea) OVER (PARTITION BY symbol ORDER BY date), false)::INT AS gold FROM d JOIN d2 USING (symbol, rn) JOIN e2 USING (symbol, "
    "rn))", "bars", recursive=_MACD))
def crosses(spark, d):
    return ta.crosses(ta.exponential_indicators(src.bars(spark, d))).select("symbol", "date", "macd_gold", "macd_gold3", "dif_below0", "dif_above_zero")


_SPOT = "latest_price change_rate volume_ratio turnover_rate pe_dynamic change_60d"


@query(with_ctes(f"SELECT symbol, name, {r(_SPOT + ' total_market_cap amplitude change_ytd')} FROM spot", "spot"))
def spot_snapshot(spark, d):
    return _select(src.spot(spark, d), _SPOT + " total_market_cap amplitude change_ytd", "symbol", "name")


@query(with_ctes(f"SELECT symbol, name, {r(_SPOT)} FROM spot WHERE latest_price >= 50 AND latest_price <= 200 AND pe_dynamic >= 0 AND volume_ratio >= 0.5 "
    f"AND amplitude <= 20", "spot"))
def screen_conditions(spark, d):
    return _select(src.spot(spark, d).where(screens.conditions({"min_price": 50, "max_price": 200, "min_pe": 0, "min_volume_ratio": 0.5,
        "max_amplitude": 20, "unknown": 1, "max_pb": None})), _SPOT, "symbol", "name")


@query(with_ctes("SELECT symbol, name FROM basics WHERE contains(name, '7') OR contains(symbol::VARCHAR, '7')", "basics"))
def screen_keyword(spark, d):
    return src.basics(spark, d).where(screens.keyword(" 7 ", "name", "symbol")).select("symbol", "name")


@query(with_ctes(f"SELECT symbol, name, {r(_SPOT)}, rank AS popularity_rank FROM spot LEFT JOIN (SELECT symbol, rank FROM ranks WHERE rank_date = (SELECT "
    f"max(rank_date) FROM ranks)) USING (symbol) WHERE latest_price >= 20 AND symbol IN (SELECT symbol FROM members WHERE sector_code = 'R1') ORDER BY "
    f"change_rate DESC NULLS LAST, symbol LIMIT 20", "spot", "ranks", "members"))
def screen_sector_semi(spark, d):
    inside = src.members(spark, d).where("sector_code = 'R1'")
    return _select(screens.screen(src.spot(spark, d), src.ranks(src.bars(spark, d)), {"min_price": 20}, members=inside), _SPOT, "symbol", "name", "popularity_rank")


@query(with_ctes("SELECT symbol, name, rank AS popularity_rank FROM spot LEFT JOIN (SELECT symbol, rank FROM ranks WHERE rank_date = (SELECT "
    "max(rank_date) FROM ranks)) USING (symbol) ORDER BY rank ASC NULLS LAST, symbol LIMIT 30", "spot", "ranks"))
def screen_rank_sort(spark, d):
    return screens.screen(src.spot(spark, d), src.ranks(src.bars(spark, d)), {}, sort="popularity_rank", n=30).select("symbol", "name", "popularity_rank")


@query(with_ctes(f"SELECT symbol, date, {r('MA5 MA20')} FROM (SELECT *, lag(MA5) {W} AS p5, lag(MA20) {W} AS p20 FROM ind WHERE MA20 IS NOT NULL) WHERE "
    f"MA5 > MA20 AND p5 <= p20", "ind"))
def golden_cross(spark, d):
    return _select(screens.golden_cross(ta.moving_averages(src.bars(spark, d))), "MA5 MA20")


def _screen(name: str):
    where, sort, ascending = screens.SCREENS[name]

    def run(spark, d):
        return _select(screens.top(src.spot(spark, d).where(where.replace("1.5", "1.5D").replace("0.15 ", "0.15D ")), sort, 20, ascending), _SPOT, "symbol", "name")

    query(with_ctes(f"SELECT symbol, name, {r(_SPOT)} FROM spot WHERE {where} ORDER BY {sort} {'ASC' if ascending else 'DESC'} NULLS LAST, symbol LIMIT "
        f"20", "spot"), name)(run)


for _name in screens.SCREENS:
    _screen(_name)


@query(with_ctes("SELECT symbol, date, round(100 - 100 / (1 + g14 / nullif(l14, 0)), 6) AS RSI14, round(change_rate, 6) AS change_rate FROM e JOIN d USING "
    "(symbol, rn) JOIN changed USING (symbol, date) WHERE rn >= 14 AND 100 - 100 / (1 + g14 / nullif(l14, 0)) < 30 AND change_rate > 0", "changed",
    recursive=f"{_GAINS}, {_ema(_RSI)}"))
def oversold_reversal(spark, d):
    return _select(ta.exponential_indicators(src.with_change(src.bars(spark, d))).where("RSI14 < 30 and change_rate > 0"), "RSI14 change_rate")


@query(with_ctes("SELECT sector_code, sector_name, members, round(change, 6) AS change FROM (SELECT sector_code, sector_name, count(*) AS members, "
    "avg(change_rate) AS change FROM members JOIN spot USING (symbol) GROUP BY ALL) WHERE change IS NOT NULL ORDER BY change DESC, sector_code LIMIT 10",
    "members", "spot"))
def top_sectors(spark, d):
    means = src.members(spark, d).join(src.spot(spark, d).select("symbol", "change_rate"), "symbol").groupBy("sector_code",
        "sector_name").agg(F.count(F.lit(1)).alias("members"), F.avg("change_rate").alias("change"))
    return screens.top(means.where("change is not null"), "change", 10, tie="sector_code").withColumn("change", F.round("change", 6))


@query(with_ctes("SELECT sector_code, symbol, name, position, round(change_rate, 6) AS change_rate FROM (SELECT sector_code, symbol, name, change_rate, "
    "row_number() OVER (PARTITION BY sector_code ORDER BY change_rate DESC NULLS LAST, symbol) AS position FROM members JOIN spot USING (symbol)) WHERE "
    "position <= 3", "members", "spot"))
def sector_leaders(spark, d):
    joined = src.members(spark, d).select("sector_code", "symbol").join(src.spot(spark, d).select("symbol", "name", "change_rate"), "symbol")
    return screens.top_per_group(joined, "sector_code", "change_rate", 3).select("sector_code", "symbol", "name", "position",
        F.round("change_rate", 6).alias("change_rate"))


@query(with_ctes("SELECT m.symbol, m.sector_code, m.sector_type, (SELECT count(*) FROM sector_bars s WHERE s.sector_code = m.sector_code) AS bar_count, "
    "(SELECT min(date) FROM sector_bars s WHERE s.sector_code = m.sector_code) AS first_date, (SELECT max(date) FROM sector_bars s WHERE s.sector_code = "
    "m.sector_code) AS last_date, (SELECT count(*) FROM members x WHERE x.sector_code = m.sector_code) AS member_count FROM members m", "members", "sector_bars"))
def stock_sectors(spark, d):
    """Each symbol's sectors with their histories and sizes, aggregated once and joined."""
    member = src.members(spark, d)
    history = src.sector_bars(src.bars(spark, d), member).groupBy("sector_code").agg(F.count(F.lit(1)).alias("bar_count"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    size = member.groupBy("sector_code").agg(F.count(F.lit(1)).alias("member_count"))
    out = member.join(history, "sector_code", "left").join(size, "sector_code", "left")
    return out.select("symbol", "sector_code", "sector_type", F.coalesce("bar_count", F.lit(0)).alias("bar_count"), "first_date", "last_date", "member_count")


@query(with_ctes("SELECT symbol, rank_date, rank, lag(rank) OVER (PARTITION BY symbol ORDER BY rank_date) - rank AS gain FROM ranks", "ranks"))
def rank_trend(spark, d):
    """Rank history of every symbol with the places gained."""
    history = src.ranks(src.bars(spark, d))
    return history.select("symbol", "rank_date", "rank", (F.lag("rank").over(by_symbol("symbol", "rank_date")) - F.col("rank")).alias("gain"))


@query(with_ctes("SELECT sector_code, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, "
    "2) AS volume FROM sector_bars", "sector_bars"))
def sector_index(spark, d):
    return src.sector_bars(src.bars(spark, d), src.members(spark, d)).select("sector_code", "date", *rounded(["open", "high", "low", "close"]),
        F.round("volume", 2).alias("volume"))


@query(with_ctes("SELECT date, round(avg((change_rate > 0)::INT::DOUBLE) * 100, 6) AS breadth, round(median(change_rate), 6) AS median_change, "
    "sum((change_rate > 0)::INT)::BIGINT AS gainers, sum((change_rate < 0)::INT)::BIGINT AS losers, sector_code FROM members JOIN changed USING (symbol) "
    "WHERE change_rate IS NOT NULL GROUP BY sector_code, date", "members", "changed"))
def sector_breadth(spark, d):
    joined = src.members(spark, d).select("sector_code", "symbol").join(src.with_change(src.bars(spark, d)).where("change_rate is not null"), "symbol")
    up, down = F.col("change_rate") > 0, F.col("change_rate") < 0
    return joined.groupBy("sector_code", "date").agg(F.round(F.avg(up.cast("double")) * 100, 6).alias("breadth"),
        F.round(F.percentile("change_rate", 0.5), 6).alias("median_change"), F.count_if(up).alias("gainers"), F.count_if(down).alias("losers"))


@query(with_ctes(f"SELECT sector_code, CASE WHEN n < 20 THEN 'unknown' WHEN close > ma20 AND ma20 - coalesce(CASE WHEN n >= 24 THEN ma20_4 END, ma20) >= 0 "
    f"AND n >= 24 AND ma20 > ma20_4 THEN 'up' WHEN close < ma20 AND n >= 24 AND ma20 < ma20_4 THEN 'down' ELSE 'range' END AS trend FROM (SELECT *, "
    f"lag(ma20, 4) OVER (PARTITION BY sector_code ORDER BY date) AS ma20_4, row_number() OVER (PARTITION BY sector_code ORDER BY date) AS n, row_number() "
    f"OVER (PARTITION BY sector_code ORDER BY date DESC) AS back FROM (SELECT *, avg(close) OVER (PARTITION BY sector_code ORDER BY date ROWS 19 "
    f"PRECEDING) AS ma20 FROM sector_bars)) WHERE back = 1", "sector_bars"))
def sector_trend(spark, d):
    """Close against MA20 and the average's move over four bars."""
    return research.trend_by_average(src.sector_bars(src.bars(spark, d), src.members(spark, d)), "sector_code").select("sector_code", "trend")


@query(with_ctes(f"SELECT symbol, date, {r(BAR)}, source FROM (SELECT *, 'old' AS source FROM bars WHERE NOT (symbol % 3 = 0 AND date >= DATE "
    f"'1997-01-01') UNION ALL SELECT symbol, date, open, high, low, close * 2, volume, NULL, 'new' FROM bars WHERE symbol % 3 = 0 AND date >= DATE "
    f"'1997-01-01')", "bars"))
def upsert_replace(spark, d):
    frame = src.bars(spark, d)
    new = frame.where("symbol % 3 = 0 and date >= date'1997-01-01'").withColumn("close", F.col("close") * 2).withColumn("source", F.lit("new")).drop("amount")
    return _select(store.upsert(frame.withColumn("source", F.lit("old")), new, ["symbol", "date"]), BAR, "symbol", "date", "source")


@query(
    with_ctes(
        "SELECT symbol, rank_date, CASE WHEN rank BETWEEN 10 AND 40 AND rank % 2 = 0 THEN rank + 100 WHEN rank <= 20 THEN rank END AS rank, "
        "CASE WHEN rank BETWEEN 10 AND 40 THEN 'second' ELSE 'first' END AS source FROM ranks WHERE rank <= 40",
        "ranks",
    )
)
def rank_coalesce_merge(spark, d):
    ranks = src.ranks(src.bars(spark, d))
    old = ranks.where("rank <= 20").withColumn("source", F.lit("first"))
    new = ranks.where("rank between 10 and 40").withColumn("rank", F.when(F.col("rank") % 2 == 0, F.col("rank") + 100)).withColumn("source", F.lit("second"))
    return store.merge_coalesce(old, new, ["symbol", "rank_date"]).select("symbol", "rank_date", "rank", "source")


@query(with_ctes("SELECT rank_date AS trade_date, symbol, name, rank, round(coalesce(s.latest_price, b.close), 6) AS close, round(b.volume, 6) AS volume, "
    "round(s.pe_dynamic, 6) AS pe_dynamic FROM ranks k JOIN bars b ON b.symbol = k.symbol AND b.date = k.rank_date LEFT JOIN basics USING (symbol) LEFT "
    "JOIN (SELECT symbol, trade_date, latest_price, pe_dynamic FROM spot) s ON s.symbol = b.symbol AND s.trade_date = b.date", "ranks", "bars", "basics",
    "spot").replace("rank_date AS trade_date, symbol,", "k.rank_date AS trade_date, k.symbol,").replace("LEFT JOIN basics USING (symbol)",
    "LEFT JOIN basics i ON i.symbol = k.symbol"))
def combined_merge(spark, d):
    """Ranks and bars of a day, then the snapshot merged in: its values win where it has any."""
    frame = src.bars(spark, d)
    day = src.ranks(frame).withColumnRenamed("rank_date", "trade_date").join(frame.withColumnRenamed("date", "trade_date"), ["symbol", "trade_date"])
    day = day.join(src.basics(spark, d).select("symbol", "name"), "symbol", "left").select("symbol", "trade_date", "name", "rank", "close", "volume")
    snapshot = src.spot(spark, d).select("symbol", "trade_date", F.col("latest_price").alias("close"), "pe_dynamic")
    return store.merge_coalesce(day, snapshot, ["symbol", "trade_date"]).select("trade_date", "symbol", "name", "rank", *rounded(["close", "volume", "pe_dynamic"]))


@query(with_ctes("SELECT o_custkey AS symbol, o_custkey IN (SELECT symbol FROM bars) AS present FROM (SELECT DISTINCT o_custkey FROM orders)", "bars"))
def resume_semi_anti(spark, d):
    done, stale = store.resume(src.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol")).distinct(), src.bars(spark, d))
    return done.withColumn("present", F.lit(True)).unionByName(stale.withColumn("present", F.lit(False)))


@query("WITH a AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_shipdate::DATE AS date FROM "
    "lineitem WHERE l_returnflag <> 'R') SELECT 'union' AS kind, date FROM (SELECT date FROM a UNION SELECT date FROM b) UNION ALL SELECT 'both', date "
    "FROM (SELECT date FROM a INTERSECT SELECT date FROM b) UNION ALL SELECT 'only_a', date FROM (SELECT date FROM a EXCEPT SELECT date FROM b)")
def set_ops(spark, d):
    lines = src.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_returnflag")
    a, b = lines.where("l_returnflag = 'R'").select("date"), lines.where("l_returnflag <> 'R'").select("date")
    parts = (("union", a.union(b).distinct()), ("both", a.intersect(b)), ("only_a", a.subtract(b)))
    out = [frame.select(F.lit(kind).alias("kind"), "date") for kind, frame in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _ways(bars: str) -> str:
    """(symbol, date, ma20, ma60, trend) of each symbol's last bar in a relation of bars."""
    return (f"SELECT symbol, date, ma20, ma60, CASE WHEN close > ma20 AND (ma60 IS NULL OR ma20 > ma60) THEN 'up' ELSE 'down' END AS trend FROM (SELECT symbol, date, close, "
        f"CASE WHEN n20 = 20 THEN round(m20, 3) END AS ma20, CASE WHEN n60 = 60 THEN round(m60, 3) END AS ma60, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn "
        f"FROM (SELECT symbol, date, close, count(*) OVER w20 AS n20, avg(close) OVER w20 AS m20, count(*) OVER w60 AS n60, avg(close) OVER w60 AS m60 FROM {bars} "
        f"WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING))) WHERE rn = 1")


_HIGHER = f"SELECT w.symbol, (CASE WHEN w.trend = 'up' THEN 8 ELSE 2 END + CASE WHEN m.trend = 'up' THEN 7 ELSE 1 END)::DOUBLE AS higher_score FROM ({_ways('weekly')}) w JOIN ({_ways('monthly')}) m USING (symbol)"


@query(with_ctes(_ways("weekly"), "weekly"))
def period_summary(spark, d):
    return resample.period_summary(resample.weekly(src.bars(spark, d))).select("symbol", "date", "ma20", "ma60", "trend")


@query(with_ctes(_HIGHER, "weekly", "monthly"))
def higher_score(spark, d):
    frame = src.bars(spark, d)
    return resample.higher_score(resample.period_summary(resample.weekly(frame)), resample.period_summary(resample.monthly(frame))).select("symbol", "higher_score")


@query(with_ctes("SELECT symbol, date, round(net_inflow, 4) AS net_inflow, CASE WHEN net_inflow <= -20000 THEN 'strong_out' WHEN net_inflow <= 0 THEN "
    "'out' WHEN net_inflow <= 20000 THEN 'in' ELSE 'strong_in' END AS flow_bin FROM flows", "flows"))
def flow_bins(spark, d):
    """Right-closed bins of the day's net flow."""
    x = F.col("net_inflow")
    label = F.when(x <= -20000, "strong_out").when(x <= 0, "out").when(x <= 20000, "in").otherwise("strong_in")
    return src.flows(src.bars(spark, d)).select("symbol", "date", F.round("net_inflow", 4).alias("net_inflow"), label.alias("flow_bin"))


